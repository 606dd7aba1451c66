"""Filter interaction audit by contractions of contingency tensors.

Every document either passes or fails each of five filters; a part's documents are counted by these five bits, also those of good and of
toxic labels. The counts of a part, reshaped to 2 x 2 x 2 x 2 x 2, answer every question about the filters in any order: along each axis a
step selects pass (1, 0), fail (0, 1) or all (1, 1), and einsum sums what is selected.

Bits come from one pass over the texts. From there on rows are (text hash, part, id, bits): counted by text, part and id first, so that a
text of very many copies is a row for each of its ids, then a row for each part, before its rows meet.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize, text_or_empty

NAMES = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]+"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_bits(text: Column, words: Column) -> Column:
    """Failures of A to D as bits 16, 8, 4 and 2: few words, few distinct words, many capitals, a sign."""
    n = F.size(words).cast("long")
    fails = [
        n < 50,
        100 * F.size(F.array_distinct(words)).cast("long") < 65 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(16 >> i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def tensors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source), labels (doc_id, quality, toxic) -> part, bits (0 to 31), n, good, toxic: at most 32 rows a part."""
    d = docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_or_empty().alias("text"))
    d = d.select("part", "no_id", "id", F.unhex(F.sha2("text", 256)).alias("key"), "text", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    d = d.select("part", "no_id", "id", "key", text_bits(F.col("text"), F.col("words")).alias("bits"))
    rows = d.groupBy("no_id", "id", "key", "part").agg(F.count("*").alias("n"), F.max("bits").alias("bits"))

    # A row without an id has no label; the join deals such rows out by their texts.
    l = labels.filter("doc_id is not null").groupBy(F.lit(False).alias("no_id"), F.col("doc_id").cast("long").alias("at")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.withColumn("at", F.when(F.col("no_id"), F.xxhash64("key", "part")).otherwise(F.col("id"))).join(l, ["no_id", "at"], "left").drop("at")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) * F.col("n") for c in ("good", "toxic")})

    sums = ["n", "good", "toxic"]
    least, counts = F.struct("no_id", "id"), F.struct(*sums)
    by_part = rows.groupBy("key", "part").agg(*(F.sum(c).alias(c) for c in sums), F.max("bits").alias("bits"), F.min(least).alias("least"), F.min_by(counts, least).alias("first"))
    first = F.min("least").over(Window.partitionBy("key")) == F.col("least")  # at most a row for each part here
    by_part = by_part.withColumn("passing", F.when(first, F.col("first")))
    split = F.array(
        F.struct(F.col("bits"), *(F.coalesce(F.col("passing")[c], F.lit(0)).alias(c) for c in sums)),
        F.struct((F.col("bits") + 1).alias("bits"), *((F.col(c) - F.coalesce(F.col("passing")[c], F.lit(0))).alias(c) for c in sums)),
    )
    return by_part.select("part", F.explode(split).alias("s")).groupBy("part", "s.bits").agg(*(F.sum(F.col("s")[c]).alias(c) for c in sums))


def contract(counts: np.ndarray, selected: np.ndarray) -> np.ndarray:
    """counts (k, 2, 2, 2, 2, 2), selected (m, 5, 2) -> (k, m): the sums of each count over what each row selects."""
    return np.einsum("kabcde,ma,mb,mc,md,me->km", counts, *(selected[:, i] for i in range(5)), optimize="greedy")


def steps() -> pd.DataFrame:
    """filter_order, step and what each measure selects along the axes."""
    rows = []
    for order in permutations(range(5)):
        for step, f in enumerate(order):
            before, upto = set(order[:step]), set(order[: step + 1])
            rows.append({
                "filter_order": "".join(NAMES[i] for i in order),
                "step": step + 1,
                "filter": f,
                "kept": [PASS if i in upto else ALL for i in range(5)],
                "removed": [FAIL if i == f else PASS if i in before else ALL for i in range(5)],
                "failing": [FAIL if i == f else ALL for i in range(5)],
                "only": [FAIL if i == f else PASS for i in range(5)],
            })
    return pd.DataFrame(rows)


def audit_part(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """bits, n, good, toxic of one part -> a row for each order and step."""
    counts = np.zeros((3, 32), np.int64)
    for k, c in enumerate(("n", "good", "toxic")):
        np.add.at(counts[k], rows["bits"].to_numpy(), rows[c].to_numpy())
    counts = counts.reshape(3, 2, 2, 2, 2, 2)
    got = {c: contract(counts, np.array(plan[c].tolist(), np.int64)) for c in ("kept", "removed", "failing", "only")}
    removed, good, toxic = got["removed"]
    shapley = np.zeros(5, np.int64)
    np.add.at(shapley, plan["filter"].to_numpy(), removed)
    out = {"kept": got["kept"][0], "removed": removed, "redundant": got["failing"][0] - removed, "unique_fails": got["only"][0], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[plan["filter"]]}
    return pd.DataFrame({"filter_order": plan["filter_order"], "step": plan["step"].astype("int32")} | {m: out[m] for m in MEASURES})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source), labels (doc_id, quality, toxic) -> part, filter_order, step and the long counts kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part that occurs.

    A null text is empty and a null source is the part ''. A row fails E if a row of a smaller doc_id has its text; a null doc_id counts as
    larger than all others, and rows of one doc_id (or of null ones) are not smaller than each other. Repeated rows count each. A doc_id of
    several labels is good, or toxic, if one of them says so; labels without doc_id and null labels say nothing. Without documents there
    are no rows. Other columns are ignored, whatever their names. A long text takes memory in proportion to itself."""
    plan = steps()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = audit_part(rows, plan)
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    counts = materialize(tensors(docs, labels), "tensors")
    return counts.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


ORACLE = r"""
with d as (select coalesce(source, '') part, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
lab as (select doc_id, max((quality = 1)::int) g, max((toxic = 1)::int) x from labels group by 1),
f as (select part, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
   'E': coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) over (partition by t), false)} b, coalesce(g, 0) g, coalesce(x, 0) x from d left join lab using (doc_id)),
c as (select part, b.A fa, b.B fb, b.C fc, b.D fd, b.E fe, count(*) n, sum(g) g, sum(x) x from f group by all),
letters as (select * from (values ('A'), ('B'), ('C'), ('D'), ('E')) v(l)),
o as (select a.l || b.l || c.l || d.l || e.l filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, step::int step, filter_order[step] l from o, range(1, 6) r(step)),
m as (select part, filter_order, step, n, g, x, l, list_contains(fails, l) own, len([y for y in fails if strpos(filter_order, y) < step]) > 0 earlier, len(fails) = 1 only_one
   from s, (select *, [y for y in ['A', 'B', 'C', 'D', 'E'] if case y when 'A' then fa when 'B' then fb when 'C' then fc when 'D' then fd else fe end] fails from c)),
a as (select part, filter_order, step, l, coalesce(sum(n) filter (not own and not earlier), 0)::bigint kept, coalesce(sum(n) filter (own and not earlier), 0)::bigint removed, coalesce(sum(n) filter (own and earlier), 0)::bigint redundant,
   coalesce(sum(n) filter (own and only_one), 0)::bigint unique_fails, coalesce(sum(g) filter (own and not earlier), 0)::bigint good_lost, coalesce(sum(x) filter (own and not earlier), 0)::bigint toxic_lost from m group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, l))::bigint shapley from a
"""
