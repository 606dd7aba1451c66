"""Source divergence audit: how far the sources of a language are apart in their terms.

1. Duplicate texts collapse: equal texts of a language are one row, with their number in each source; each text is shuffled once, and those
   of a task that are equal meet before.
2. A text is tokenized once. A task adds up, for each language and source, its terms' counts and documents, times the text's number there,
   and gives the sums out whenever they fill its table.
3. Terms of enough documents are kept; counts of at least one and the groups' sums give all probabilities, in integers.
4. Pairs are evaluated sparsely. A term that two groups lack adds the same to their distance, so only counts above zero are visited: V
   terms give V * |p0 - q0|, and each term present corrects that. Blocks of terms and blocks of sources bound what a task holds.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize, text_or_empty

#: A term is a run of ASCII letters and characters beyond ASCII: every other byte of UTF-8 becomes a space, capitals A-Z lower-case ones.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text and sources (array of (source, copies)): a row for each text of a language."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    d = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), text_or_empty().alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    copies = d.groupBy("lang", "key", "source").agg(F.count("*").alias("copies")).groupBy("lang", "key").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = d.select("lang", "key", "text").groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "key"]).select("lang", "text", "sources")


def term_counts(texts: DataFrame, room: int) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of collapsed texts, partial sums of a task. A task's table holds some `room`
    sums, and those of one text more."""

    def frame(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), table in sums.items():
            terms = list(table)
            n, docs = zip(*table.values(), strict=True)
            k = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(dict)
        held = 0
        for page in pages:
            for lang, text, sources in zip(page.column("lang").to_pylist(), page.column("text").cast(pa.binary()), page.column("sources"), strict=True):
                counted = Counter(text.as_py().translate(FOLD).split())
                if not counted:
                    continue
                for s in sources.as_py():
                    table, copies = sums[lang, s["source"]], s["copies"]
                    held -= len(table)
                    for term, n in counted.items():
                        old = table.get(term)
                        table[term] = (n * copies, copies) if old is None else (old[0] + n * copies, old[1] + copies)
                    held += len(table)
                    if held > room:
                        yield from frame(sums)
                        sums, held = defaultdict(dict), 0
        yield from frame(sums)

    return texts.mapInArrow(run, COUNTS)


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / (size + 5 * terms)), exact up to 10^19 in every part."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", wide(count + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(size + terms * 5)))


def statistics(docs: DataFrame, min_docs: int, room: int) -> tuple[DataFrame, DataFrame]:
    """Kept counts (lang, source, term, n, all_n: in the language) and groups (lang, source, v, p0, size, all_size, sid: place of the source in its language)."""
    counts = materialize(term_counts(collapsed(docs), room).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = materialize(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= min_docs).drop("docs"), "terms")
    kept = materialize(counts.drop("docs").join(terms, ["lang", "term"]), "kept")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    groups = docs.select(blank("lang"), blank("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "v", "all_size"])
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return kept, materialize(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("size"), F.col("v"))).withColumn("sid", sid), "groups")


def block_pairs(a: int, b: int, width: int):
    """Sums over one block of terms for the pairs of sources of blocks a and b. Rows: sid, p0, tid, p; tid is null in one row a source."""

    def dense(rows: pd.DataFrame, block: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, p0, terms x sources of p where there is a count (else p0), and whether there is one."""
        mine = rows[rows["sid"] // width == block]
        head = mine[mine["tid"] < 0].sort_values("sid")
        names, p0 = head["sid"].to_numpy(), head["p0"].to_numpy()
        x = mine[mine["tid"] >= 0]
        p, has = np.repeat(p0[None, :], n_terms, 0), np.zeros((n_terms, len(names)), bool)
        at = np.searchsorted(names, x["sid"].to_numpy())
        p[x["tid"].to_numpy(), at], has[x["tid"].to_numpy(), at] = x["p"].to_numpy(), True
        return names, p0, p, has

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.fillna({"tid": -1, "p": 0}).astype({"tid": "int64", "p": "int64"})
        at, rows["tid"] = np.unique(rows["tid"].to_numpy(), return_inverse=True)
        rows["tid"] -= int(at[0] < 0)
        n_terms = len(at) - int(at[0] < 0)
        names_a, pa0, p_a, has_a = dense(rows, a, n_terms)
        names_b, pb0, p_b, has_b = (names_a, pa0, p_a, has_a) if a == b else dense(rows, b, n_terms)
        apart = np.abs(pa0[:, None] - pb0[None, :])
        value = np.zeros((len(names_a), len(names_b)), np.int64)
        for i in range(len(names_a)):  # terms that i has
            t = np.flatnonzero(has_a[:, i])
            value[i] += (np.abs(p_a[t, i][:, None] - p_b[t]) - apart[i]).sum(axis=0)
        for j in range(len(names_b)):  # terms that j has and the other lacks
            t = np.flatnonzero(has_b[:, j])
            value[:, j] += np.where(has_a[t], 0, np.abs(p_b[t, j][:, None] - pa0[None, :]) - apart[:, j]).sum(axis=0)
        i, j = np.nonzero(names_a[:, None] < names_b[None, :])
        return pd.DataFrame({"a": names_a[i], "b": names_b[j], "value": value[i, j], "apart": apart[i, j]})

    return run


def pair_values(kept: DataFrame, groups: DataFrame, width: int, height: int) -> DataFrame:
    """lang, a, b (sids, a < b), value: the distance over all kept terms, for every two sources of a language."""
    g = groups.select("lang", "source", "sid", "size", "v", "p0")
    most = groups.groupBy("lang").agg((F.floor(F.max("sid") / width) + 1).cast("int").alias("source_blocks"), (F.floor(F.max("v") / height) + 1).cast("int").alias("term_blocks"))
    g = materialize(g.join(most, "lang"), "sources")
    tid = F.row_number().over(Window.partitionBy("lang", "tb").orderBy("term"))
    of_lang = most.select("lang", "term_blocks")
    terms = kept.select("lang", "term").distinct().join(of_lang, "lang").withColumn("tb", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")).withColumn("tid", tid).select("lang", "term", "tb", "tid")
    x = kept.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).join(g, ["lang", "source"])
    rows = x.select("lang", "tb", "sid", "source_blocks", "p0", "tid", share(F.col("n"), F.col("size"), F.col("v")).alias("p"))
    head = g.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).select("lang", "tb", "sid", "source_blocks", F.coalesce("p0", F.lit(0)).alias("p0"), F.lit(None).cast("int").alias("tid"), F.lit(None).cast("long").alias("p"))
    own = F.floor(F.col("sid") / width).cast("int")
    dealt = rows.unionByName(head).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1))).withColumns({"ba": F.least(own, "other"), "bb": F.greatest(own, "other")})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = block_pairs(int(key[2]), int(key[3]), width)(rows)
        out.insert(0, "lang", key[0])
        return out

    sums = dealt.select("lang", "tb", "ba", "bb", "sid", "p0", "tid", "p").groupBy("lang", "tb", "ba", "bb").applyInPandas(run, "lang string, a int, b int, value long, apart long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("apart").alias("apart"))
    return sums.join(groups.groupBy("lang").agg(F.max("v").alias("v")), "lang").select("lang", "a", "b", (F.col("value") + F.col("v") * F.col("apart")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, room: int = 400_000, width: int = 128, height: int = 4096) -> DataFrame:
    """docs (lang, source, text) -> lang, source, part, item, value, rank.

    Part `pair`: every other source of the language and the distance to it, all ranks. Part `term`: the terms that stand out against the
    language, up to rank `top`. Ranks go by value descending, then by the bytes of item ascending. Nulls of the three columns are ''; a
    language whose terms are all too rare has distances of 0 and no terms; a language of one source has no pairs. Repeated rows count
    each. An empty table gives no rows; other columns, doc_id too, are ignored, whatever their names. A very long text takes memory in
    proportion to itself. `room` bounds the sums that a task holds; width and height bound a block of sources and (about) of terms."""
    kept, groups = statistics(docs, min_docs, room)
    pairs = materialize(pair_values(kept, groups, width, height), "pairs")
    name = lambda x, y: groups.select("lang", F.col("sid").alias(x), F.col("source").alias(y))
    named = pairs.join(name("a", "one"), ["lang", "a"]).join(name("b", "two"), ["lang", "b"])
    both = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    pair = named.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    t = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("size"), F.col("v")), "q": share(F.col("all_n"), F.col("all_size"), F.col("v"))})
    term = t.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", place).unionByName(term.withColumn("rank", place).filter(F.col("rank") <= top))


ORACLE = r"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
g as (select distinct lang, source from d),
t as (select lang, term from (select lang, unnest(list_distinct(w)) term from d) group by all having count(*) >= 30),
c as (select lang, source, term, count(*) n from (select lang, source, unnest(w) term from d) join t using (lang, term) group by all),
v as (select lang, count(*)::hugeint v from t group by 1),
gs as (select lang, source, coalesce(s, 0)::hugeint s, v from g join v using (lang) left join (select lang, source, sum(n) s from c group by all) using (lang, source)),
gp as (select lang, source, term, coalesce(n, 0) n, (1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (s + 5 * v))::bigint p from gs join t using (lang) left join c using (lang, source, term)),
lp as (select lang, term, (1 + 1000000000::hugeint * (n + 5) // ((sum(n) over (partition by lang))::hugeint + 5 * v))::bigint q from (select lang, term, sum(n)::hugeint n from c group by all) join v using (lang)),
pair as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
   left join (select x.lang, x.source s1, y.source s2, sum(abs(x.p - y.p)) as value from gp x join gp y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) e on e.lang = a.lang and s1 = a.source and s2 = b.source),
term as (select lang, source, 'term' part, term item, (p - q)::bigint as value from gp join lp using (lang, term) where n > 0 and p > q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from (select * from pair union all select * from term))
select * from r where part = 'pair' or rank <= 50
"""
