"""Mixing sources to target weights by pivotal dependent rounding.

1. Sizes (words) of documents and of sources; targets: shares of the mix by weight, stopped at `most` times a source's size, the excess
   reshared by weight (water filling, a round of sums over the table of sources each).
2. A document is taken target / source size times: the whole copies at once, and the fraction left is a copy probability.
3. Pivotal rounding: of two documents with fractional probabilities, words move from one to the other until one of them has a probability
   of 0 or 1; the direction is drawn so that both keep their expectation. The sum of probability times size, hence the source's target, stays
   as it is with every move. A stream of a source's documents carries one unsettled document.
4. Reduction tree: a source's documents go to groups of about `fan` by their hash; each group leaves at most one unsettled document, and
   those meet in groups of `fan` again, until one is left in a source, which a draw of its probability settles. So a source's words differ from
   its target by less than the size of one document.

Draws are hashes of (doc_id, text, level), so reruns agree, however rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize, text_or_empty

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (hash of the row), size (words), in the shared folder."""
    text = text_or_empty()
    return materialize(docs.select("doc_id", "source", F.xxhash64("doc_id", text).alias("h"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size")), "sizes")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds at: the place (from 0) of the source among all by code point, null last. Ranges are numbered within, and after the counts of
    those before them; only one row a range meets the others."""
    r = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("range", F.spark_partition_id())
    r = materialize(r, "ranges")
    before = r.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")) - 1
    return r.withColumn("place", place).join(F.broadcast(before), "range").withColumn("at", F.col("before") + F.col("place")).drop("range", "before", "place")


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """sources (source, source_size, ..) -> with s (place of the source) and target (double). Weights repeat over the sources in order. Each round takes the sources
    whose part of what is left reaches their stop out of the sharing; a round is one sum, and rounds end with the first that stops no more."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    s = materialize(ranked(sources).withColumn("weight", weight), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(full.cast("long")).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("words"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if r["n"] == stopped or not r["weight"]:
            break
        stopped, level = r["n"], float((share * total - most * (r["words"] or 0)) / r["weight"])
    return s.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("weight"))).withColumnRenamed("at", "s").drop("weight")


def joined_sources(rows: DataFrame, sources: DataFrame, max_broadcast: int, salts: int = 64) -> DataFrame:
    """rows with the columns of their source: few sources are broadcast; more of them stand once for each salt, so that the rows of a large
    source meet it in several tasks."""
    if sources.count() <= max_broadcast:
        at = F.broadcast(sources.withColumnRenamed("source", "__source"))
        return rows.join(at, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    at = sources.withColumnRenamed("source", "__source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__own", F.pmod("h", F.lit(salts)).cast("int"))
    return dealt.join(at, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt"))).drop("__source", "__own", "__salt")


def draw(level: int) -> Column:
    """A number of [0, 1) for a row at a level of the tree."""
    return F.pmod(F.xxhash64("h", F.lit(level)), F.lit(2**40)) / F.lit(float(2**40))


def move(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """Words move between documents of probabilities p, q (between 0 and 1) and sizes a, b until one probability is 0 or 1. With chance
    down / (up + down) they go to the first, which leaves both expectations as they are."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        return (1.0, max(0.0, q - up / b)) if (1 - p) * a <= q * b else (min(1.0, p + up / a), 0.0)
    return (0.0, min(1.0, q + down / b)) if p * a <= (1 - q) * b else (max(0.0, p - down / a), 1.0)


def settle(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of groups (s, bucket) in order, each with p between 0 and 1, size and u -> the same rows, p settled to 0 or 1 but for at most one
    row a group. Besides a page only the unsettled row is held, whatever the size of a group."""
    group, held_p, held_size = None, 0.0, 0  # of the unsettled row
    row: pd.DataFrame | None = None  # that row, if it came in an earlier page
    at = -1  # its place, if it came in this one; no row is unsettled where both say so
    for page in pages:
        s, bucket, size, u, p = (page[c].tolist() for c in ("s", "bucket", "size", "u", "p"))
        for i in range(len(page)):
            if (row is not None or at >= 0) and group == (s[i], bucket[i]):
                one, two = move(held_p, held_size, p[i], size[i], u[i])
                p[i] = two
                if 0.0 < one < 1.0:
                    held_p = one
                    continue
                held_p = one
            if row is not None:
                yield row.assign(p=held_p)
                row = None
            elif at >= 0:
                p[at] = held_p
            at = -1
            if 0.0 < p[i] < 1.0:
                group, held_p, held_size, at = (s[i], bucket[i]), p[i], size[i], i
        done = page.assign(p=p)
        if at >= 0:
            row, done = page.iloc[[at]], done.drop(page.index[at])
            at = -1
        yield done
    if row is not None:
        yield row.assign(p=held_p)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, fan: int = 8192, max_broadcast: int = 100_000) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, h (hash of doc_id and text), size, source_size, target (of its source), copies.

    One row for each row of docs; repeated rows are rows of their own, with copies each. Null texts and texts without words have size 0
    and take no part in the rounding; a null doc_id is an id like others; null sources are one source, the last. Without words all
    targets are 0; an empty table gives no rows. Other columns are ignored, whatever their names. No document has more than `most`
    copies; a text counts whole, however long."""
    rows = sized(docs)
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = with_targets(s, weights, share, most)
    s = materialize(s.withColumn("buckets", F.ceil(F.col("n") / fan).cast("long")).drop("n"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = joined_sources(rows, s, max_broadcast).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    r = r.withColumns({"p": F.when(F.col("size") > 0, F.col("rate") - F.col("base")).otherwise(F.lit(0.0)), "bucket": F.pmod("h", F.col("buckets"))})
    out = ["doc_id", "source", "h", "size", "source_size", "target", "base", "s", "bucket", "p"]
    schema = "doc_id long, source string, h long, size long, source_size long, target double, base long, s long, bucket long, p double, u double"
    r = r.select(F.col("doc_id").cast("long").alias("doc_id"), *out[1:])
    settled = [r.filter("p = 0")]
    left, level, groups = r.filter("p > 0"), 0, s.agg(F.max("buckets")).first()[0] or 0
    while groups:
        dealt = left.withColumn("u", draw(level)).repartition("s", "bucket").sortWithinPartitions("s", "bucket", F.xxhash64("h", F.lit(-1)), "h", "size")
        done = materialize(dealt.mapInPandas(settle, schema), "rounds")
        settled.append(done.filter("p = 0 or p = 1").drop("u"))
        left = done.filter("p > 0 and p < 1").drop("u")
        if groups == 1:
            break
        level, groups = level + 1, -(-groups // fan)
        left = left.withColumn("bucket", F.floor(F.col("bucket") / fan))
    settled.append(left.withColumn("p", F.when(draw(-2) < F.col("p"), 1.0).otherwise(0.0)))
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part.select(*out))
    return whole.select("doc_id", "source", "h", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def taken_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as plan (of mix) says. Of rows that repeat with doc_id and text one, any, stands
    for the copies of all of them."""
    per = plan.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    j = docs.join(per, docs.doc_id.eqNullSafe(per["__id"]) & (F.xxhash64(docs.doc_id, F.coalesce(docs.text, F.lit(""))) == per["__h"]))
    some = j.filter("__rows = 1").unionByName(j.filter("__rows > 1").dropDuplicates(["__id", "__h"])).filter("__copies > 0")
    return some.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def digest(plan: DataFrame) -> DataFrame:
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
