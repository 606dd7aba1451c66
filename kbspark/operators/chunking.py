"""Chunk-level text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions.text import estimate_tokens


def overlap_content(c: DataFrame, share: float = 0.15, cap: int = 200) -> DataFrame:
    """Each chunk with the tail of the one before and the head of the one after, of `share` of their length and `cap` at most."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    before, after = F.lag("chunk_text").over(w), F.lead("chunk_text").over(w)
    size = lambda t: F.least(F.floor(F.length(t) * share), F.lit(cap)).cast("int")
    tail = F.when(size(before) > 0, F.right(before, size(before)))
    head = F.when(size(after) > 0, F.left(after, size(after)))
    return c.select("chunk_id", F.concat_ws("\n", tail, "chunk_text", head).alias("content"))


def chunk_relations(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return c.select("chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"))


def weighted_content(c: DataFrame, share: float = 0.15, cap: int = 200) -> DataFrame:
    """c (doc_id, chunk_index, chunk_id, kind, content) -> chunk_id, content, weighted, tokens: what is indexed of a chunk, which is its content,
    then the tail of the chunk before and the head of the one after, of `share` of their length and `cap` at most. Only texts lend theirs.
    A null kind is text, a null content is empty."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    content = F.coalesce("content", F.lit(""))
    lent = F.when(F.coalesce("kind", F.lit("text")) == "text", content)
    size = lambda t: F.least(F.floor(F.length(t) * share), F.lit(cap)).cast("int")
    x = c.select("chunk_id", content.alias("content"), F.lag(lent).over(w).alias("before"), F.lead(lent).over(w).alias("after"))
    tail = F.when(size("before") > 0, F.right("before", size("before")))
    head = F.when(size("after") > 0, F.left("after", size("after")))
    weighted = F.concat_ws("\n", "content", tail, head)
    return x.select("chunk_id", "content", weighted.alias("weighted"), estimate_tokens(weighted).alias("tokens"))


def pack_parents(c: DataFrame, most: int = 500) -> DataFrame:
    """Greedy packing of a document's chunks into parents of up to `most` tokens (characters div 2): a fold within each document."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", F.greatest(F.lit(1), F.floor(F.length("chunk_text") / 2)).cast("int").alias("t"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("parent"), F.array().cast("array<struct<i:int,p:int>>").alias("out"))

    def add(a, x):
        full = (a.n > 0) & (a.n + x.t > most)
        parent = F.when(full, a.parent + 1).otherwise(a.parent)
        return F.struct(F.when(full, x.t).otherwise(a.n + x.t).alias("n"), parent.alias("parent"), F.concat(a.out, F.array(F.struct(x.chunk_index.alias("i"), parent.alias("p")))).alias("out"))

    return c.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.explode(F.aggregate("rows", start, add, lambda a: a.out)).alias("x")).select("doc_id", F.col("x.i").cast("long").alias("chunk_index"), F.col("x.p").cast("long").alias("parent"))


def pii_report(docs: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Hits and documents touched for each rule."""
    hits = docs.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p in patterns))).alias("x")).select("x.*")
    return hits.groupBy("rule").agg(F.sum("n").cast("long").alias("hits"), F.count_if(F.col("n") > 0).alias("n_docs"))
