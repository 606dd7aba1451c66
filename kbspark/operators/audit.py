"""Corpus audit over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def length() -> Column:
    return F.length("chunk_text")


def totals(c: DataFrame) -> DataFrame:
    return c.agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("kb_id").alias("n_sources"))


def doc_stats(c: DataFrame) -> DataFrame:
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("chunk_index").cast("long").alias("first_index"), F.max("chunk_index").cast("long").alias("last_index"), F.min(length()).cast("long").alias("shortest"), F.max(length()).cast("long").alias("longest"), F.round(F.avg(length()), 6).alias("mean_length"))


def length_stats(c: DataFrame) -> DataFrame:
    p = lambda q: F.percentile(length(), F.lit(q))
    return c.agg(F.round(F.avg(length()), 6).alias("mean"), F.min(length()).cast("long").alias("least"), F.max(length()).cast("long").alias("most"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.round(F.stddev_samp(length()), 6).alias("stddev"))


def length_histogram(c: DataFrame, bounds: tuple[int, ...] = (20, 50, 100, 200, 300, 500, 800, 1000, 1500, 2000)) -> DataFrame:
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(length() < bounds[i], i).otherwise(bucket)
    return c.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(length()), 6).alias("mean_length"))


def length_outliers(c: DataFrame, short: int = 20, long: int = 2000) -> DataFrame:
    return c.filter((length() < short) | (length() > long)).select("chunk_id", length().cast("long").alias("n"), (length() > long).alias("is_long"))


def boundary_quality(c: DataFrame) -> DataFrame:
    """Chunks that start in lower case, and those but the last that end without a final mark."""
    last = F.col("chunk_index") == F.max("chunk_index").over(Window.partitionBy("doc_id"))
    flags = c.select("doc_id", F.col("chunk_text").rlike("^[a-z]").cast("long").alias("lower"), (~last & ~F.col("chunk_text").rlike("[.!?。！？]$")).cast("long").alias("open"))
    return flags.groupBy("doc_id").agg(F.sum("lower").alias("starts_lower"), F.sum("open").alias("ends_open"))


def fragment_transitions(c: DataFrame) -> DataFrame:
    nxt = F.lead("chunk_text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return c.select("doc_id", "chunk_index", (~F.col("chunk_text").rlike("[.!?。！？]$") & nxt.rlike("^[a-z ]")).alias("broken")).filter("broken").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


def exact_duplicates(c: DataFrame) -> DataFrame:
    g = c.groupBy(F.sha2("chunk_text", 256).alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("chunk_id").alias("first_chunk"))
    return g.filter("n > 1")


def index_gaps(c: DataFrame) -> DataFrame:
    """Missing indices: (doc_id, after, before) where two chunks that follow aren't neighbours."""
    nxt = F.lead("chunk_index").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("after"), nxt.cast("long").alias("before")).filter("before - after > 1")
