"""Shared helpers: reading tables, cutting lineage through the cluster's shared folder, words, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII control, punctuation and upper-case letters (texts are lower-cased first).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else the one set on the context. Only a local[..] session without either gets a folder
    of its own."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage is cut and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def folded_words(text: Column) -> Column:
    """Words of the text in lower case. Both forms of the small sigma count as one, since the choice depends on what follows the word."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in joins and groups."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), F.reverse(text)).alias("y"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that can be reached. Labels move over edges and jump over their labels, so
    the rounds grow with the logarithm of a chain's length; each round is written to the shared folder, nothing but a count of
    changes reaches the driver."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = materialize(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("component")), "labels")
        if new.filter("old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
