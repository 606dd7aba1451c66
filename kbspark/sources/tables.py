"""Tables, and the views of FIXTURES.md that the knowledge-base operators work on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs a reread only."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents as chunks."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(lines).alias("chunk_index", "chunk_text"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return d.select(
        F.sha2(F.concat_ws(":", "doc_id", "chunk_index"), 256).alias("chunk_id"), "doc_id", "chunk_index", "chunk_text", F.col("source").alias("kb_id"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("source_file"), F.when(F.col("doc_id") % 10 == 0, "soft_deleted").otherwise("active").alias("status"),
        day.alias("effective_date"), F.when(F.col("doc_id") % 3 == 0, F.date_add(day, 180)).alias("expiry_date"), F.concat(F.lit("v"), F.col("doc_id") % 4).alias("version"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (5 + F.col("item_id") % 10).cast("int").alias("top_k"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with one of the embeddings, all of which are used in turn."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return chunks(spark, sf_dir).withColumn("vec_id", (F.col("doc_id") + 7 * F.col("chunk_index")) % max(1, e.count())).join(e, "vec_id").select("chunk_id", "doc_id", "embedding")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return questions(spark, sf_dir).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), (F.col("c_custkey") % 50 == 0).alias("is_global_admin"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    nation = F.concat(F.lit("n"), "n_nationkey")
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("group_id"), F.lit(None).cast("string").alias("parent_group_id"), F.col("r_name").alias("name"), F.lit(False).alias("is_system_admin"))
    mid = n.select(nation.alias("group_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_group_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") == 7).alias("is_system_admin"))
    team = n.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t"))
    low = team.select(F.concat(F.lit("t"), "n_nationkey", F.lit("_"), "t").alias("group_id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_group_id"), F.concat("n_name", F.lit(" "), "t").alias("name"), F.lit(False).alias("is_system_admin"))
    return top.unionByName(mid).unionByName(low)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    team = c.filter("c_custkey % 9 <> 0").select(F.concat(F.lit("t"), "c_nationkey", F.lit("_"), F.col("c_custkey") % 4).alias("group_id"), F.col("c_custkey").alias("user_id"))
    return team.unionByName(c.filter("c_custkey % 6 = 0").select(F.concat(F.lit("n"), "c_nationkey").alias("group_id"), F.col("c_custkey").alias("user_id")))


def space_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    own = r.select(F.concat(F.lit("s"), "r_regionkey").alias("space_id"), F.concat(F.lit("r"), "r_regionkey").alias("group_id"))
    return own.unionByName(n.select(F.concat(F.lit("s"), (F.col("n_regionkey") + 4) % 5).alias("space_id"), F.concat(F.lit("n"), "n_nationkey").alias("group_id")))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("trace_id"), "ts", "user_id", F.col("event_type").alias("source"), (F.col("value") * 100).alias("total_ms"), F.when(F.col("event_id") % 13 != 0, F.pmod(k, F.lit(4)) / 4).alias("faithfulness"))
