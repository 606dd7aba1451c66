"""A keyword index that is kept between searches, and search that skips what can't be among the best.

The index is a folder of batches. A batch has `postings` (a row for each term of a block, with the entries of its chunks), `peaks` (tf_max and
l_min of each such row, which bound the score that the term can give there) and `chunks` (chunk_id, h, l, block, ref). A block is up to
`block_chunks` chunks that follow one another, so a row is short whatever the term. Chunks are dealt out by block once; from there counts, rows
and their order by term stay within a partition. `refresh` writes a batch of the chunks that are missing and a list of the entries that are
gone or changed, and commits both by a last small file. A batch without it is not read, so a refresh that breaks off leaves the index as
it was.

Search finds a floor for each query first: the k-th best whole score among the chunks that its rarest terms rank highest. The bounds of a
block's terms add up to what its chunks can reach; blocks below the floor are skipped. A block keeps the queries that may find something
in it as bits, 64 to a number; where two queries share a bit, the block is let through for both. Postings meet these bits by block, then
the queries' terms, and are summed where they lie, so that only chunks at or above the floor are shuffled. What comes out is exactly the
ranking over all postings.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions.text import terms
from kbspark.operators.retrieval import query_terms, top
from kbspark.sources.tables import materialize

SCHEMAS = {
    "postings": "batch string, block long, term string, entries array<struct<ref:long,doc_id:long,kb_id:string,tf:long,l:long>>",
    "peaks": "batch string, block long, term string, tf_max long, l_min long",
    "chunks": "batch string, block long, ref long, chunk_id string, h long, l long",
    "gone": "of string, ref long, batch string",
    "commits": "batch string",
}
#: Scores are rounded to this many places before they are ranked.
PLACES = 6
#: Queries whose bits share a number.
BITS = 64


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}/*")
    except AnalysisException as e:  # nothing was written yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of the batches that were committed; a refresh adds one short row to `commits`."""
    return read(spark, path, name).join(F.broadcast(read(spark, path, "commits").select("batch")), "batch", "left_semi")


def without_gone(spark: SparkSession, path: str, rows: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """rows (batch, ref, ..) but for the entries that a later refresh took out."""
    gone = committed(spark, path, "gone").select(F.col("of").alias("batch"), "ref")
    n = gone.count()
    if not n:
        return rows
    return rows.join(F.broadcast(gone) if n <= max_broadcast else gone, ["batch", "ref"], "left_anti")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that are in the index: batch, block, ref, chunk_id, h, l."""
    return without_gone(spark, path, committed(spark, path, "chunks"))


def text_of(chunks: DataFrame) -> Column:
    """The text to index: content_with_weight where a chunk has it, else chunk_text."""
    return F.coalesce(*(c for c in ("content_with_weight", "chunk_text") if c in chunks.columns), F.lit(""))


def refresh(chunks: DataFrame, path: str, block_chunks: int = 16) -> dict[str, int]:
    """Brings the index at `path` up to date with chunks (chunk_id, doc_id, kb_id, chunk_text) and returns how many entries were added and
    taken out. Chunks that are in it already, with the same text, document and base, are neither tokenized nor written again.

    chunk_id must be unique; a null chunk_id is left out. Chunks without terms are entries without postings."""
    spark = chunks.sparkSession
    c = chunks.filter("chunk_id is not null").select("chunk_id", F.col("doc_id").cast("long").alias("doc_id"), "kb_id", text_of(chunks).alias("text")).withColumn("h", F.xxhash64("text", "doc_id", "kb_id"))
    known = entries(spark, path)
    missing = c.join(known.select("chunk_id", "h"), ["chunk_id", "h"], "left_anti")
    missing = materialize(missing.withColumn("ref", F.monotonically_increasing_id()))  # read back, so that ref is the same at each use
    gone = materialize(known.join(c.select("chunk_id", "h"), ["chunk_id", "h"], "left_anti").select(F.col("batch").alias("of"), "ref"))
    added, removed = missing.count(), gone.count()
    if not added and not removed:
        return {"added": 0, "removed": 0}
    batch = uuid.uuid4().hex

    def put(df: DataFrame, name: str) -> None:
        names = [f.split()[0] for f in SCHEMAS[name].split(", ")]
        df.withColumn("batch", F.lit(batch)).select(*names).write.parquet(f"{path}/{name}/{batch}")

    w = missing.withColumn("block", F.expr(f"ref div {block_chunks}")).repartition("block").withColumn("w", terms(F.col("text"))).withColumn("l", F.size("w").cast("long"))
    tf = w.select("block", "ref", "doc_id", "kb_id", "l", F.explode("w").alias("term")).groupBy("block", "ref", "term")
    tf = tf.agg(F.first("doc_id").alias("doc_id"), F.first("kb_id").alias("kb_id"), F.count("*").alias("tf"), F.first("l").alias("l"))
    entry = F.struct("ref", "doc_id", "kb_id", "tf", "l")
    put(tf.groupBy("term", "block").agg(F.collect_list(entry).alias("entries")).sortWithinPartitions("term", "block"), "postings")
    written = spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings/{batch}")
    put(written.select("block", "term", F.array_max("entries.tf").alias("tf_max"), F.array_min("entries.l").alias("l_min")), "peaks")
    put(w, "chunks")
    put(gone, "gone")
    put(spark.createDataFrame([(batch,)], SCHEMAS["commits"]).coalesce(1), "commits")
    return {"added": added, "removed": removed}


def unfolded(folded: DataFrame) -> DataFrame:
    """An entry a row: batch, block, term, ref, doc_id, kb_id, tf, l."""
    return folded.select("batch", "block", "term", F.inline("entries"))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings that count: chunk_id, term, tf, and batch, block, ref, doc_id, kb_id, l."""
    return unfolded(committed(spark, path, "postings")).join(entries(spark, path).select("batch", "ref", "chunk_id"), ["batch", "ref"])


def weigh(scorer: str, k1: float, b: float):
    """(share of a term with tf in a chunk of length l, weight of the term in a query)."""
    if scorer == "tf":
        return lambda tf, l: 1 + F.log(tf), lambda: 1 / F.col("n_terms")
    if scorer != "bm25":
        raise ValueError(f"unknown scorer {scorer}: bm25 or tf")
    return lambda tf, l: tf * (k1 + 1) / (tf + k1 * (1 - b + b * l / F.col("mean"))), lambda: F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def allowed() -> Column:
    """Whether a query may see a posting: kb_ids and excluded_docs are arrays; null sets no bound."""
    inside = F.col("kb_ids").isNull() | F.coalesce(F.array_contains("kb_ids", F.col("kb_id")), F.lit(False))
    return inside & ~(F.col("excluded_docs").isNotNull() & F.coalesce(F.array_contains("excluded_docs", F.col("doc_id")), F.lit(False)))


def plan(queries: DataFrame, path: str, k: int | str, scorer: str, k1: float, b: float, seeds: int, max_broadcast: int) -> dict[str, DataFrame]:
    """The steps of a search by name:

    first: postings that are scored to find the floors; floors (query_id, limit, floor): no chunk below its query's floor can be among the
    best; blocks (batch, block, part, bits): the queries that may find something in a block; rest: postings that queries meet in those
    blocks, with their scores; open (query_id, batch, ref, limit, score): whole scores of the chunks that reach the floor."""
    spark = queries.sparkSession
    part, weight = weigh(scorer, k1, b)
    slack = 2 * 10.0**-PLACES
    e = entries(spark, path).filter("l > 0").agg(F.count("*").alias("n"), F.avg("l").alias("mean"))
    q = queries
    for name, kind in (("kb_ids", "array<string>"), ("excluded_docs", "array<bigint>"), ("keywords", "array<string>")):
        if name not in q.columns:
            q = q.withColumn(name, F.lit(None).cast(kind))
    q = q.select("query_id", F.concat_ws(" ", F.array_join("keywords", " "), "query").alias("query"), "kb_ids", "excluded_docs", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("limit"))
    wanted = query_terms(q)
    asked = wanted.select("term").distinct()
    asked = F.broadcast(asked) if asked.count() <= max_broadcast else asked
    p = materialize(without_gone(spark, path, unfolded(committed(spark, path, "postings").join(asked, "term", "left_semi"))))
    peaks = committed(spark, path, "peaks").join(asked, "term", "left_semi")
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    of_query = wanted.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    parts = max(1, -(-q.count() // BITS))  # numbers of bits for each block
    t = wanted.join(df, "term").join(of_query, "query_id").join(F.broadcast(e)).withColumn("weight", weight())  # e is one row
    t = t.join(q.select("query_id", "kb_ids", "excluded_docs", "limit"), "query_id")
    t = materialize(t.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("bit", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(BITS)).cast("int")))
    small = F.broadcast if t.count() <= max_broadcast else lambda rows: rows
    scores = lambda rows: rows.withColumn("score", F.col("weight") * part(F.col("tf"), F.col("l")))
    chunk = ["batch", "block", "ref"]

    # A floor: whole scores of the chunks that the rarest terms of a query rank highest; more terms than `seeds` where these have few chunks.
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = t.withColumn("r", F.row_number().over(rarest)).withColumn("before", before).filter((F.col("r") <= seeds) | (F.col("before") < 2 * F.col("limit")))
    ranked = F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.col("score").desc(), "batch", "ref"))
    seed = scores(rare.join(p, "term").filter(allowed())).withColumn("r", ranked).filter(F.col("r") <= F.col("limit")).select("query_id", *chunk).distinct()
    first = scores(seed.join(t, "query_id").join(p, [*chunk, "term"]))
    whole = first.groupBy("query_id", "batch", "ref", "limit").agg(F.round(F.sum("score"), PLACES).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    reached = whole.withColumn("r", best).filter(F.col("r") == F.col("limit")).select("query_id", (F.col("score") - slack).alias("floor"))
    floors = materialize(q.select("query_id", "limit").join(reached, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))))

    bound = peaks.repartition("batch", "block").join(small(t.select("query_id", "term", "weight", "mean", "part", "bit")), "term")
    reach = bound.groupBy("query_id", "batch", "block", "part", "bit").agg(F.sum(F.col("weight") * part(F.col("tf_max"), F.col("l_min"))).alias("reach"))
    reach = reach.join(small(floors.select("query_id", "floor")), "query_id").filter("reach >= floor")
    blocks = reach.groupBy("batch", "block", "part").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))

    met = p.repartition("batch", "block").join(blocks, ["batch", "block"]).join(small(t.drop("df", "n", "n_terms")), ["part", "term"])
    rest = scores(met.filter(F.expr("shiftright(bits, bit) & 1 = 1") & allowed()))
    open_ = rest.groupBy("query_id", *chunk, "limit").agg(F.round(F.sum("score"), PLACES).alias("score"))
    open_ = open_.join(small(floors.select("query_id", "floor")), "query_id").filter("score >= floor").select("query_id", "batch", "ref", "limit", "score")
    return {"first": first, "floors": floors, "blocks": blocks, "rest": rest, "open": open_}


def search(queries: DataFrame, path: str, k: int | str = 30, scorer: str = "bm25", k1: float = 1.2, b: float = 0.75, seeds: int = 3, max_broadcast: int = 200_000) -> DataFrame:
    """queries (query_id, query; kb_ids, excluded_docs, keywords if there) over the index at `path` -> query_id, chunk_id, score, rank: the k
    best chunks that hold any term. k is a number or a column of queries.

    scorer bm25, or tf: the sum of 1 + ln(tf) over the query's terms, divided by their number, which needs no statistics. Statistics are
    those of the whole index, whatever a query may see. Equal scores go by chunk_id. A query without terms finds nothing."""
    found = plan(queries, path, k, scorer, k1, b, seeds, max_broadcast)["open"]
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))  # all of equal scores, as their ids aren't known yet
    some = materialize(found.withColumn("place", place).filter(F.col("place") <= F.col("limit")))
    named = entries(queries.sparkSession, path).select("batch", "ref", "chunk_id").join(some, ["batch", "ref"])
    return top(named, "limit").select("query_id", "chunk_id", "score", "rank")
