"""Structured Streaming jobs: ingest, status messages, rate limits. Each replay of a batch gives the same tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbspark.functions import text as tx
from kbspark.operators.folds import take
from kbspark.operators.governance import write_chunks
from kbspark.operators.usage import breaker_step, cooldown_step

#: File types that are taken in (fixed values).
FILE_TYPES = ["pdf", "docx", "xlsx", "pptx", "md", "html", "txt"]
MESSAGE = "doc_id long, source string, file_type string, text string, sent_at timestamp"


def check_intake(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that can be taken in, and (doc_id, status, reason) of the others."""
    known = F.coalesce(F.lower("file_type").isin(FILE_TYPES), F.lit(False))
    reason = F.when(F.col("doc_id").isNull(), "no document id").when(~known, "unknown file type").when(~F.coalesce("text", F.lit("")).rlike(r"\S"), "no text")
    m = messages.withColumn("reason", reason)
    return m.filter("reason is null").drop("reason"), m.filter("reason is not null").select("doc_id", F.lit("failed").alias("status"), "reason")


def read_intake(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of messages, as taken in and as failed; a line that isn't JSON is failed without an id."""
    return check_intake(spark.read.schema(MESSAGE).json(path))


def message_chunks(messages: DataFrame) -> DataFrame:
    """The lines of each message's text that aren't blank; ids hold the place of a line, so that a message sent again gives the same ids."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    c = messages.select("doc_id", "source", F.posexplode(lines).alias("chunk_index", "chunk_text"))
    return c.select(tx.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "*")


def ingest(messages: DataFrame, chunks_path: str, callbacks_path: str, checkpoint: str) -> StreamingQuery:
    """Stream of messages -> chunks appended once each, and a folder of callbacks (doc_id, status, chunks_created, reason) for each batch.

    A message that can't be taken in gives a failed callback and never stops the stream; of a message that comes twice in a batch the
    chunks are written once."""

    def batch(m: DataFrame, batch_id: int) -> None:
        good, failed = check_intake(m)
        c = message_chunks(good)
        write_chunks(c, chunks_path)
        done = good.select("doc_id").distinct().join(c.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks_created")), "doc_id", "left")
        done = done.select("doc_id", F.lit("completed").alias("status"), "chunks_created", F.lit(None).cast("string").alias("reason"))
        bad = failed.select("doc_id", "status", F.lit(0).cast("long").alias("chunks_created"), "reason")
        done.unionByName(bad).write.mode("overwrite").parquet(f"{callbacks_path}/batch={batch_id}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_status(callbacks: DataFrame, path: str, checkpoint: str, late: str = "1 hour", buckets: int = 64) -> StreamingQuery:
    """Stream of callbacks (doc_id, ts, status) -> a table at `path` of one row a document: its latest status by time, and then by name.

    A callback that was sent again within `late` is dropped; a null status is failed, a null doc_id is left out. Each batch is merged with
    the rows of the buckets that it touches, and those alone are written again. The merged rows stand beside the checkpoint first, so
    that a batch that breaks off while it replaces a bucket is carried through from them when it is tried again."""
    spark = callbacks.sparkSession
    c = callbacks.filter("doc_id is not null").select("doc_id", "ts", F.coalesce("status", F.lit("failed")).alias("status"))
    c = c.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "ts", "status"])

    def batch(b: DataFrame, batch_id: int) -> None:
        staged = f"{checkpoint}/merged/{batch_id}"
        if read_status(spark, f"{staged}/_SUCCESS", raw=True) is None:
            new = b.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
            old = latest_status(spark, path, with_bucket=True).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")  # at most `buckets` rows
            merged = old.unionByName(new).groupBy("bucket", "doc_id").agg(F.max(F.struct("ts", "status")).alias("x"))
            merged.select("bucket", "doc_id", "x.*").write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(STATUS).parquet(staged)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return c.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of the table of statuses.
STATUS = "bucket int, doc_id long, ts timestamp, status string"


def read_status(spark: SparkSession, path: str, raw: bool = False) -> DataFrame | None:
    """The files at path, or None where nothing is."""
    try:
        return spark.read.format("binaryFile").load(path) if raw else spark.read.schema(STATUS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_status(spark: SparkSession, path: str, with_bucket: bool = False) -> DataFrame:
    """doc_id, ts, status of the table, which is empty before the first batch."""
    found = read_status(spark, path)
    rows = spark.createDataFrame([], STATUS) if found is None else found
    return rows.select(*(["bucket"] if with_bucket else []), "doc_id", "ts", "status")


def breaker_stream(results: DataFrame, trip: int = 2, limit: float = 30.0, keep: float = 3600.0) -> DataFrame:
    """Stream (run_id, result_id, ts, n_hits) with a watermark on ts -> run_id, result_id, streak, state: `usage.failure_streaks` with a run's counter
    kept as its state. A run is forgotten `keep` seconds after its limit; results of a batch go by time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = (state.get if state.exists else None), []
        for r in pd.concat(batches).sort_values(["at", "result_id"]).itertuples(index=False):
            now = breaker_step(now, r.at, r.empty, trip, limit)
            out.append((r.run_id, r.result_id, now[0], now[2]))
        state.update(now)
        state.setTimeoutTimestamp(max(int(1000 * (now[1] + limit + keep)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "result_id", "streak", "state"])

    r = results.select("run_id", "result_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), (F.coalesce("n_hits", F.lit(0)) == 0).alias("empty"))
    return r.groupBy("run_id").applyInPandasWithState(run, "run_id string, result_id long, streak int, state string", "streak int, start double, reason string", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_stream(requests: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Stream (user_id, request_id, ts) with a watermark on ts -> user_id, request_id, allowed: `usage.cooldown` with the time of a user's last
    allowed request as state, which is forgotten once the watermark has passed the end of its pause."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for r in pd.concat(batches).sort_values(["at", "request_id"]).itertuples(index=False):
            last, fine = cooldown_step(last, r.at, seconds)
            out.append((r.user_id, r.request_id, fine))
        state.update((last,))
        state.setTimeoutTimestamp(max(int(1000 * (last + seconds)) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "request_id", "allowed"])

    r = requests.select("user_id", "request_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return r.groupBy("user_id").applyInPandasWithState(run, "user_id long, request_id long, allowed boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(requests: DataFrame, capacity: float = 30.0, rate: float = 1.0) -> DataFrame:
    """Stream (key, ts, request_id, n) with a watermark on ts -> request_id, allowed, retry_after: `folds.rate_limit` with the bucket kept as state of its key.

    Requests of a batch go by time; one that is older than the last of an earlier batch finds no time passed. A bucket is forgotten once
    the watermark has passed the time when it is full again, as a new one is full too."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = state.get if state.exists else None
        rows = pd.concat(batches).sort_values(["at", "request_id"])
        out = []
        for r in rows.itertuples(index=False):
            bucket, (allowed, wait) = take(bucket, r.at, r.n, capacity, rate)
            out.append((r.request_id, allowed, wait))
        state.update(bucket)
        full = int(1000 * (bucket[1] + capacity / rate)) + 1
        state.setTimeoutTimestamp(max(full, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "allowed", "retry_after"])

    r = requests.select("key", "request_id", F.col("n").cast("double").alias("n"), "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return r.groupBy("key").applyInPandasWithState(run, "request_id long, allowed boolean, retry_after double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def cache_stream(events: DataFrame) -> DataFrame:
    """Stream (key, ts, query_id, answer, ttl seconds) with a watermark on ts -> query_id, answer of the lookups (query_id is set): `folds.cache_lookup`
    with a key's latest entry kept as its state.

    Within a batch events go by time, entries before lookups of one time; of entries at one time the greatest answer counts. An entry
    is forgotten once the watermark has passed its end, so that lookups that come late may miss it. Null keys find nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entry = state.get if state.exists else None
        rows = pd.concat(batches)
        rows = rows.assign(asks=rows.query_id.notna()).sort_values(["at", "asks", "answer"])
        out = []
        for r in rows.itertuples(index=False):
            if r.asks:
                fresh = not pd.isna(key[0]) and entry is not None and entry[1] <= r.at < entry[1] + entry[2]
                out.append((int(r.query_id), entry[0] if fresh else None))
            elif entry is None or (r.at, r.answer) >= (entry[1], entry[0]):
                entry = (r.answer, float(r.at), float(r.ttl))
        if entry is not None:
            state.update(entry)
            state.setTimeoutTimestamp(max(int(1000 * (entry[1] + entry[2])) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["query_id", "answer"])

    e = events.select("key", "query_id", "answer", F.col("ttl").cast("double").alias("ttl"), "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return e.groupBy("key").applyInPandasWithState(run, "query_id long, answer string", "answer string, at double, ttl double", "append", GroupStateTimeout.EventTimeTimeout)
