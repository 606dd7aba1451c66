import json

from conftest import SF

from kbspark.operators import folds, usage
from kbspark.plans.catalog import QUERIES
from kbspark.streaming import jobs
from pyspark.sql import functions as F


def test_ingest_and_replay(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "source", F.lit("txt").alias("file_type"), "text")
    source, chunks, calls = (str(tmp_path / n) for n in ("in", "chunks", "calls"))
    docs.repartition(3).write.json(source)
    (tmp_path / "in" / "odd.json").write_text("not json\n" + json.dumps({"doc_id": 10**6, "file_type": "exe", "text": "x"}) + "\n" + json.dumps({"doc_id": 10**6 + 1, "file_type": "MD", "text": " \n"}))
    for run in ("a", "b"):  # the second run replays everything
        stream = spark.readStream.schema(jobs.MESSAGE).option("maxFilesPerTrigger", 2).json(source)
        jobs.ingest(stream, chunks, f"{calls}-{run}", str(tmp_path / f"check-{run}")).awaitTermination()
        got = spark.read.parquet(chunks)
        want = jobs.message_chunks(jobs.read_intake(spark, source)[0])
        assert got.count() == want.count() == got.select("chunk_id").distinct().count() > 40
        assert got.exceptAll(want.select(*got.columns)).isEmpty()
        by = {r.status: r.n for r in spark.read.parquet(f"{calls}-{run}").groupBy("status").agg(F.count("*").alias("n")).collect()}
        assert by == {"completed": docs.filter(F.col("text").rlike(r"\S")).count(), "failed": 3 + docs.filter(~F.coalesce("text", F.lit("")).rlike(r"\S")).count()}
    assert jobs.read_intake(spark, source)[1].filter("doc_id is null").count() == 1


def test_status_stream(spark, tmp_path):
    """One row a document after replayed and late callbacks, in whatever batches they come; a second stream over the same rows changes nothing."""
    rows = [(d, f"2024-01-01 00:00:{s:02d}", None if s == 9 else f"s{s}") for s in range(10) for d in (s % 3, s % 2)]
    rows += [*rows, (None, "2024-01-01 00:00:00", "x"), (7, "2024-01-01 00:30:00", "done"), (7, "2024-01-01 00:10:00", "late")]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "doc_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(5).write.parquet(source)
    assert jobs.latest_status(spark, path).count() == 0
    for run in ("a", "b"):
        stream = spark.readStream.schema("doc_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(source)
        jobs.track_status(stream, path, str(tmp_path / f"check-{run}"), buckets=2).awaitTermination()
        got = jobs.latest_status(spark, path).collect()
        assert len(got) == 4 and {r.doc_id: r.status for r in got} == {0: "failed", 1: "failed", 2: "s8", 7: "done"}


def test_status_of_events_in_one_file_or_several(spark, tmp_path):
    """The registered replay reads a table that is a file as well as one that is a folder of files, with callbacks sent twice."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.unionByName(e.filter("event_id % 5 = 0")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, QUERIES["str2_stream_status"](spark, SF).collect()))
    assert len(want) == e.select(F.floor(F.col("event_id") / 3)).distinct().count() and any(s == "failed" for _, s in want)
    assert sorted(map(tuple, QUERIES["str2_stream_status"](spark, str(tmp_path)).collect())) == want


def streamed(spark, tmp_path, df, job):
    """What job makes of df as a stream of one file, after a last row that moves the watermark on."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(source)
    stream = job(spark.readStream.schema(df.schema).parquet(source).withWatermark("ts", "10 minutes"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def test_cooldown_against_a_loop(spark, tmp_path):
    """Batch and stream: steady traffic is let through once a pause, refused requests do not lengthen it."""
    rows = [(u, 100 * u + i, 1_700_000_000 + i * step) for u, step in ((1, 10), (2, 60), (3, 61), (4, 0), (5, 25)) for i in range(30)]
    df = spark.createDataFrame(rows, "user_id long, request_id long, at long").select("user_id", "request_id", F.timestamp_seconds("at").alias("ts"))
    want, last = [], {}
    for u, i, at in rows:
        fine = u not in last or at - last[u] >= 60
        last[u] = at if fine else last[u]
        want.append((u, i, fine))
    assert sum(fine for u, _, fine in want if u == 1) == 5
    assert sorted(map(tuple, usage.cooldown(df.repartition(3)).collect())) == sorted(want) == streamed(spark, tmp_path, df, jobs.cooldown_stream)


def test_breaker_against_a_loop(spark, tmp_path):
    hits = {"empty": [1, 0, 1, 0, 0, 5, 0], "never": [0, 1, 0, 1], "slow": [1, 2, 3, 4, 5, 6], "null": [None, None, 1]}
    rows = [(k, 10 * n + i, 1_700_000_000 + i * (8 if k == "slow" else 1), h) for n, (k, v) in enumerate(hits.items()) for i, h in enumerate(v)]
    df = spark.createDataFrame(rows, "run_id string, result_id long, at long, n_hits int").select("run_id", "result_id", F.timestamp_seconds("at").alias("ts"), "n_hits")
    want = []
    for k, v in hits.items():
        streak, state = 0, "ok"
        for (run, i, at, h) in (r for r in rows if r[0] == k):
            streak = 0 if h else streak + 1
            if state == "ok":
                state = "empty" if streak >= 2 else "timeout" if k == "slow" and at - 1_700_000_000 > 30 else "ok"
            want.append((run, i, streak, state))
    assert {x[3] for x in want} == {"ok", "empty", "timeout"}
    assert sorted(map(tuple, usage.failure_streaks(df.repartition(3)).collect())) == sorted(want) == streamed(spark, tmp_path, df, jobs.breaker_stream)


def test_rate_limit_stream_as_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").limit(300)
    r = e.select((F.col("user_id") % 3).alias("key"), F.timestamp_add("SECOND", F.col("event_id") % 60, F.lit("2024-01-01").cast("timestamp")).alias("ts"), F.col("event_id").alias("request_id"), F.lit(1).alias("n"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    r.coalesce(1).write.parquet(source)
    stream = jobs.rate_limit_stream(spark.readStream.schema(r.schema).parquet(source).withWatermark("ts", "10 minutes"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    show = lambda d: sorted((x.request_id, x.allowed, round(x.retry_after, 6)) for x in d.collect())
    got = show(spark.read.parquet(out))
    assert got == show(folds.rate_limit(spark.read.parquet(source))) and {x[1] for x in got} == {True, False}


def test_feedback_stream_as_batch(spark, tmp_path):
    t = spark.range(40).select(F.col("id").alias("trace_id"), F.timestamp_add("SECOND", F.col("id") * 10, F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    late = F.timestamp_add("SECOND", F.col("trace_id") * 40, F.col("ts"))
    r = t.select(F.when(F.col("trace_id") % 7 == 0, F.col("trace_id") + 1000).otherwise(F.col("trace_id")).alias("trace_id"), late.alias("rated_at"), F.col("trace_id").alias("rating"))
    end = r.limit(1).select(F.lit(-1).cast("long").alias("trace_id"), F.lit("2024-02-01").cast("timestamp").alias("rated_at"), F.lit(0).cast("long").alias("rating"))
    paths = {n: str(tmp_path / n) for n in ("r", "t", "out")}
    r.unionByName(end).coalesce(1).write.parquet(paths["r"])
    t.unionByName(end.select("trace_id", F.col("rated_at").alias("ts"))).coalesce(1).write.parquet(paths["t"])
    read = lambda n, c, at: spark.readStream.schema(c).parquet(paths[n]).withWatermark(at, "10 seconds")
    stream = folds.feedback_join(read("r", r.schema, "rated_at"), read("t", t.schema, "ts"), t)
    stream.writeStream.format("parquet").option("path", paths["out"]).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    show = lambda d: sorted(map(tuple, d.filter("trace_id >= 0").collect()))
    got = show(spark.read.parquet(paths["out"]))
    assert got == show(folds.feedback_join(r, t, t)) and {x[2] for x in got} == {"cached", "stored", "error"}
