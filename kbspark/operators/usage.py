"""Conversations, traces, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.operators.folds import fold_rows


def conversation_stats(messages: DataFrame) -> DataFrame:
    """Messages, rounds, and the first user message's first 50 characters as the title."""
    title = F.substring(F.regexp_replace(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), "\n", " "), 1, 50)
    g = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.when(F.count_if(F.col("role") == "user") > 0, title).alias("title"))
    return g.select("conv_id", "n_messages", F.floor(F.col("n_messages") / 2).alias("rounds"), "title")


def history_window(messages: DataFrame, rounds: int = 3, cut: int = 200) -> DataFrame:
    """The last 2 * rounds messages of each conversation, cut and labelled, in order."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    m = messages.withColumn("n", last).filter(F.col("n") <= 2 * rounds)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, cut))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n").alias("history"))


def recent_history(messages: DataFrame, n: int = 4) -> DataFrame:
    """The last n messages, of which only those of users and assistants are kept."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return messages.withColumn("n", last).filter(F.col("n") <= n).filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


def latency_stats(traces: DataFrame) -> DataFrame:
    p = lambda q: F.round(F.percentile("total_ms", F.lit(q)), 6)
    return traces.groupBy("source").agg(F.count("*").alias("n"), F.round(F.min("total_ms"), 6).alias("least"), F.round(F.max("total_ms"), 6).alias("most"), p(0.5).alias("median"))


def judge_scores(traces: DataFrame) -> DataFrame:
    return traces.groupBy("source").agg(F.count("faithfulness").alias("n_scored"), F.round(F.avg("faithfulness"), 4).alias("mean"), F.min("faithfulness").alias("least"), F.max("faithfulness").alias("most"))


def scores_by_group(traces: DataFrame) -> DataFrame:
    """Means for each band of the score."""
    band = F.when(F.col("faithfulness") >= 0.7, "good").when(F.col("faithfulness") >= 0.5, "fair").when(F.col("faithfulness").isNotNull(), "poor").otherwise("none")
    return traces.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("total_ms"), 4).alias("mean_ms"))


def breaker_step(state: tuple[int, float, str] | None, at: float, empty: bool, trip: int, limit: float) -> tuple[int, float, str]:
    """(empty results running, start of the run, ok | empty | timeout) after one more result; a run that has tripped stays so."""
    streak, start, reason = state or (0, at, "ok")
    streak = streak + 1 if empty else 0
    if reason == "ok":
        reason = "empty" if streak >= trip else "timeout" if at - start > limit else "ok"
    return streak, start, reason


def seconds_of(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def failure_streaks(results: DataFrame, trip: int = 2, limit: float = 30.0) -> DataFrame:
    """results (run_id, result_id, ts, n_hits) -> run_id, result_id, streak, state: a circuit breaker for each run, which trips on `trip` empty
    results one after the other, or when `limit` seconds have gone by since its first result. A null n_hits is none."""

    def step(state, row):
        state = breaker_step(state, row.at, row.empty, trip, limit)
        return state, (state[0], state[2])

    r = results.select("run_id", "result_id", "ts", seconds_of("ts").alias("at"), (F.coalesce("n_hits", F.lit(0)) == 0).alias("empty"))
    return fold_rows(r, "run_id", ["ts", "result_id"], step, "streak int, state string").select("run_id", "result_id", "streak", "state")


def cooldown_step(last: float | None, at: float, seconds: float) -> tuple[float, bool]:
    """(time of the last allowed request, whether this one is): refused requests do not put the next one off."""
    return (at, True) if last is None or at - last >= seconds else (last, False)


def cooldown(requests: DataFrame, seconds: float = 60.0) -> DataFrame:
    """requests (user_id, request_id, ts) -> user_id, request_id, allowed: one in `seconds` for each user, counted from the last allowed one."""
    r = requests.select("user_id", "request_id", "ts", seconds_of("ts").alias("at"))

    def step(last, row):
        last, fine = cooldown_step(last, row.at, seconds)
        return last, (fine,)

    return fold_rows(r, "user_id", ["ts", "request_id"], step, "allowed boolean").select("user_id", "request_id", "allowed")


def apply_ingest_status(docs: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Latest callback of each known document; a null status is failed."""
    latest = callbacks.groupBy("doc_id").agg(F.max_by(F.struct(F.coalesce("status", F.lit("failed")).alias("status")), "ts").alias("x"))
    return docs.select("doc_id").join(latest, "doc_id").select("doc_id", F.col("x.status").alias("status"))
