"""Whole traces of searches, scores of judges on them, times of spans, and what is due to a conversation's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators import evaluation

#: Spans that are summed up by name (fixed values).
NODES = ["hybrid_search", "reranker", "query_planner", "llm_generation", "judge"]
#: What a judge sets on a trace, all at once.
JUDGED = ["faithfulness", "answer_relevance", "context_relevance", "judge_model", "judge_latency_ms"]
#: What a trace says of its times.
TIMES = ["hybrid_ms", "rerank_ms", "planner_ms", "total_ms"]


def full_traces(queries: DataFrame, hits: DataFrame, timings: DataFrame, recall: DataFrame, responses: DataFrame, most: int = 10, snippet: int = 150, response: int = 500) -> DataFrame:
    """queries (query_id, query, rewritten, intent, n_subs), hits (query_id, rank, chunk_id, doc_id, source_file, score, chunk_text), timings
    (query_id and TIMES), recall (query_id, dense_hits, keyword_hits), responses (query_id, response) -> one row a query: query_id,
    original_query, rewritten_query, retrieval_path, n_sub_queries, top_k, TIMES, dense_hits, keyword_hits, chunks, response.

    The path of a complex question is dag, and only it has a number of sub-queries. Missing times and counts are 0, an empty rewriting is the
    query, chunks are the first `most` hits with scores of four places. Each table has a row for each query at most."""
    line = F.struct("rank", "chunk_id", "doc_id", "source_file", tx.round_places(F.col("score"), 4).alias("score"), F.substring(F.coalesce("chunk_text", F.lit("")), 1, snippet).alias("snippet"))
    h = hits.groupBy("query_id").agg(F.count("*").alias("top_k"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, line))).alias("chunks"))
    q = queries.select("query_id", "query", "rewritten", "intent", "n_subs").join(h, "query_id", "left")
    q = q.join(timings.select("query_id", *TIMES), "query_id", "left").join(recall.select("query_id", "dense_hits", "keyword_hits"), "query_id", "left")
    q = q.join(responses.select("query_id", "response"), "query_id", "left")
    dag = F.coalesce(F.col("intent") == "complex", F.lit(False))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return q.select(
        "query_id", F.coalesce("query", F.lit("")).alias("original_query"), F.coalesce(F.when(F.col("rewritten") != "", F.col("rewritten")), "query", F.lit("")).alias("rewritten_query"),
        F.when(dag, "dag").otherwise("simple").alias("retrieval_path"), F.when(dag, F.coalesce("n_subs", F.lit(0))).cast("long").alias("n_sub_queries"), count("top_k"),
        *map(count, TIMES), count("dense_hits"), count("keyword_hits"), "chunks", F.substring(F.coalesce("response", F.lit("")), 1, response).alias("response"),
    )


def apply_judge(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """traces with the columns JUDGED of the latest of scores (trace_id, ts and JUDGED), all from one row; of rows at one time the greatest
    counts. Traces that weren't judged keep nulls, columns of these names in traces are replaced."""
    last = scores.groupBy("trace_id").agg(F.max(F.struct("ts", *JUDGED)).alias("last")).select("trace_id", *(F.col(f"last.{c}") for c in JUDGED))
    return traces.drop(*JUDGED).join(last, "trace_id", "left")


def missing_ids(traces: DataFrame, updates: DataFrame) -> DataFrame:
    """Ids that updates name and traces don't have."""
    return updates.select("trace_id").distinct().join(traces.select("trace_id"), "trace_id", "left_anti")


def judge_dimensions(run: DataFrame, dimensions: list[str]) -> DataFrame:
    """run (id and dimensions) -> metric, n, mean, least, most of four places; nulls are skipped, and a dimension without scores has none."""
    g = evaluation.metrics_long(run, dimensions).groupBy("metric")
    return g.agg(F.count("score").alias("n"), *(F.round(f("score"), 4).alias(name) for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))))


def span_durations(spans: DataFrame) -> DataFrame:
    """spans (trace_id, span_id, parent_id, node, start_time, end_time) -> trace_id, span_id, depth, path, duration_ms: the spans of
    `span_tree` with their whole milliseconds, 0 where a time is missing. Of a repeated span the longest counts."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ms = ((micros("end_time") - micros("start_time")) / 1000).cast("long")
    d = spans.groupBy("trace_id", "span_id").agg(F.max(F.coalesce(ms, F.lit(0))).alias("duration_ms"))
    return evaluation.span_tree(spans).join(d, ["trace_id", "span_id"])


def summary_action(messages: DataFrame, summaries: DataFrame, trigger: int, limit: int, window: int = 20) -> DataFrame:
    """messages (conv_id, ..), summaries (conv_id, summary) -> conv_id, overflow, action.

    Conversations of more than `trigger` rounds: update where some of the last 2 * window messages lie before the last `window`, else
    compress where the summary has `limit` tokens or more, else none."""
    due = evaluation.summary_due(messages, trigger, window).select("conv_id", "overflow").join(summaries.select("conv_id", "summary"), "conv_id", "left")
    long = (F.coalesce("summary", F.lit("")) != "") & (tx.estimate_tokens(F.col("summary")) >= limit)
    return due.select("conv_id", "overflow", F.when(F.col("overflow") > 0, "update").when(long, "compress").otherwise("none").alias("action"))
