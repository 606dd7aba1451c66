"""Evaluation runs, traces and ratings; choice, re-ranking and context of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.sources.tables import materialize

#: Words by which an answer refuses.
REFUSALS = ["未找到", "没有", "不包含", "无法提供", "不在", "抱歉"]


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def metrics_long(run: DataFrame, metrics: list[str]) -> DataFrame:
    return run.select("id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics))).alias("x")).select("id", "x.*")


def compare_runs(a: DataFrame, b: DataFrame, metrics: list[str], band: float = 0.02) -> DataFrame:
    """Means of each metric in both runs (a missing one is 0) and whether b improved, regressed or is stable."""
    mean = lambda run, name: metrics_long(run, metrics).groupBy("metric").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias(name))
    j = mean(a, "a").join(mean(b, "b"), "metric", "full").na.fill(0.0)
    diff = F.round(F.col("b") - F.col("a"), 4)
    return j.select("metric", "a", "b", diff.alias("diff"), F.when(diff > band, "improved").when(diff < -band, "regressed").otherwise("stable").alias("verdict"))


def sample_regressions(a: DataFrame, b: DataFrame, metrics: list[str], least: float = 0.05) -> DataFrame:
    """Samples of both runs whose score of a metric (missing: 0) moved by more than `least`."""
    x = metrics_long(a, metrics).withColumnRenamed("score", "a")
    y = metrics_long(b, metrics).withColumnRenamed("score", "b")
    diff = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4)
    return x.join(y, ["id", "metric"]).select("id", "metric", diff.alias("diff")).filter(F.abs("diff") > least)


def refused(answer: Column) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) == "") | contains_any(F.lower(answer), REFUSALS)


def eval_summary(run: DataFrame) -> DataFrame:
    """Totals, the split, mean scores of positives, refusals of negatives, and latency sums divided by all rows."""
    neg = F.col("category") == "negative"
    n = F.greatest(F.count("*"), F.lit(1))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(~neg, F.col(c))), F.lit(0.0)), 4)
    return run.agg(F.count("*").alias("total"), F.count_if(~neg).alias("positive"), F.count_if(neg).alias("negative"), mean("faithfulness").alias("faithfulness"), mean("answer_relevance").alias("answer_relevance"), F.count_if(neg & refused(F.col("answer"))).alias("neg_refused"), F.count_if(neg & ~refused(F.col("answer"))).alias("neg_hallucinated"), F.round(F.coalesce(F.sum("first_token_ms"), F.lit(0.0)) / n, 4).alias("first_token_ms"), F.round(F.coalesce(F.sum("total_ms"), F.lit(0.0)) / n, 4).alias("total_ms"))


def rating_band(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def span_stats(spans: DataFrame, nodes: list[str]) -> DataFrame:
    return spans.filter(F.col("node").isin(nodes)).groupBy("node").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"))


def diagnose(run: DataFrame) -> DataFrame:
    """One row for each issue found, or the row none."""
    neg = F.col("category") == "negative"
    s = run.agg(F.avg(F.when(~neg, F.coalesce("faithfulness", F.lit(0.0)))).alias("f"), F.avg(F.when(~neg, F.coalesce("answer_relevance", F.lit(0.0)))).alias("r"), F.count_if(neg).alias("n"), F.count_if(neg & ~refused(F.col("answer"))).alias("h"), F.count_if(F.col("n_hits") == 0).alias("z"))
    issues = F.filter(F.array(F.when(F.col("f") < 0.5, "low_faithfulness"), F.when(F.col("r") < 0.5, "low_relevance"), F.when(F.col("h") > F.col("n") * 0.3, "hallucination"), F.when(F.col("z") > 0, "zero_recall")), lambda x: x.isNotNull())
    return s.select(F.explode(F.when(F.size(issues) > 0, issues).otherwise(F.array(F.lit("none")))).alias("issue"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth and path of the spans that hang on a root, at any depth; other orphans (and cycles) are dropped. Each span knows a stretch of its
    path up to some ancestor; stretches double with each join, and each round is written to the shared folder."""
    s = spans.select("trace_id", "span_id", "parent_id", "node")
    root = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("trace_id").cast("string"))
    s = materialize(s.select("trace_id", "span_id", F.when(~root, F.col("parent_id")).alias("up"), F.when(root, 0).otherwise(1).alias("depth"), F.col("node").alias("path")))
    left = s.filter("up is not null").count()
    while left:
        above = s.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("head"))
        j = s.filter("up is not null").join(above, ["trace_id", "up"])  # a span whose parent is missing goes
        step = j.select("trace_id", "span_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("head", F.lit("/"), "path").alias("path"))
        s = materialize(s.filter("up is null").unionByName(step))
        now = s.filter("up is not null").agg(F.count("*").alias("n"), F.max("depth").alias("deep")).first()
        if not now["n"] or now["deep"] > s.count():  # deeper than there are spans: a cycle
            break
    return s.filter("up is null").select("trace_id", "span_id", "depth", "path")


def apply_ratings(traces: DataFrame, ratings: DataFrame) -> DataFrame:
    """The latest rating of each trace beside it."""
    last = ratings.groupBy("trace_id").agg(F.max_by("rating", "ts").alias("rating"))
    return traces.select("trace_id", "source").join(last, "trace_id", "left")


def sample_traces(traces: DataFrame, percent: int = 5) -> DataFrame:
    """The same traces each time: by a hash of the id (the operator's own feature is to sample)."""
    return traces.filter(F.crc32(F.col("trace_id").cast("string")) % 100 < percent)


def rerank(hits: DataFrame, scores: DataFrame, n: int, missing: float = 0.5) -> DataFrame:
    """Queries with at most n hits stay as they are; of others the n best by the given scores stay."""
    many = F.count("*").over(Window.partitionBy("query_id")) > n
    j = hits.select("query_id", "chunk_id", "score").withColumn("many", many).join(scores.select("query_id", "chunk_id", F.col("score").alias("new")), ["query_id", "chunk_id"], "left")
    j = j.withColumn("score", F.when(F.col("many"), F.coalesce("new", F.lit(missing))).otherwise(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return j.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "chunk_id", "score", "rank")


def min_score(queries: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """Hits kept and filtered for each query."""
    g = hits.groupBy("query_id").agg(F.count_if(F.col("score") >= least).alias("kept"), F.count_if(F.col("score") < least).alias("filtered"))
    return queries.select("query_id").join(g, "query_id", "left").na.fill(0)


def version_conflicts(hits: DataFrame, top: int = 5) -> DataFrame:
    """Sources with two or more effective dates among a query's first hits."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    h = hits.withColumn("__n", rank).filter(F.col("__n") <= top)
    return h.groupBy("query_id", "kb_id").agg(F.countDistinct("effective_date").alias("n"), F.min("effective_date").alias("oldest"), F.max("effective_date").alias("newest")).filter("n >= 2")


def context_text(hits: DataFrame) -> DataFrame:
    """Numbered blocks of a query's hits in order of rank."""
    block = F.concat(F.lit("["), "rank", F.lit("] "), "source_file", F.lit("\n"), "chunk_text")
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda r: r.b), "\n\n").alias("context"))


def scored_context(hits: DataFrame) -> DataFrame:
    """Numbered blocks with source and score (two places); a query without hits has no row."""
    block = F.format_string("[%d] 来源: %s (相关度: %.2f)\n%s\n", F.col("rank"), F.col("source_file"), F.col("score"), F.col("chunk_text"))
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda r: r.b), "\n---\n").alias("context"))


def budget_context(hits: DataFrame, budget: int, cut: int = 300, most: int = 3) -> DataFrame:
    """A query's first hits, cut, up to the first that would pass the budget of characters."""
    h = hits.filter(F.col("rank") <= most).withColumn("n", F.least(F.length("chunk_text"), F.lit(cut)))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return h.withColumn("upto", upto).filter(F.col("upto") <= budget).select("query_id", "chunk_id", "rank", "upto")


def grouped_context(hits: DataFrame, subs: DataFrame, budget: int, most: int = 3, cut: int = 300, whole: int = 2000) -> DataFrame:
    """hits (query_id, sub_id, rank, chunk_id, source_file, score, content, has_parent), subs (query_id, sub_id): the sub-queries of each query,
    with hits or without -> query_id, sub_id, chunk_id, rank, entry, upto.

    The budget of characters is shared out evenly over a query's sub-queries. Each takes its first `most` hits, cut to `cut` characters, or to
    `whole` where the content is a parent's, and stops at the first entry that its share has no room for. Nulls: no parent, empty content."""
    share = subs.select("query_id", "sub_id").distinct().groupBy("query_id").agg(F.floor(F.lit(budget) / F.count("*")).alias("share"))
    body = F.substring(F.coalesce("content", F.lit("")), F.lit(1), F.when(F.coalesce("has_parent", F.lit(False)), whole).otherwise(cut))
    score = F.col("score").cast("decimal(18,6)").cast("decimal(18,2)").cast("string")
    h = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "sub_id").orderBy("rank", "chunk_id"))).filter(F.col("place") <= most)
    h = h.withColumn("entry", F.concat(F.lit("[来源: "), F.coalesce("source_file", F.lit("")), F.lit(" (相关度: "), score, F.lit(")]\n"), body, F.lit("\n")))
    upto = F.sum(F.length("entry")).over(Window.partitionBy("query_id", "sub_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return h.withColumn("upto", upto).join(share, "query_id").filter("upto <= share").select("query_id", "sub_id", "chunk_id", "rank", "entry", "upto")


def summary_due(messages: DataFrame, trigger: int, window: int = 20) -> DataFrame:
    """Conversations of more than `trigger` rounds, and how many of their last 2 * window messages lie before the last `window`."""
    g = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    over = F.least(F.greatest(F.col("n") - window, F.lit(0)), F.lit(window))
    return g.filter(F.floor(F.col("n") / 2) > trigger).select("conv_id", F.floor(F.col("n") / 2).alias("rounds"), over.cast("long").alias("overflow"))


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences up to their end mark, without white space around them; one shorter than `least` takes those that follow."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.regexp_extract_all(text, F.lit(r"[^。！？.!?\n]+[。！？.!?\n]?"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    fold = lambda a, s: F.when(a.cur == "", F.struct(a.out.alias("out"), s.alias("cur"))).when(F.length(a.cur) < least, F.struct(a.out.alias("out"), F.concat(a.cur, s).alias("cur"))).otherwise(F.struct(F.concat(a.out, F.array(strip(a.cur))).alias("out"), s.alias("cur")))
    return F.aggregate(parts, start, fold, lambda a: F.when(a.cur == "", a.out).otherwise(F.concat(a.out, F.array(strip(a.cur)))))
