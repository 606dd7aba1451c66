"""Folds over ordered rows of a key, where what a row becomes depends on a running state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions import text as tx


def fold_rows(df: DataFrame, key: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Rows of each key in order, each with what `step(state, row) -> (state, value)` says; state is None at a key's first row.

    `schema` is that of the added columns, of which value is a tuple. Rows are sorted within partitions and streamed past, so a key of any
    length needs the memory of one batch only. Null keys are one key; columns of the same name as the added ones are replaced."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    df = df.drop(*names)
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, object()
        for b in batches:
            values = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k
                state, value = step(None if k != last else state, row)
                values.append(value)
                last = k
            yield b.assign(**{n: [v[i] for v in values] for i, n in enumerate(names)})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


# Chunks


def merge_short(chunks: DataFrame, target: int = 300, least: int = 50) -> DataFrame:
    """chunks (doc_id, chunk_index, kind, content; title, start_page, end_page if there) -> doc_id, new_index, chunk_id, content, n_merged,
    tokens, and those of title, start_page and end_page that there are: the first chunk's title and page, the last one's end page.

    A text chunk under `target` tokens takes the text chunks after it as long as they fit (joined by a blank line), and one that doesn't
    fit if it is still under `least` itself. Any other kind ends the run and stays as it is. A null kind is text, a null content is empty, null documents are one."""

    def step(state, row):
        group, chars, is_open = state or (-1, 0, False)
        tokens = lambda n: max(1, n // 2)
        if is_open and row.kind == "text":
            joined = chars + 2 + row.n
            if tokens(joined) <= target or tokens(chars) < least:
                return (group, joined, tokens(joined) < target), (group,)
        return (group + 1, row.n, row.kind == "text" and tokens(row.n) < target), (group + 1,)

    more = [c for c in ("title", "start_page", "end_page") if c in chunks.columns]
    c = chunks.select("doc_id", "chunk_index", F.coalesce("kind", F.lit("text")).alias("kind"), F.coalesce("content", F.lit("")).alias("content"), *more).withColumn("n", F.length("content"))
    groups = fold_rows(c, "doc_id", ["chunk_index"], step, "new_index int")
    m = groups.groupBy("doc_id", "new_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content", *more))).alias("r"))
    content = F.array_join(F.transform("r", lambda x: x.content), "\n\n")
    ends = [F.element_at("r", -1 if name == "end_page" else 1)[name].alias(name) for name in more]
    merged = m.select("doc_id", "new_index", tx.chunk_id(F.col("doc_id"), F.col("new_index")).alias("chunk_id"), content.alias("content"), F.size("r").alias("n_merged"), *ends)
    return merged.withColumn("tokens", tx.estimate_tokens(F.col("content")))


#: Where a text may be cut, in this order (fixed values).
SEPARATORS = ["\n", "。", "！", "？", ".", "!", "?", "；", ";"]


def child_pieces(text: str, target: int, least: int) -> list[str]:
    """A text in pieces of about `target` tokens (characters div 2): cut at the first separator that gives several parts, then put together
    again while they fit."""
    tokens = lambda s: max(1, len(s) // 2)
    done, waiting = [], [text]
    while waiting:
        t = waiting.pop()
        if tokens(t) <= target or not t.strip():
            done.append(t)
            continue
        for sep in SEPARATORS:
            head, *rest = t.split(sep)
            cut = [x for x in ([head + sep] + [x + sep for x in rest[:-1]] + rest[-1:] if rest else [t]) if x.strip()]
            if len(cut) > 1:
                waiting += reversed(cut)
                break
        else:
            done += [t[i : i + 2 * target] for i in range(0, len(t), 2 * target) if i == 0 or t[i : i + 2 * target].strip() or len(t) - i >= 2 * target]
    merged: list[str] = []
    open_piece = None
    for x in done:
        if open_piece is None:
            open_piece = x
        elif tokens(open_piece + "\n" + x) <= target or tokens(open_piece) < least:
            open_piece += "\n" + x
        else:
            merged.append(open_piece)
            open_piece = x
    if open_piece is not None and open_piece.strip():
        if merged and tokens(open_piece) < least:
            merged[-1] += "\n" + open_piece
        else:
            merged.append(open_piece)
    return merged


def split_children(parents: DataFrame, target: int = 150, least: int = 40) -> DataFrame:
    """parents (parent_id, kind, heading, content) -> parent_id, child_index, n_children, content, tokens.

    Texts are cut into children, with "heading | " before those that don't hold the heading; other kinds are their own child. A null or
    blank text has none."""

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return text.map(lambda s: child_pieces(s, target, least) if s else [])

    parts = F.when(F.coalesce("kind", F.lit("text")) == "text", pieces("content")).otherwise(F.array("content"))
    p = parents.withColumn("parts", parts).select("parent_id", "kind", "heading", F.size("parts").alias("n_children"), F.posexplode("parts").alias("child_index", "child"))
    bare = (F.coalesce("kind", F.lit("text")) != "text") | (F.coalesce("heading", F.lit("")) == "") | F.contains("child", "heading")
    content = F.when(bare, F.col("child")).otherwise(F.concat("heading", F.lit(" | "), "child"))
    return p.select("parent_id", "child_index", "n_children", content.alias("content")).withColumn("tokens", tx.estimate_tokens(F.col("content")))


# Limits and caches


def take(state: tuple[float, float] | None, at: float, n: float, capacity: float, rate: float) -> tuple[tuple[float, float], tuple[bool, float]]:
    """One request of n tokens at a time against (tokens, last time); an event before the last one finds no time passed."""
    tokens, last = state or (capacity, at)
    tokens = min(capacity, tokens + max(at - last, 0.0) * rate)
    if tokens >= n:
        return (tokens - n, max(at, last)), (True, 0.0)
    return (tokens, max(at, last)), (False, max(1.0, (n - tokens) / rate))


def rate_limit(requests: DataFrame, capacity: float = 30.0, rate: float = 1.0) -> DataFrame:
    """requests (key, ts, request_id, n) -> request_id, allowed, retry_after seconds: a token bucket for each key, full at first."""
    r = requests.select("key", "ts", "request_id", F.col("n").cast("double").alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return fold_rows(r, "key", ["ts", "request_id"], lambda s, x: take(s, x.at, x.n, capacity, rate), "allowed boolean, retry_after double").select("request_id", "allowed", "retry_after")


def cache_lookup(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """queries (query_id, key, ts), entries (key, cached_at, ttl seconds, answer) -> query_id, answer: that of the key's latest entry at ts,
    if younger than its ttl, else null. Later entries of a key replace earlier ones; of entries at one time the greatest answer counts."""
    e = entries.select("key", F.col("cached_at").alias("ts"), F.lit(0).alias("is_query"), F.lit(None).cast("long").alias("query_id"), F.struct(F.col("cached_at").alias("at"), "ttl", "answer").alias("entry"))
    q = queries.select("key", "ts", F.lit(1).alias("is_query"), "query_id", F.lit(None).cast(e.schema["entry"].dataType).alias("entry"))
    past = Window.partitionBy("key").orderBy("ts", "is_query", "entry.answer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    found = e.unionByName(q).withColumn("entry", F.last("entry", ignorenulls=True).over(past)).filter("is_query = 1")
    fresh = F.col("key").isNotNull() & (seconds("ts") < seconds("entry.at") + F.col("entry.ttl"))
    return found.select("query_id", F.when(fresh, F.col("entry.answer")).alias("answer"))


def feedback_join(ratings: DataFrame, traces: DataFrame, stored: DataFrame, within: str = "600 seconds") -> DataFrame:
    """ratings (trace_id, rated_at, rating), traces (trace_id, ts), stored (trace_id) -> trace_id, rating, outcome: cached where the trace is at
    most `within` older than the rating, stored where only the stored table knows it, else error.

    On streams give `ratings` and `traces` watermarks; `stored` is a table. Its ids must be distinct."""
    t = traces.select(F.col("trace_id").alias("seen"), F.col("ts").alias("seen_at"))
    near = (F.col("trace_id") == F.col("seen")) & (F.col("rated_at") >= F.col("seen_at")) & (F.col("rated_at") <= F.col("seen_at") + F.expr(f"interval {within}"))
    known = stored.select(F.col("trace_id").alias("kept"))
    j = ratings.join(t, near, "left").join(known, F.col("trace_id") == F.col("kept"), "left")
    return j.select("trace_id", "rating", F.when(F.col("seen").isNotNull(), "cached").when(F.col("kept").isNotNull(), "stored").otherwise("error").alias("outcome"))


# Answers of models


def validate_titles(items: DataFrame, titles: DataFrame) -> DataFrame:
    """items (doc_id, index, level, heading, n_entities) that a model gave for titles (doc_id, index): all items of a document, or none where
    one of them has an unknown index, a level outside 1 to 6, a heading that isn't 1 to 100 characters long, or over five entities."""
    fine = F.col("level").between(1, 6) & F.length("heading").between(1, 100) & (F.coalesce("n_entities", F.lit(0)) <= 5)
    known = titles.select("doc_id", "index").distinct().withColumn("known", F.lit(True))
    j = items.join(known, ["doc_id", "index"], "left").withColumn("good", F.coalesce(fine & F.col("known"), F.lit(False)))
    bad = j.filter("not good").select("doc_id").distinct()
    return items.join(bad, "doc_id", "left_anti")


def assign_kb(results: DataFrame) -> DataFrame:
    """results (doc_id, kb_id as submitted, action, new_kb_name, found_kb_id, supersedes; all from the model may be null) -> doc_id, action,
    target_kb_id, new_kb_name, supersedes."""
    create = F.coalesce(F.col("action") == "create", F.lit(False))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return results.select(
        "doc_id", F.when(create, "create").otherwise("existing").alias("action"), F.when(~create, F.coalesce(filled("found_kb_id"), "kb_id")).alias("target_kb_id"),
        F.when(create, F.coalesce("new_kb_name", F.lit("未命名知识库"))).alias("new_kb_name"), filled("supersedes").alias("supersedes"),
    )


def rerank_udf(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """hits (query_id, chunk_id, query, content) with the score of a function over (queries, contents) in batches, and rank by it."""
    scorer = F.pandas_udf(score, "double")
    scored = hits.withColumn("score", scorer("query", "content"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "chunk_id")))


def embed(df: DataFrame, function: Callable[[list[str]], list], column: str = "content", batch: int = 10) -> DataFrame:
    """df with `embedding` (array<double>): the function gets lists of up to `batch` texts, null texts as empty ones."""

    @F.pandas_udf("array<double>")
    def vectors(text: pd.Series) -> pd.Series:
        values = text.fillna("").tolist()
        return pd.Series([v for i in range(0, len(values), batch) for v in function(values[i : i + batch])])

    return df.withColumn("embedding", vectors(column))
