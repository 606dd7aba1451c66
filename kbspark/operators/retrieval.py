"""Keyword and vector retrieval, fusion, de-duplication and filters over tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions import words
from kbspark.functions.text import terms
from kbspark.operators import keyword_scan, vector_scan, windows
from kbspark.sources.tables import materialize


def top(df: DataFrame, k: int | str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks by score, then chunk_id, and keeps k (a number or a column)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "chunk_id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= (F.col(k) if isinstance(k, str) else F.lit(k)))


def postings(chunks: DataFrame) -> DataFrame:
    return postings_by_chunk(chunks, False)


def postings_with_positions(chunks: DataFrame) -> DataFrame:
    """Postings with the places (from 0, among a chunk's terms) of each term."""
    return postings_by_chunk(chunks, True).select("chunk_id", "term", "positions", "tf")


def postings_by_chunk(chunks: DataFrame, positions: bool) -> DataFrame:
    """Postings (chunk_id, term, tf, and positions if asked for) of the texts as they are read, so no posting is shuffled and those of a chunk stay
    together. Only hashes of chunk_id are shuffled, to find those that several rows have, and then the postings of these."""
    c = chunks.filter("chunk_text is not null").select("chunk_id", "chunk_text", F.xxhash64("chunk_id").alias("ref"))
    twice = materialize(c.groupBy("ref").agg(F.count("*").alias("n")).filter("n > 1").select("ref"))
    n, kinds = twice.count(), words.kinds(chunks.sparkSession)
    few = F.broadcast(twice) if n <= 200_000 else twice

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in windows.pieces(batch, "w")):
            row, term, begin, places = words.postings_of(words.terms_of(part.column("w"), kinds))
            columns = [part.column("chunk_id").take(pa.array(row)), term, pa.array(np.diff(begin))]
            if positions:
                columns.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(places, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "term", "tf", "positions"][: len(columns)])

    alone = c.join(few, "ref", "left_anti") if n else c
    kind = c.schema["chunk_id"].dataType.simpleString()
    found = alone.select("chunk_id", F.lower("chunk_text").alias("w")).mapInArrow(read, f"chunk_id {kind}, term string, tf long" + ", positions array<int>" * positions)
    if not n:
        return found
    t = c.join(few, "ref", "left_semi").select("chunk_id", F.posexplode(terms(F.col("chunk_text"))).alias("place", "term"))
    both = [F.count("*").alias("tf"), *([F.sort_array(F.collect_list("place")).alias("positions")] if positions else [])]
    return found.unionByName(t.groupBy("chunk_id", "term").agg(*both))


def query_terms(queries: DataFrame, most: int = 30) -> DataFrame:
    return queries.select("query_id", F.explode(F.slice(F.array_distinct(terms(F.col("query"))), 1, most)).alias("term"))


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int | str = 30, k1: float = 1.2, b: float = 0.75, most_terms: int = 200_000) -> DataFrame:
    """BM25 over the chunks that match any term, without an index. k is a number, or a column of queries.

    Up to `most_terms` terms of queries go to the tasks, which read the texts twice and shuffle the best of each query only; with more, the
    terms meet the postings in a join. For more than one search over the same chunks see keyword_index."""
    text = F.coalesce("chunk_text", F.lit(""))
    wanted = query_terms(queries)
    limited = with_limit(wanted, queries, k).select("query_id", "term", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("long").alias("limit")).filter("limit > 0")
    some = limited.limit(most_terms + 1).toPandas()
    if len(some) > most_terms:
        return joined_search(queries, chunks.select("chunk_id", terms(text).alias("w")), wanted, k, k1, b)
    kinds = words.kinds(queries.sparkSession) if len(some) else None
    found = keyword_scan.best_chunks(chunks.select("chunk_id", F.lower(text).alias("w")), some, k1, b, lambda x: words.terms_of(x, kinds)) if len(some) else queries.sparkSession.createDataFrame([], "query_id long, chunk_id string, score double")
    return top(with_limit(found, queries, k), k).select("query_id", "chunk_id", "score", "rank")


def joined_search(queries: DataFrame, words: DataFrame, wanted: DataFrame, k: int | str, k1: float, b: float) -> DataFrame:
    """keyword_search for any number of queries: words (chunk_id, w), wanted (query_id, term)."""
    w = words.withColumn("l", F.size("w")).filter("l > 0")
    stats = w.agg(F.count("*").alias("n"), F.avg("l").alias("mean"))
    hit = w.select("chunk_id", "l", F.explode("w").alias("term")).join(wanted.select("term").distinct(), "term").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("l").alias("l"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    m = wanted.join(df, "term").join(hit, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("l") / F.col("mean")))
    scored = m.groupBy("query_id", "chunk_id").agg(F.round(F.sum(s), 6).alias("score"))
    return top(with_limit(scored, queries, k), k).select("query_id", "chunk_id", "score", "rank")


def with_limit(scored: DataFrame, queries: DataFrame, k: int | str) -> DataFrame:
    return scored.join(queries.select("query_id", k), "query_id") if isinstance(k, str) else scored


def dense_search(queries: DataFrame, vectors: DataFrame, k: int | str = 30, query_rows: int = 4096, vector_rows: int = 50_000) -> DataFrame:
    """Exact cosine search. k is a number, or a column of queries. Up to `query_rows` queries go to the tasks, which read the vectors once and
    shuffle the best of each query only; with more, blocks of queries meet blocks of vectors."""
    limited = queries.select("query_id", "embedding", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("long").alias("limit")).filter("limit > 0 and embedding is not null")
    some = limited.limit(query_rows + 1).toPandas()
    if len(some) > query_rows:
        return dense_blocks(queries, vectors, k, query_rows, vector_rows)
    found = vector_scan.best_vectors(vectors, some) if len(some) else queries.sparkSession.createDataFrame([], "query_id long, chunk_id string, score double")
    return top(with_limit(found, queries, k), k).select("query_id", "chunk_id", "score", "rank")


def dense_blocks(queries: DataFrame, vectors: DataFrame, k: int | str, query_rows: int, vector_rows: int) -> DataFrame:
    """dense_search for any number of queries. Queries and vectors are dealt out by hash in blocks of a bounded size; a task multiplies two
    blocks and keeps the best of each query, and ranks merge them."""
    blocks, shards = max(1, -(-queries.count() // query_rows)), max(1, -(-vectors.count() // vector_rows))
    most = k if isinstance(k, int) else queries.agg(F.max(k)).first()[0] or 0
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "embedding").withColumn("block", deal("query_id", blocks)).withColumn("shard", every(shards))
    v = vectors.select("chunk_id", "embedding").withColumn("shard", deal("chunk_id", shards)).withColumn("block", every(blocks))

    def unit(rows: pd.Series) -> np.ndarray:
        return vector_scan.unit(np.stack(rows.to_list()).astype(float))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        b = b.sort_values("chunk_id", kind="stable")
        s = np.round(unit(a["embedding"]) @ unit(b["embedding"]).T, 6)
        at = np.argsort(-s, axis=1, kind="stable")[:, :most]
        return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), at.shape[1]), "chunk_id": b["chunk_id"].to_numpy()[at.ravel()], "score": np.take_along_axis(s, at, 1).ravel()})

    out = q.groupBy("shard", "block").cogroup(v.groupBy("shard", "block")).applyInPandas(best, "query_id long, chunk_id string, score double")
    return top(with_limit(out, queries, k), k).select("query_id", "chunk_id", "score", "rank")


def rrf(lists: list[DataFrame], k: int = 60, final: int = 30) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    u = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        u = u.unionByName(x.select("query_id", "chunk_id", "rank"))
    g = u.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_lists"))
    return top(g, final)


def first_of_each(hits: DataFrame, by: list[str]) -> DataFrame:
    """The best hit for each key within a query: merge by chunk, equal content, parents."""
    rank = F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.col("score").desc(), "chunk_id"))
    return hits.withColumn("__n", rank).filter("__n = 1").drop("__n")


def dedup_content(hits: DataFrame, prefix: int = 300) -> DataFrame:
    return first_of_each(hits.withColumn("__c", F.trim(F.substring("chunk_text", 1, prefix))), ["__c"]).drop("__c")


def cap_per_doc(hits: DataFrame, most: int = 3) -> DataFrame:
    return top(hits, most, ("query_id", "doc_id")).drop("rank")


def merge_adjacent(hits: DataFrame) -> DataFrame:
    """Runs of neighbouring chunks of one document as one hit: joined text, mean score, first id."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index")
    runs = hits.withColumn("run", F.col("chunk_index") - F.row_number().over(w))
    g = runs.groupBy("query_id", "doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "chunk_text"))).alias("x"), F.round(F.avg("score"), 9).alias("score"))
    return g.select("query_id", "doc_id", F.col("x")[0]["chunk_id"].alias("chunk_id"), F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda c: c.chunk_text), "\n").alias("content"), "score")


def quality_flags(queries: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("best") < least, F.lit(True)).alias("weak"))


def recall_stats(queries: DataFrame, dense: DataFrame, keyword: DataFrame) -> DataFrame:
    d, s = dense.select("query_id", "chunk_id", F.lit(1).alias("d")), keyword.select("query_id", "chunk_id", F.lit(1).alias("k"))
    j = d.join(s, ["query_id", "chunk_id"], "full").groupBy("query_id").agg(F.count("d").alias("dense_hits"), F.count("k").alias("keyword_hits"), F.count("*").alias("merged"), F.count_if(F.col("d").isNotNull() & F.col("k").isNotNull()).alias("overlap"))
    return queries.select("query_id").join(j, "query_id", "left").na.fill(0)


def temporal(hits: DataFrame, as_of: str, keep: str = "exclude") -> DataFrame:
    """Adds is_expired; keep is exclude, only or include."""
    expired = F.coalesce(F.col("expiry_date") < F.lit(as_of).cast("date"), F.lit(False))
    h = hits.withColumn("is_expired", expired)
    return h if keep == "include" else h.filter(F.col("is_expired") == (keep == "only"))


def hybrid_search(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, keyword: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Both lists of 3 * top_k hits a query, fused to 2 * top_k. keyword(queries, k) searches by terms, k being a column of queries. A query
    without terms and without a vector has no hits."""
    q = queries.withColumns({"k3": 3 * F.col("top_k"), "k2": 2 * F.col("top_k")})
    dense = dense_search(query_vectors.join(q.select("query_id", "k3"), "query_id"), vectors, "k3")
    fused = rrf([dense, keyword(q, "k3")], final=2**31 - 1)
    return fused.join(q.select("query_id", "k2"), "query_id").filter("rank <= k2").drop("k2")


def merge_lists(hits: DataFrame) -> DataFrame:
    """hits (query_id, list, rank, chunk_id, ..): the first occurrence of each chunk, by list and rank; place numbers what stays."""
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("list", "rank"))
    kept = hits.withColumn("__n", first).filter("__n = 1").drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank")))


def cap_total(merged: DataFrame, most: int = 30) -> DataFrame:
    return merged.filter(F.col("place") <= most)


def groups_of(merged: DataFrame) -> DataFrame:
    """For each query and list the chunks that it brought, in order."""
    g = merged.groupBy("query_id", "list").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("x"))
    return g.select("query_id", "list", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda h: h.chunk_id), ",").alias("chunk_ids"))


def dedup_pipeline(hits: DataFrame, queries: DataFrame, per_doc: int = 3) -> DataFrame:
    """Equal content once; where capping and merging leave 2 * top_k hits or more they are used, else the hits stay as they were."""
    one = dedup_content(hits)
    merged = merge_adjacent(cap_per_doc(one, per_doc)).select("query_id", "chunk_id", "score")
    enough = merged.groupBy("query_id").agg(F.count("*").alias("n")).join(queries.select("query_id", "top_k"), "query_id").filter("n >= 2 * top_k").select("query_id")
    return merged.join(enough, "query_id", "left_semi").unionByName(one.join(enough, "query_id", "left_anti").select("query_id", "chunk_id", "score"))


def resolve_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, parent_id, score, chunk_id): the best hit of each parent, with the parent's text; hits without one pass."""
    with_parent = first_of_each(hits.filter("parent_id is not null"), ["doc_id", "parent_id"]).join(parents, ["doc_id", "parent_id"], "left")
    rest = hits.filter("parent_id is null").withColumn("parent_text", F.lit(None).cast("string"))
    return with_parent.unionByName(rest.select(*with_parent.columns)).withColumn("content", F.coalesce("parent_text", "chunk_text")).select("query_id", "chunk_id", "content")


def doc_type(docs: DataFrame, wanted: str) -> DataFrame:
    """Rows whose doc_type begins with the wanted one, or whose file name has its extension; any passes all, and so does a type without one."""
    ends = {"manual": ".md", "specification": ".md", "policy": ".md", "report": ".docx", "guide": ".md"}.get(wanted, "")
    return docs if wanted in ("", "any") else docs.filter(F.coalesce(F.startswith("doc_type", F.lit(wanted)), F.lit(False)) | F.endswith("filename", F.lit(ends)))


def scope_kbs(requested: str, granted: str, key_scope: str):
    """Column: what is granted, narrowed by each of the others that isn't empty."""
    narrowed = lambda a, b: F.when(F.size(b) > 0, F.array_intersect(a, b)).otherwise(a)
    return F.array_sort(narrowed(narrowed(F.col(granted), F.col(requested)), F.col(key_scope)))


def rerank_chain(hits: DataFrame, scores: DataFrame, n: int, order: tuple[str, ...] = ("api", "cross_encoder", "llm")) -> DataFrame:
    """scores (query_id, chunk_id, source, score). A query is ranked by the first source that scored all of its hits, else cut as it is."""
    size = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    known = hits.select("query_id", "chunk_id").join(scores, ["query_id", "chunk_id"]).groupBy("query_id", "source").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    use = known.join(size, "query_id").filter((F.col("n") == F.col("n_hits")) & (place > 0)).groupBy("query_id").agg(F.min_by("source", place).alias("strategy"))
    h = hits.join(use, "query_id", "left").withColumn("strategy", F.coalesce("strategy", F.lit("truncation")))
    s = scores.select("query_id", "chunk_id", F.col("source").alias("strategy"), F.col("score").alias("new"))
    h = h.join(s, ["query_id", "chunk_id", "strategy"], "left").withColumn("score", F.coalesce("new", "score")).drop("new")
    return top(h, n).select("query_id", "chunk_id", "strategy", "score", "rank")


def critic_action(queries: DataFrame, hits: DataFrame, known: DataFrame, good: float = 0.5) -> DataFrame:
    """What to do next, from the mean of the three best scores and from whether the knowledge base knows the matter (query_id, known)."""
    best = top(hits, 3).groupBy("query_id").agg(F.avg("score").alias("mean"))
    j = queries.select("query_id").join(best, "query_id", "left").join(known, "query_id", "left")
    knows = F.coalesce("known", F.lit(False))
    action = F.when(F.col("mean").isNull() & ~knows, "not_in_kb").when(F.col("mean").isNull(), "ask_user").when(F.col("mean") >= good, "pass").when(~knows, "not_in_kb").otherwise("ask_user")
    return j.select("query_id", action.alias("action"))


def clamp(k, least: int = 1, most: int = 30):
    """Column k within bounds."""
    return F.least(F.greatest(k, F.lit(least)), F.lit(most)).cast("int")
