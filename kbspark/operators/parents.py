"""Parents packed from typed blocks, their children, and sub-queries searched at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions import questions as fq
from kbspark.functions import text as tx
from kbspark.operators import folds, retrieval
from kbspark.sources.tables import materialize

#: Layouts of text that is kept, and what stands for an image without words (fixed values).
KEPT = ["title", "text", "equation"]
NO_WORDS = "[图片]"
CAPTION = "[图片说明: %s]"


def block_content(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_idx, kind, layout_type, text; html, caption, page_num if there) with what each adds to a parent, as content.

    A table gives its text and html, an image its text and caption. A null kind or layout is text, a null text is empty."""
    has = lambda c, kind: F.col(c).cast(kind) if c in blocks.columns else F.lit(None).cast(kind)
    filled = lambda c: F.when(c != "", c)
    text, caption = F.coalesce("text", F.lit("")), filled(has("caption", "string"))
    image = F.concat_ws("\n", filled(text), F.when(caption.isNotNull(), F.format_string(CAPTION, caption)))
    kind = F.coalesce("kind", F.lit("text"))
    content = F.when(kind == "table", F.concat_ws("\n", filled(text), has("html", "string"))).when(kind == "image", F.coalesce(filled(image), F.lit(NO_WORDS))).otherwise(text)
    return blocks.select("doc_id", "block_idx", kind.alias("kind"), F.coalesce("layout_type", F.lit("text")).alias("layout_type"), content.alias("content"), caption.alias("caption"), has("page_num", "int").alias("page_num"))


def build_parents(blocks: DataFrame, most: int = 500) -> DataFrame:
    """blocks as in `block_content` -> doc_id, parent_index, parent_id, kind, heading, content, tokens, n_blocks, start_page, end_page, caption.

    Texts are packed in order into parents of up to `most` tokens, counted block by block; a longer block is a parent of its own. Titles,
    tables and images are parents of their own and end the one before; a title also becomes the heading (its first 100 characters) of what
    follows. Other layouts and unknown kinds are left out and end the one before. A repeated block index keeps both rows."""
    kind, layout = F.col("kind"), F.col("layout_type")
    own = kind.isin("table", "image") | ((kind == "text") & (layout == "title"))
    use = F.when(own, "own").when((kind == "text") & layout.isin(KEPT), "packed").otherwise("dropped")
    title = F.when((kind == "text") & (layout == "title"), F.substring("content", 1, 100))
    before = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = block_content(blocks).withColumns({"use": use, "n": tx.estimate_tokens(F.col("content"))}).withColumn("heading", F.coalesce(F.last(title, ignorenulls=True).over(before), F.lit("")))

    def step(state, row):
        parent, used = state or (-1, None)
        if row.use == "dropped":
            return (parent, None), (-1,)
        if row.use == "packed" and used is not None and used + row.n <= most:
            return (parent, used + row.n), (parent,)
        return (parent + 1, row.n if row.use == "packed" else None), (parent + 1,)

    kept = folds.fold_rows(b, "doc_id", ["block_idx"], step, "parent_index int").filter("parent_index >= 0")
    rows = F.array_sort(F.collect_list(F.struct("block_idx", "content", "page_num", "kind", "heading", "caption")))
    p = kept.groupBy("doc_id", "parent_index").agg(rows.alias("x"))
    first, last = F.element_at("x", 1), F.element_at("x", -1)
    p = p.select(
        "doc_id", "parent_index", tx.chunk_id(F.col("doc_id"), F.concat(F.lit("parent_"), "parent_index")).alias("parent_id"), first["kind"].alias("kind"), first["heading"].alias("heading"),
        F.array_join(F.transform("x", lambda r: r.content), "\n\n").alias("content"), F.size("x").alias("n_blocks"), first["page_num"].alias("start_page"), last["page_num"].alias("end_page"), first["caption"].alias("caption"),
    )
    return p.withColumn("tokens", tx.estimate_tokens(F.col("content")))


def parent_relations(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, chunk_id, parent_id) -> chunk_id, parent_id, prev_id, next_id: neighbours of the same parent only. Chunks
    without a parent are neighbours of each other."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    beside = lambda f: F.when(F.col("parent_id").eqNullSafe(f("parent_id").over(w)), f("chunk_id").over(w))
    return chunks.select("chunk_id", "parent_id", beside(F.lag).alias("prev_id"), beside(F.lead).alias("next_id"))


def parent_children(blocks: DataFrame, most: int = 500, target: int = 150, least: int = 40) -> DataFrame:
    """blocks -> doc_id, chunk_index, chunk_id, kind, content, tokens, parent_id, heading, start_page, end_page: the children of the parents of
    `build_parents`, numbered through each document. `parent_relations` links them."""
    p = build_parents(blocks, most)
    c = folds.split_children(p, target, least).select("parent_id", "child_index", "content", "tokens")
    j = c.join(p.select("parent_id", "doc_id", "parent_index", "kind", "heading", "start_page", "end_page"), "parent_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_index", "child_index")) - 1
    j = j.withColumn("chunk_index", place.cast("int")).withColumn("chunk_id", tx.chunk_id(F.col("doc_id"), F.col("chunk_index")))
    return j.select("doc_id", "chunk_index", "chunk_id", "kind", "content", "tokens", "parent_id", "heading", "start_page", "end_page")


# Sub-queries


def sub_queries(queries: DataFrame) -> DataFrame:
    """queries (query_id, query, top_k) -> query_id, sub_id, query, top_k: the things that a question compares, else the question itself."""
    parts = fq.split_compare(F.col("query"))
    return queries.select("query_id", "top_k", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("query"))).alias("sub_id", "query")).select("query_id", "sub_id", "query", "top_k")


def multi_query(subs: DataFrame, sub_vectors: DataFrame, vectors: DataFrame, keyword: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """subs (query_id, sub_id, query, top_k), sub_vectors (query_id, sub_id, embedding), vectors (chunk_id, embedding) -> query_id, list (the
    sub_id), rank, chunk_id, score.

    All sub-queries of all questions go through one hybrid search; `retrieval.merge_lists` then keeps a question's first hit of each chunk,
    and `retrieval.groups_of` lists what each sub-query found. A null or blank sub-query finds nothing; one without a vector goes by terms.

    The numbers of the searches are made once and written, as they'd differ if a lost executor's task made them again."""
    s = materialize(subs.filter(F.trim("query") != "").select("query_id", "sub_id", "query", "top_k").withColumn("search_id", F.monotonically_increasing_id()))
    asked = s.select(F.col("search_id").alias("query_id"), "query", "top_k")
    v = sub_vectors.select("query_id", "sub_id", "embedding").join(s.select("query_id", "sub_id", "search_id"), ["query_id", "sub_id"])
    hits = retrieval.hybrid_search(asked, v.select(F.col("search_id").alias("query_id"), "embedding"), vectors, keyword)
    back = s.select("search_id", "query_id", F.col("sub_id").alias("list"))
    return hits.select(F.col("query_id").alias("search_id"), "rank", "chunk_id", "score").join(back, "search_id").select("query_id", "list", "rank", "chunk_id", "score")
