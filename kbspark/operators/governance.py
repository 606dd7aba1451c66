"""Blocks, masking of whole documents, metadata of chunks and knowledge bases, citations, and writes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions.text import MASKS, estimate_tokens, mask_pii, round_places, truncate_text

#: Words that speak for a real document and for test data.
REAL = ["员工手册", "employee handbook", "handbook", "chapter", "手册", "制度", "规范", "项目", "introduction", "overview", "policy", "公司", "组织", "架构", "职责", "岗位", "招聘", "培训", "薪酬", "绩效", "考核", "数据", "platform", "系统", "安全", "技术", "设计", "合规", "流程", "管理办法", "实施方案"]
FAKE = ["test", "测试", "demo", "示例", "sample", "mock", "模拟", "dummy", "假", "temp", "temporary", "lorem", "ipsum", "随机", "测试数据", "占位"]


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("chunk_index")


# Blocks


def table_description(rows: Column) -> Column:
    """rows: array of arrays of cells, the header first -> rows x columns and the first six header cells."""
    head = F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>"))
    return F.concat(F.greatest(F.size(rows) - 1, F.lit(0)).cast("string"), F.lit(" x "), F.size(head).cast("string"), F.lit(": "), F.array_join(F.slice(head, 1, 6), ", "))


def table_html(rows: Column) -> Column:
    line = lambda tag: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, line("th")(r)).otherwise(line("td")(r))), "")
    return F.concat(F.lit("<table>"), body, F.lit("</table>"))


def plain_text(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_idx, text) -> the texts in order with blank lines between; empty ones are left out."""
    g = blocks.filter("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda b: b.text), "\n\n").alias("text"))


def block_stats(blocks: DataFrame) -> DataFrame:
    title = (F.col("kind") == "text") & (F.col("layout_type") == "title")
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind") == "table").alias("n_tables"), F.count_if(title).alias("n_titles"))


def section_tree(titles: DataFrame, levels: int = 6) -> DataFrame:
    """titles (doc_id, block_idx, level) -> parent_idx: the nearest earlier title of a smaller level (null: none)."""
    w = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("block_idx"))).over(w) for k in range(1, levels)}
    parent = F.lit(None).cast("long")
    for k in range(levels, 1, -1):
        known = [last[j] for j in range(1, k)]
        parent = F.when(F.col("level") == k, F.greatest(*known) if len(known) > 1 else known[0]).otherwise(parent)
    return titles.select("doc_id", "block_idx", parent.cast("long").alias("parent_idx"))


def enrich_media(chunks: DataFrame, table: int = 2, image: int = 1, chars: int = 200, tokens: int = 300) -> DataFrame:
    """Tables and images with snippets of the text chunks among their next positions on both sides, nearest first while they fit."""
    n = F.when(F.col("kind") == "table", table).when(F.col("kind") == "image", image).otherwise(0)
    text = F.when(F.col("kind") == "text", truncate_text(F.col("content"), chars))
    most = max(table, image)

    def side(step: int) -> Column:
        near = [F.lag(text, step * i).over(in_order()) for i in range(1, most + 1)]
        acc = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            fits = x.isNotNull() & ~a.full & (a.n + estimate_tokens(x) <= tokens)
            return F.struct(F.when(fits, a.n + estimate_tokens(x)).otherwise(a.n).alias("n"), (a.full | (x.isNotNull() & ~fits)).alias("full"), F.when(fits, F.concat(a.out, F.array(x))).otherwise(a.out).alias("out"))

        found = F.aggregate(F.array(*(F.when(F.lit(i) < n, x) for i, x in enumerate(near))), acc, add, lambda a: a.out)
        return F.array_join(F.reverse(found) if step == 1 else found, "\n")

    c = chunks.withColumns({"before": side(1), "after": side(-1)})
    up = F.when(F.col("before") != "", F.concat(F.lit("[上文上下文]\n"), "before"))
    down = F.when(F.col("after") != "", F.concat(F.lit("[下文上下文]\n"), "after"))
    return c.select("chunk_id", F.concat_ws("\n\n", up, "content", down).alias("content"))


def index_rows(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunks numbered within their document, with its metadata as JSON without nulls."""
    names = [c for c in meta.columns if c != "doc_id"]
    numbered = chunks.select("doc_id", "chunk_id", (F.row_number().over(in_order()) - 1).cast("long").alias("row_no"))
    return numbered.join(meta.select("doc_id", F.to_json(F.struct(*names)).alias("metadata")), "doc_id")


# Masking


def is_sensitive(text: Column) -> Column:
    """Whether a rule hits, on the text as masked by those before it."""
    hit = F.lit(False)
    for _, pattern, to in MASKS:
        hit, text = hit | text.rlike(pattern), F.regexp_replace(text, pattern, to)
    return hit


def mask_blocks(chunks: DataFrame) -> DataFrame:
    """Masks the texts of documents that hold anything sensitive; others stay as they are."""
    flagged = chunks.withColumn("sensitive", F.max(is_sensitive(F.col("chunk_text"))).over(Window.partitionBy("doc_id")))
    return flagged.withColumn("chunk_text", F.when(F.col("sensitive"), mask_pii(F.col("chunk_text"))).otherwise(F.col("chunk_text")))


def mask_report(docs: DataFrame) -> DataFrame:
    """Hits and documents for each masking rule, each on the text as masked by those before it."""
    text, found = F.col("text"), []
    for name, pattern, to in MASKS:
        found.append(F.struct(F.lit(name).alias("rule"), F.regexp_count(text, F.lit(pattern)).alias("n")))
        text = F.regexp_replace(text, pattern, to)
    x = docs.filter("text is not null").select(F.explode(F.array(*found)).alias("x")).select("x.*")
    return x.groupBy("rule").agg(F.sum("n").cast("long").alias("hits"), F.count_if(F.col("n") > 0).alias("n_docs"))


# Metadata


def heading_rules(chunks: DataFrame) -> DataFrame:
    """heading and level of titles that have none: the first 80 characters, and the number of # in front (none counts as one)."""
    title, marks = F.col("chunk_type") == "title", F.length(F.regexp_extract(F.trim("chunk_text"), "^#{1,6}", 0))
    return chunks.select("chunk_id", F.when(title, F.trim(F.left("chunk_text", F.lit(80)))).alias("heading"), F.when(title, F.greatest(marks, F.lit(1)).cast("long")).alias("level"))


def title_context(chunks: DataFrame, before: int = 2, chars: int = 300) -> DataFrame:
    """For each title the last chunks before it that aren't titles, of `before` positions."""
    w = in_order().rowsBetween(-before, -1)
    c = chunks.withColumn("x", F.collect_list(F.when(F.col("chunk_type") != "title", F.col("chunk_text"))).over(w))
    return c.filter("chunk_type = 'title'").select("chunk_id", F.left(F.array_join("x", "\n"), F.lit(chars)).alias("context"))


def doc_sample(chunks: DataFrame, most: int = 30, chars: int = 300, total: int = 5000) -> DataFrame:
    """The first chunks of each document, until the length of those before passes `total`."""
    w = in_order()
    sums = F.coalesce(F.sum(F.length("chunk_text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = chunks.withColumns({"n": F.row_number().over(w), "sum": sums}).filter((F.col("n") <= most) & (F.col("sum") <= total))
    return c.select("doc_id", "chunk_id", F.left("chunk_text", F.lit(chars)).alias("sample"))


def parse_model_json(raw: Column, schema: str) -> Column:
    """A model's answer as a struct: without code fences, else from its first brace to the last, else null."""
    text = F.trim(raw)
    bare = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.when(F.startswith(F.trim(bare), F.lit("{")) & F.get_json_object(bare, "$").isNotNull(), bare)
    part = F.when((inner != "") & F.get_json_object(inner, "$").isNotNull(), inner)
    return F.from_json(F.coalesce(whole, part), schema)


def parse_judge(raw: Column) -> list[Column]:
    """Scores between 0 and 1; missing ones are 0, but for answer_correctness."""
    dims = ["faithfulness", "answer_relevance", "context_relevance", "answer_correctness"]
    j = parse_model_json(raw, ", ".join(f"{d} double" for d in dims))
    score = lambda d: F.least(F.greatest(j[d], F.lit(0.0)), F.lit(1.0))
    return [F.when(j[d].isNull(), F.lit(0.0) if d != dims[3] else F.lit(None)).otherwise(score(d)).alias(d) for d in dims]


def kb_topics(topics: DataFrame, most: int = 6) -> DataFrame:
    """topics (kb_id, topic): distinct topics of each knowledge base and its most frequent ones (then by name) joined."""
    n = topics.groupBy("kb_id", "topic").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.col("n").desc(), "topic"))
    n = n.withColumn("rank", rank)
    g = n.groupBy("kb_id").agg(F.count("*").alias("n_topics"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "topic")))).alias("x"))
    return g.select("kb_id", "n_topics", F.array_join(F.transform("x", lambda t: t.topic), "、").alias("summary"))


def kb_catalog(kbs: DataFrame, scope: DataFrame, summaries: DataFrame, docs: DataFrame) -> DataFrame:
    count = docs.groupBy("kb_id").agg(F.count("*").alias("doc_count"))
    k = kbs.join(scope, "kb_id", "left_semi").join(summaries, "kb_id", "left").join(count, "kb_id", "left")
    return k.select("kb_id", "kb_name", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def kb_docs(chunks: DataFrame, as_of: str, most: int = 50) -> DataFrame:
    """The first chunk of each source file, titled by it; at most `most` a knowledge base (a page of a list), by file."""
    first = F.row_number().over(Window.partitionBy("kb_id", "source_file").orderBy("chunk_index"))
    c = chunks.withColumn("n", first).filter("n = 1")
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("kb_id").orderBy("source_file"))).filter(F.col("place") <= most)
    expired = F.coalesce(F.col("expiry_date") < F.lit(as_of).cast("date"), F.lit(False))
    return c.select("kb_id", "source_file", F.regexp_extract("source_file", "([^/]+)$", 1).alias("title"), F.left("chunk_text", F.lit(200)).alias("summary"), F.when(expired, "expired").otherwise("active").alias("status"))


def sibling_kbs(kbs: DataFrame) -> DataFrame:
    """Live knowledge bases in the space of each."""
    live = kbs.filter("deleted_at is null")
    return kbs.select("kb_id", "space_id").join(live.select("space_id", F.col("kb_id").alias("sibling")), "space_id").filter("kb_id <> sibling").select("kb_id", "sibling")


def classify_docs(chunks: DataFrame, chars: int = 500) -> DataFrame:
    """Two points for each word of a kind in the beginning of a document or in its file's name."""
    head, name = F.left(F.lower("chunk_text"), F.lit(chars)), F.lower("source_file")
    points = lambda ws: F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(head, w) | F.contains(name, w))) * 2
    d = chunks.filter("chunk_index = 0").select("doc_id", points(REAL).alias("real"), points(FAKE).alias("fake"))
    kind = F.when((F.col("fake") >= 2) & (F.col("real") == 0), "fake: test data").when(F.col("fake") >= 4, "fake: strong").when((F.col("real") >= 4) & (F.col("fake") == 0), "real").when((F.col("real") >= 2) & (F.col("real") > F.col("fake")), "likely real").when(F.col("fake") > 0, "likely fake").otherwise("uncertain")
    return d.select("doc_id", F.col("real").cast("long").alias("real"), F.col("fake").cast("long").alias("fake"), kind.alias("kind"))


# Citations and context


def doc_order(chunks: DataFrame) -> DataFrame:
    """Place (from 0) of chunks by page; those without one come last."""
    w = Window.partitionBy("doc_id").orderBy(F.col("page_start").isNull(), F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0)), "chunk_index")
    return chunks.select("chunk_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


def render_citations(sentences: DataFrame) -> DataFrame:
    """sentences (answer_id, pos, sentence, cite) -> the answer with [n] behind those cited."""
    piece = F.concat("sentence", F.when(F.col("cite").isNotNull(), F.concat(F.lit(" ["), F.col("cite").cast("string"), F.lit("]"))).otherwise(F.lit("")))
    g = sentences.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))).alias("x"))
    return g.select("answer_id", F.array_join(F.transform("x", lambda s: s.t), "").alias("answer"))


def grounded(answer: Column, n_sources: Column) -> Column:
    return (n_sources == 0) | answer.rlike(r"\[Ref\s*[0-9]+\]|\[来源:")


def citation_stats(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Sentences (parts between 。 that aren't blank), cited sentences and distinct chunks of each answer."""
    n = F.size(F.filter(F.split("answer", "。", -1), lambda s: F.trim(s) != "")).cast("long")
    c = citations.groupBy("answer_id").agg(F.countDistinct("pos").alias("n_cited"), F.countDistinct("chunk_id").alias("n_chunks"))
    return answers.select("answer_id", n.alias("n_sentences")).join(c, "answer_id", "left").na.fill(0)


def context_tokens(hits: DataFrame) -> DataFrame:
    """Tokens of each query's hits joined by line ends."""
    n = F.sum(F.length("chunk_text")) + F.count("*") - 1
    return hits.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(n / 2)).cast("long").alias("tokens"))


def judge_input(hits: DataFrame, most: int = 5, chars: int = 300) -> DataFrame:
    """What a judge reads of each query: its first chunks, cut, in order of rank."""
    g = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.left("chunk_text", F.lit(chars)).alias("t")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda h: h.t), "\n\n").alias("context"))


def build_traces(queries: DataFrame, hits: DataFrame, most: int = 10, chars: int = 150) -> DataFrame:
    """One row a query with the number of its hits and a snapshot of the best."""
    h = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "chunk_id", round_places(F.col("score"), 4).alias("score"), F.left("chunk_text", F.lit(chars)).alias("snippet"))))).alias("x"))
    j = queries.join(h, "query_id", "left")
    line = F.transform(F.coalesce("x", F.array()), lambda c: F.concat_ws("|", c.rank.cast("string"), c.chunk_id, F.format_string("%.4f", c.score), c.snippet))
    return j.select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"), F.array_join(line, "\n").alias("snapshot"))


def assemble_messages(history: DataFrame, most: int = 6) -> DataFrame:
    """history (conv_id, turn, role, text): the system turn, then the last of the others, in order, with the tokens of all."""
    rest = history.filter("role <> 'system'")
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter(F.col("n") <= most).drop("n")
    parts = history.filter("role = 'system'").withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "turn"))
    total = F.sum(estimate_tokens(F.col("text"))).over(Window.partitionBy("conv_id"))
    return parts.select("conv_id", place.cast("long").alias("place"), "role", "turn", total.alias("total_tokens"))


# Snapshots


def new_rows(rows: DataFrame, existing: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What an insert adds that leaves known keys alone; a key that comes twice is added once."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def write_chunks(rows: DataFrame, path: str) -> None:
    """Append those rows to the Parquet table at path that it doesn't hold. A repeated call adds nothing."""
    spark = rows.sparkSession
    try:
        rows = new_rows(rows, spark.read.parquet(path))
    except Exception as e:  # noqa: BLE001  (the table is new)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = rows.dropDuplicates(["chunk_id"])
    rows.write.mode("append").parquet(path)


def set_status(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot with the status that changes (doc_id, new_status) give, one for each document."""
    return chunks.join(changes, "doc_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def delete_chunks(chunks: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot without the documents, and how many chunks each of them had (0 where none)."""
    n = chunks.join(doc_ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return chunks.join(doc_ids, "doc_id", "left_anti"), doc_ids.join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))
