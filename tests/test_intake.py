import pytest
from conftest import SF
from pyspark.sql import functions as F

from kbspark.operators import block_chunks as bc
from kbspark.operators import folds, intake
from kbspark.plans import intake_queries as iq
from kbspark.streaming import jobs

BLOCKS = "doc_id long, block_idx int, kind string, layout_type string, level int, text string"


def test_markdown(spark):
    text = "intro **bold** [a](http://b)\nmore\n> said `x`\n\n# One\n```py\nx = 1\n\n# no title\n```\nafter\n| a | b |\n|---|:-:|\n| 1 | 2 |\n- x\n2. *y*\n---\n| lone |\nend\n## Two\n```\nopen"
    got = bc.markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n \n")], "doc_id long, text string")).orderBy("block_idx").collect()
    assert [(r.layout_type if r.kind == "text" else "table", r.level, r.text) for r in got] == [
        ("reference", None, "said x"), ("text", None, "intro bold a\nmore"), ("title", 1, "One"), ("text", None, "[代码块: py]"), ("reference", None, "x = 1\n\n# no title"),
        ("text", None, "after"), ("table", None, "1 x 2: a, b"), ("text", None, "• x\n• y"), ("text", None, "end"), ("title", 2, "Two"), ("text", None, "[代码块]"), ("reference", None, "open"),
    ]
    assert {r.title for r in got} == {"One"} and got[6].html == "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"


def test_markdown_of_a_long_text(spark):
    d = spark.createDataFrame([(1, "| a | b\n" * 20000 + "- x\n" * 20000 + "```\n" + "y\n" * 20000)], "doc_id long, text string")
    got = bc.markdown_blocks(d).orderBy("block_idx").collect()
    assert [(r.layout_type, len(r.text)) for r in got] == [("text", 79999), ("text", 159999), ("text", 5), ("reference", 39999)]


def test_sheets_with_gaps(spark):
    rows = [(1, 0, "a", 0, 1, "x"), (1, 0, "a", 1, 0, " "), (1, 0, "a", 2, 2, "z"), (1, 1, "b", 0, 0, None), (1, 0, "a", 2, 0, None)]
    got = bc.sheet_blocks(spark.createDataFrame(rows, "doc_id long, sheet_no int, sheet string, row int, col int, value string")).orderBy("block_idx").collect()
    assert [r.text for r in got] == ["Sheet: a — 2 行数据", "Sheet 'a'：1 行 × 3 列，表头为 [, x, ]，约 3 tokens"]
    assert got[1].html == "<table><tr><th></th><th>x</th><th></th></tr><tr><td></td><td></td><td>z</td></tr></table>"


def test_size_pieces():
    assert bc.size_pieces("a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 200, 40, 5) == ["a" * 30 + "\n\n" + "b" * 30, "c" * 200]
    assert bc.size_pieces("a\n\n" + "b" * 200 + "\n\n" + "c" * 70, 40, 5) == ["a\n\n" + "b" * 200, "c" * 70]
    assert bc.size_pieces("b" * 200 + "\n\nc", 40, 5) == ["b" * 200 + "\n\nc"]
    assert bc.size_pieces(" \n\n ", 40, 5) == [] and bc.size_pieces("", 40, 5) == []


def test_chunks_by_title(spark):
    rows = [
        (1, 0, "text", "text", None, "before"), (1, 1, "text", "title", 1, "One"), (1, 2, "text", "text", None, "a" * 30), (1, 3, "table", "text", None, "b" * 30), (1, 4, "text", "text", None, "c" * 60),
        (1, 5, "text", "title", 2, "Two"), (1, 6, "text", "title", None, ""), (1, 7, None, None, None, "tail"), (2, 0, "text", "text", None, "no title"), (2, 1, "text", "noise", None, "left out"), (3, 0, "text", "text", None, None),
    ]
    got = bc.title_chunks(spark.createDataFrame(rows, BLOCKS), 40).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.kind, r.heading, r.content) for r in got[:7]] == [
        (1, "text", None, "before"), (1, "title", "One", "One"), (1, "text", "One", "a" * 30 + "\n\n" + "b" * 30), (1, "text", "One", "c" * 60), (1, "title", "Two", "Two"), (1, "text", None, "tail"), (2, "text", None, "no title"),
    ]
    ids = [r.chunk_id for r in got]
    assert [r.parent_id for r in got[:6]] == [None, None, ids[1], ids[1], None, ids[4]]
    assert got[0].next_id == ids[1] and got[5].next_id is None and got[6].prev_id is None


def test_no_text_is_lost_by_chunks(spark):
    b = iq.paragraphs(spark, SF).filter("layout_type = 'title' or kind = 'text'")
    letters = lambda d, c: {r.doc_id: r.n for r in d.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(c, r"\s+", ""))).alias("n")).collect()}
    assert letters(b, "text") == letters(bc.token_chunks(b), "content") == letters(bc.title_chunks(b), "content")
    assert bc.token_chunks(b.filter("false")).count() == bc.title_chunks(b.filter("false")).count() == 0


def test_chunk_by_strategy(spark):
    d = spark.createDataFrame([(1, "token", "txt"), (2, "title", "md"), (3, None, "md")], "doc_id long, strategy string, file_type string")
    b = spark.createDataFrame([(i, j, "text", "title" if j == 0 else "text", 1, x) for i in (1, 2, 3) for j, x in enumerate(["Head", "a" * 900])], BLOCKS)
    got = {(r.doc_id, r.file_type) for r in bc.chunk(b, d).collect()}
    assert got == {(1, "txt"), (2, "md"), (3, "md")}


def test_text_files(spark, tmp_path):
    for name, raw in {"a.txt": " é 中文 \n".encode(), "b.txt": "中文文本".encode("gbk"), "c.txt": b"\xff\xff\xff", "d.txt": b"", "e.md": b"no"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path[-5:]: (r.text, r.readable) for r in intake.read_text_docs(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("é 中文", True), "b.txt": ("中文文本", True), "c.txt": (None, False)}


def test_users_from_csv(spark, tmp_path):
    lines = ["username,display_name,groups,group_name", 'ann,"Ann, ""A""",g1|nope,g2', "an,Short,,", "bob,,,", "bob,Bob,g1,unknown", "bob,Again,,", ",,,", "old,Old,,", f"{'x' * 33},X,,"]
    (tmp_path / "u.csv").write_text("\n".join(lines))
    users, groups = spark.createDataFrame([("old",)], "username string"), spark.createDataFrame([("1", "g1"), ("2", "g2"), ("0", None)], "group_id string, name string")
    new, joined, errors = intake.import_users(intake.read_users_csv(spark, str(tmp_path / "u.csv")), users, groups)
    assert sorted((r.row_num, r.username, r.display_name) for r in new.collect()) == [(2, "ann", 'Ann, "A"'), (5, "bob", "Bob")]
    assert sorted(map(tuple, joined.collect())) == [("ann", "1"), ("ann", "2"), ("bob", "1")]
    assert sorted((r.row_num, r.reason) for r in errors.collect()) == [(2, intake.NO_GROUP + "nope"), (3, intake.BAD_LENGTH), (4, intake.NO_DISPLAY), (6, intake.KNOWN), (7, intake.NO_NAME), (8, intake.KNOWN), (9, intake.BAD_LENGTH)]
    with pytest.raises(ValueError):
        intake.import_users(groups, users, groups)


def test_eval_files(spark, tmp_path):
    (tmp_path / "b1.json").write_text('{\n"batch": 1,\n "results": [{"id": 1, "faithfulness": 0.5}, {"id": 2, "category": "negative"}]}')
    (tmp_path / "b2.json").write_text("broken")
    got = intake.read_eval_results(spark, str(tmp_path)).collect()
    assert [(r.batch, r.id, r.category, r.faithfulness) for r in got] == [(1, 1, None, 0.5), (1, 2, "negative", None)]
    s = spark.createDataFrame([(1, "q" * 90, 0.5, None), (2, None, None, None)], "id long, question string, faithfulness double, relevance double")
    for _ in range(2):
        intake.write_eval_report(s, ["faithfulness", "relevance"], str(tmp_path / "out"), "v1")
    assert {r.metric: (r.n, r.aggregate) for r in spark.read.json(str(tmp_path / "out/v1/scores")).collect()} == {"faithfulness": (1, 0.5), "relevance": (0, 0.0)}
    assert sorted((r.id, len(r.question or "")) for r in spark.read.json(str(tmp_path / "out/v1/per_sample")).collect()) == [(1, 80), (2, 0)]


def test_citations(spark):
    a = spark.createDataFrame([(1, "The first sentence here. The second sentence here. The first sentence here."), (2, "Only one sentence."), (3, None)], "answer_id long, answer string")
    hits = [(1, "b", 0, 5, "The second sentence here."), (1, "a", 1, 3, "The first sentence here."), (1, "c", 2, None, "Nothing alike"), (1, "d", 3, None, None), (2, "e", 0, 0, "Only one sentence.")]
    got = intake.cite(a, spark.createDataFrame(hits, "answer_id long, chunk_id string, rank int, doc_order int, content string"), 0.7).orderBy("sentence_idx").collect()
    assert [(r.answer_id, r.sentence_idx, r.chunk_id, r.score) for r in got] == [(1, 0, "a", 1.0), (1, 1, "b", 1.0)]


def test_cited_by_one_sentence_only(spark):
    got = intake.cite(iq.answers(spark, SF), iq.own_hits(spark, SF)).collect()
    assert got and len({(r.answer_id, r.chunk_id) for r in got}) == len(got)


def test_cache_stream_as_batch(spark, tmp_path):
    e = spark.range(200).select(F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 4).alias("key"), F.timestamp_add("SECOND", F.col("id") * 10, F.lit("2024-01-01").cast("timestamp")).alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("query_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), F.col("id"))).alias("answer"), F.when(F.col("id") % 3 == 0, (F.col("id") % 7) * 20 + 5).alias("ttl"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    e.coalesce(1).write.parquet(source)
    stream = jobs.cache_stream(spark.readStream.schema(e.schema).parquet(source).withWatermark("ts", "10 minutes"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = folds.cache_lookup(e.filter("query_id is not null").select("query_id", "key", "ts"), e.filter("query_id is null").select("key", F.col("ts").alias("cached_at"), "ttl", "answer"))
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, want.collect())) and len({a is None for _, a in got}) == 2
