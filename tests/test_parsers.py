import random

from conftest import SF
from pyspark.sql import functions as F

from kbspark.operators import evaluation, parsers
from kbspark.operators.block_chunks import markdown_blocks
from kbspark.operators.html_blocks import html_blocks


def test_files_of_all_types_in_one_table(spark):
    """Each type as by its own operator, a user's type by the user's function, unknown types and failures as rows that say so."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(8).select(F.col("page_id").alias("doc_id"), F.lit("HTML").alias("file_type"), F.col("html").alias("text"))
    notes = spark.createDataFrame([(1001, "md", "# A\n\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"), (1002, "txt", "one\n\n \n\ntwo\nlines"), (1003, "csv", "a,b\n1,2"), (1004, "exe", "x"), (1005, None, "x"), (1006, "txt", None), (1007, "bad", "x")], "doc_id long, file_type string, text string")
    before = dict(parsers.PARSERS)
    parsers.register_blocks("CSV", lambda text: [("table", "table", None, "", [line.split(",") for line in text.split("\n")])])
    parsers.register_blocks("bad", lambda text: [1 / 0])
    try:
        got = parsers.parse_blocks(pages.unionByName(notes).withColumn("error", F.lit("mine"))).collect()
    finally:
        parsers.PARSERS.clear()
        parsers.PARSERS.update(before)
    of = lambda i: [(r.block_idx, r.kind, r.layout_type, r.level, r.text, r.html, r.error) for r in got if r.doc_id == i]
    want = html_blocks(pages.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))).collect()
    assert sorted((r.page_id, r.block_idx, r.kind, r.text, r.html or "") for r in want) == sorted((r.doc_id, r.block_idx, r.kind, r.text, r.html or "") for r in got if r.doc_id < 1000) and want
    md = markdown_blocks(notes.filter("doc_id = 1001").select("doc_id", "text")).orderBy("block_idx").collect()
    assert [(r.kind, r.layout_type, r.level) for r in md] == [x[1:4] for x in of(1001)] and len(md) >= 3
    assert [x[4] for x in of(1002)] == ["one", "two\nlines"] and of(1006) == []
    assert of(1003) == [(0, "table", "table", None, "1 x 2: a, b", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", None)]
    assert of(1004) == [(0, None, None, None, None, None, "unknown file type: exe")] and of(1005)[0][6] == "unknown file type: None" and "ZeroDivisionError" in of(1007)[0][6]
    assert parsers.parse_blocks(notes.limit(0)).count() == 0


def test_grouped_context_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(q, s, r, f"c{q}-{s}-{r}", f"f{r}", rng.random() * 9, "x" * rng.randrange(900), rng.choice((True, False, None))) for q in range(6) for s in range(4) if (q + s) % 3 for r in range(1, rng.randrange(2, 7))]
    rows.append((6, 0, 1, "c", None, 1.005, None, None))
    subs = [(q, s) for q in range(7) for s in range(4)] + [(0, 0)]
    want = []
    for q in range(7):
        for s in range(4):
            used = 0
            for r in [r for r in rows if r[:2] == (q, s)][:3]:
                text = f"[来源: {r[4] or ''} (相关度: {int(r[5] * 10**6 + 0.5) / 10**6 + 1e-9:.2f})]\n{(r[6] or '')[: 2000 if r[7] else 300]}\n"
                if used + len(text) > 2400 // 4:
                    break
                used += len(text)
                want.append((q, s, r[3], r[2], text, used))
    h = spark.createDataFrame(rows, "query_id long, sub_id int, rank int, chunk_id string, source_file string, score double, content string, has_parent boolean")
    got = evaluation.grouped_context(h, spark.createDataFrame(subs, "query_id long, sub_id int"), 2400).collect()
    assert sorted(map(tuple, got)) == sorted(want)
