import random

import pandas as pd
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.operators import folds
from kbspark.operators.html_blocks import html_blocks
from pyspark.sql import functions as F

PAGE = """<html><head><title> A <b>page</b></title><style>p {}</style></head><body><nav><p>menu</p></nav><h1>Top &amp; <i>more</i></h1>
<p>One<br>two</p><blockquote><p>said</p></blockquote><ul><li>a<ul><li>deep</li></ul></li><li>b</li></ul><div><pre> code </pre></div>
<table><tr><th>x</th><th>y</th></tr><tr><td><p>1</p></td><td>2</td></tr><tr><td> </td></tr></table><p></p><footer>end</footer></body></html>"""


def test_html_blocks(spark):
    p = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no <p>end"), (5, "<table></table><p>" + "word " * 100_000)], "page_id long, html string")
    got = html_blocks(p).orderBy("page_id", "block_idx").collect()
    assert [(r.layout_type, r.level, r.text) for r in got if r.page_id == 1] == [
        ("title", 1, "Top &more"), ("text", None, "Onetwo"), ("reference", None, "said"), ("text", None, "said"), ("text", None, "• adeep\n• b"), ("text", None, "code"), ("table", None, "1 x 2: x, y"),
    ]
    assert got[6].html == "<table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table>" and got[0].title == "Apage"
    assert [(r.page_id, r.block_idx, len(r.text)) for r in got if r.page_id > 1] == [(4, 0, 3), (5, 0, 499_999)]
    assert html_blocks(p.limit(0)).count() == 0
    assert html_blocks(spark.read.parquet(f"{SF}/pages.parquet")).filter("kind = 'text'").select("page_id").distinct().count() == 50


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.!?\n。；", max_size=400), st.integers(2, 20))
def test_children_keep_the_text(text, target):
    got = folds.child_pieces(text, target, 2)
    assert "".join("".join(got).split()) == "".join(text.split()) and all(x.strip() for x in got)


def test_children(spark):
    assert folds.child_pieces("x" * 25, 5, 2) == ["x" * 10, "x" * 10 + "\n" + "x" * 5] or folds.child_pieces("x" * 25, 5, 2) == ["x" * 10, "x" * 10, "x" * 5]
    rows = [("a", "text", "H", "One. " * 20), ("b", "table", "H", "| x |"), ("c", None, None, "short"), ("d", "text", "H", None), ("e", "text", "One", "One two")]
    got = folds.split_children(spark.createDataFrame(rows, "parent_id string, kind string, heading string, content string"), 15, 4).orderBy("parent_id", "child_index").collect()
    assert [r.content for r in got if r.parent_id != "a"] == ["| x |", "short", "One two"]
    a = [r.content for r in got if r.parent_id == "a"]
    assert all(x.startswith("H | ") for x in a) and "".join(x[4:].replace("\n", "") for x in a).replace(" ", "") == "One." * 20


def test_merge_short_kinds_end_a_run(spark):
    rows = [(1, 0, "text", "a" * 10), (1, 1, "text", "b" * 10), (1, 2, "table", "t"), (1, 3, "text", "c" * 10), (1, 4, "text", "d" * 900), (1, 5, None, "e"), (None, 0, "text", None)]
    got = folds.merge_short(spark.createDataFrame(rows, "doc_id long, chunk_index int, kind string, content string").withColumn("new_index", F.lit(9))).orderBy("new_index").collect()
    assert [(r.n_merged, len(r.content)) for r in got if r.doc_id == 1] == [(2, 22), (1, 1), (2, 912), (1, 1)]


def test_bucket_by_hand(spark):
    rows = [("k", i, i, 1) for i in [0] * 31] + [(None, 5, 99, 31)]
    r = spark.createDataFrame([(k, i, n) for i, (k, _, _, n) in enumerate(rows)], "key string, request_id long, n int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = folds.rate_limit(r).orderBy("request_id").collect()
    assert [x.allowed for x in got] == [True] * 30 + [False, False] and [x.retry_after for x in got[-2:]] == [1.0, 1.0]


def test_scorer_and_embedder(spark):
    h = spark.createDataFrame([(1, "x", "a b", "a"), (1, "y", "a b", "a b"), (1, "z", "a b", None)], "query_id long, chunk_id string, query string, content string")
    got = folds.rerank_udf(h, lambda q, c: pd.Series([len(set(a.split()) & set((b or "").split())) / 2 for a, b in zip(q, c)])).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("y", 1.0), ("x", 0.5), ("z", 0.0)]
    sizes = folds.embed(h.coalesce(1), lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=2).orderBy("chunk_id").collect()
    assert [r.embedding for r in sizes] == [[1.0, 2.0], [3.0, 2.0], [0.0, 1.0]]


def test_fold_of_many_keys_against_dictionaries(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.randrange(9)) for i in range(3000)]
    step = lambda s, x: ((s or 0) + int(x.v), ((s or 0) + int(x.v),))
    got = {r.i: r.total for r in folds.fold_rows(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], step, "total long").collect()}
    sums: dict = {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[i] == sums[k]


def test_merged_chunks_keep_pages_and_titles(spark):
    rows = [(1, 0, "text", "a" * 20, "first", 1, 1), (1, 1, "text", "b" * 20, "second", 1, 3), (1, 2, "table", "t", None, 3, 3), (1, 3, None, None, None, None, None), (2, 0, "text", "c", "own", 7, 8)]
    c = spark.createDataFrame(rows, "doc_id long, chunk_index int, kind string, content string, title string, start_page int, end_page int")
    got = sorted((r.doc_id, r.new_index, r.n_merged, r.title, r.start_page, r.end_page) for r in folds.merge_short(c).collect())
    assert got == [(1, 0, 2, "first", 1, 3), (1, 1, 1, None, 3, 3), (1, 2, 1, None, None, None), (2, 0, 1, "own", 7, 8)]
    assert "title" not in folds.merge_short(c.drop("title", "start_page", "end_page")).columns
