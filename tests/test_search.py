import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions import words
from kbspark.functions.text import terms
from kbspark.operators import keyword_index, keyword_scan, near_pairs, retrieval, vector_graph, vector_scan


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    rows = [(f"c{i:04d}", i // 5, f"kb{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("empty", 1, "kb0", ""), ("null", 1, "kb0", None)], "chunk_id string, doc_id long, kb_id string, chunk_text string")


def asked(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(1, 12))), 1 + i % 9) for i in range(40)]
    return spark.createDataFrame([*rows, (98, "", 3), (99, None, 3), (100, "absent", 3)], "query_id long, query string, top_k int")


def listed(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


def test_postings_are_made_where_texts_are_read(spark):
    """The same postings as by grouping all terms, for ids that several rows have too; only hashes of ids meet in a shuffle."""
    odd = spark.createDataFrame([("x", "b a b"), ("x", "c b"), ("y", "一二 a1 É é"), (None, "a b"), (None, "a"), ("z", None), ("v", " .")], "chunk_id string, chunk_text string")
    chunks = corpus(spark).select("chunk_id", "chunk_text")
    for c in (chunks, chunks.unionByName(odd), odd.filter("chunk_id = 'y'"), odd.limit(0)):
        t = c.select("chunk_id", F.posexplode(terms(F.col("chunk_text"))).alias("place", "term"))
        want = sorted((str(r.chunk_id), r.term, r.tf, r.p) for r in t.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("p")).collect())
        assert sorted((str(r.chunk_id), r.term, r.tf, r.positions) for r in retrieval.postings_with_positions(c).collect()) == want
        assert sorted((str(r.chunk_id), r.term, r.tf) for r in retrieval.postings(c).collect()) == [w[:3] for w in want]
    for plan in (retrieval.postings(chunks), retrieval.postings_with_positions(chunks)):
        assert "Exchange" not in plan._jdf.queryExecution().toString()


def test_index_search_is_the_search_without_one(spark, tmp_path):
    """The same rows for numbers and columns of k, and fewer postings joined than the terms have."""
    chunks, q, path = corpus(spark), asked(spark), str(tmp_path / "index")
    assert keyword_index.refresh(chunks, path, block_chunks=4)["added"] == 302
    for k in (1, 5, 30, "top_k"):
        assert listed(keyword_index.search(q, path, k)) == listed(retrieval.keyword_search(q, chunks, k))
    steps = keyword_index.plan(q, path, 3, "bm25", 1.2, 0.75, 3, 200_000)
    every = retrieval.query_terms(q).join(keyword_index.postings(spark, path), "term").count()
    assert steps["first"].count() + steps["rest"].count() < 0.7 * every
    assert listed(keyword_index.search(q, path, 5, max_broadcast=1)) == listed(retrieval.keyword_search(q, chunks, 5))


def test_search_without_an_index_hands_on_the_best_only(spark, monkeypatch):
    """The scan finds what the join finds, over copies and small slices, and no more rows leave a task than its questions may have."""
    chunks, q = corpus(spark), asked(spark)
    copies = chunks.unionByName(chunks.filter("doc_id < 9").withColumn("chunk_id", F.concat(F.lit("copy"), "chunk_id"))).repartition(3)
    monkeypatch.setattr(keyword_scan, "CELLS", 900)
    for k in (1, 5, 30, "top_k"):
        assert listed(retrieval.keyword_search(q, copies, k)) == listed(retrieval.keyword_search(q, copies, k, most_terms=1))
    words = copies.select("chunk_id", F.split(F.coalesce("chunk_text", F.lit("")), " ").alias("w"))
    some = retrieval.query_terms(q).withColumn("limit", F.lit(4)).toPandas()
    assert keyword_scan.best_chunks(words, some, 1.2, 0.75).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 4 * 3
    assert retrieval.keyword_search(q.limit(0), copies).count() == 0 and retrieval.keyword_search(q, copies.limit(0)).count() == 0


def odd_texts(spark):
    rng = random.Random(6)
    some = [*map(chr, range(1, 0x250)), *map(chr, [0x4DFF, 0x4E00, 0x4E2D, 0x9FFF, 0xA000, 0x130, 0x660, 0x870, 0xFEFF, 0xFFFD, 0x1F600, 0x2A700, 0x30000, 0x10FFFF]), *" " * 60, *"中文" * 20]
    texts = ["", " ", "中", "a中b", "İ", *("".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(3000))]
    return spark.createDataFrame([(f"c{i:04d}", x) for i, x in enumerate(texts)], "chunk_id string, chunk_text string")


def test_terms_of_whole_columns_are_those_of_spark(spark):
    """The tasks of a search split texts as Spark's expression does, also slices, empty batches and characters of any length."""
    kinds = words.kinds(spark)
    for batch in odd_texts(spark).select(F.lower("chunk_text").alias("l"), terms(F.col("chunk_text")).alias("w")).toArrow().to_batches():
        for part in (batch, batch.slice(3, 50), batch.slice(5, 0)):
            assert words.terms_of(part.column("l"), kinds).to_pylist() == part.column("w").to_pylist()


def test_search_hands_texts_to_the_tasks_not_words(spark, monkeypatch):
    """The scan gets whole texts, is cut seldom, and finds in odd texts and many copies what the join finds."""
    chunks = odd_texts(spark)
    copies = chunks.unionByName(chunks.limit(40).crossJoin(spark.range(30)).select(F.concat("chunk_id", F.lit("x"), "id").alias("chunk_id"), "chunk_text")).repartition(2)
    q = chunks.filter("length(chunk_text) > 9").limit(30).select(F.monotonically_increasing_id().alias("query_id"), F.col("chunk_text").alias("query"))
    given, scan = [], keyword_scan.best_chunks
    monkeypatch.setattr(keyword_scan, "best_chunks", lambda w, *rest: given.append(dict(w.dtypes)["w"]) or scan(w, *rest))
    assert listed(retrieval.keyword_search(q, copies, 7)) == listed(retrieval.keyword_search(q, copies, 7, most_terms=1))
    assert given == ["string"]


def test_dense_search_hands_on_the_best_only(spark, monkeypatch):
    """The scan finds what the blocks find, over equal vectors, zeros and small slices, and no more rows leave a task than its queries may have."""
    rng = random.Random(4)
    rows = [[float(rng.randrange(-3, 4)) for _ in range(6)] for _ in range(90)]
    vectors = spark.createDataFrame([(f"c{i:03d}", rows[i % 90] if i else [0.0] * 6) for i in range(400)], "chunk_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(rng.randrange(-3, 4)) for _ in range(6)], 1 + i % 9) for i in range(20)], "query_id long, embedding array<float>, top_k int")
    monkeypatch.setattr(vector_scan, "CELLS", 700)
    for k in (1, 5, 30, 500, "top_k"):
        assert listed(retrieval.dense_search(q, vectors, k)) == listed(retrieval.dense_search(q, vectors, k, query_rows=7, vector_rows=50))
    assert vector_scan.best_vectors(vectors, q.withColumn("limit", F.lit(4)).toPandas()).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 4 * 3
    assert retrieval.dense_search(q.limit(0), vectors).count() == 0 and retrieval.dense_search(q, vectors.limit(0)).count() == 0
    one = retrieval.dense_search(q, vectors.unionByName(spark.createDataFrame([("none", None)], vectors.schema)), 500)
    assert one.count() == 20 * 400


def test_index_takes_in_what_is_missing(spark, tmp_path):
    """A second refresh writes new and changed chunks only, drops what is gone, and equals an index built at once; a batch that was not
    committed is not read."""
    chunks, q, path, whole = corpus(spark), asked(spark), str(tmp_path / "index"), str(tmp_path / "whole")
    old = chunks.filter("doc_id < 40").withColumn("chunk_text", F.when(F.col("doc_id") == 7, "w1 w2 other text").otherwise(F.col("chunk_text")))
    assert keyword_index.refresh(old, path) == {"added": 202, "removed": 0}
    later = chunks.filter("doc_id >= 3 or doc_id = 1")
    assert keyword_index.refresh(later, path) == {"added": 100 + 5, "removed": 10 + 5}
    assert keyword_index.refresh(later, path) == {"added": 0, "removed": 0}
    keyword_index.refresh(later, whole)
    show = lambda p: sorted((r.chunk_id, r.term, r.tf) for r in keyword_index.postings(spark, p).collect())
    assert show(path) == show(whole) == sorted((r.chunk_id, r.term, r.tf) for r in retrieval.postings(later).collect())
    assert listed(keyword_index.search(q, path)) == listed(keyword_index.search(q, whole)) == listed(retrieval.keyword_search(q, later))
    for name in ("postings", "peaks", "chunks"):
        spark.read.parquet(f"{whole}/{name}/*").withColumn("batch", F.lit("broken")).write.parquet(f"{path}/{name}/broken")
    assert show(path) == show(whole) and keyword_index.refresh(later, path)["added"] == 0


def test_index_filters_and_tf(spark, tmp_path):
    """Bases, excluded documents, keywords and the scorer without statistics, against a loop over the chunks."""
    import math

    chunks, path = corpus(spark, 120), str(tmp_path / "index")
    keyword_index.refresh(chunks, path)
    kbs = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("kb1"))).when(F.col("query_id") % 3 == 1, F.array().cast("array<string>"))
    out = F.when(F.col("query_id") % 2 == 0, F.array(*(F.lit(x).cast("long") for x in (0, 3, 8))))
    q = asked(spark).withColumns({"kb_ids": kbs, "excluded_docs": out, "keywords": F.when(F.col("query_id") % 5 == 0, F.array(F.lit("w1"), F.lit("w3")))})
    want = []
    for r in q.collect():
        words = list(dict.fromkeys(" ".join([*(r["keywords"] or []), r["query"] or ""]).lower().split()))[:30]
        found = []
        for c in chunks.collect():
            tf = [(c.chunk_text or "").split().count(w) for w in words]
            if any(tf) and (r.kb_ids is None or c.kb_id in r.kb_ids) and c.doc_id not in (r.excluded_docs or []):
                found.append((round(sum(1 + math.log(n) for n in tf if n) / len(words), 6), c.chunk_id))
        want += [(r.query_id, c, s, i) for i, (s, c) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:4], 1)]
    got = listed(keyword_index.search(q, path, 4, scorer="tf"))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))


def grams(text):
    import re

    return frozenset(p[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for p in [f"  {w} "] for i in range(len(p) - 2))


def test_near_pairs_against_every_pair(spark):
    """Every pair of sets above the level is found once, hot trigrams dealt out or not; copies are members, not pairs."""
    rng = random.Random(6)
    base = [" ".join(f"{rng.choice('abcdefg')}{rng.choice('xyz')}{rng.randrange(9)}" for _ in range(9)) for _ in range(14)]
    texts = []
    for b in base:
        for k in (0, 0, 1, 2, 4):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(9)] = f"q{rng.randrange(99)}"
            rng.shuffle(w)
            texts.append(" ".join(w))
    texts += ["Élan VITAL!", "vital, élan", "", None, "...", "a"]
    rows = [(i % 23, i, f"c{i}", t, 1) for i, t in enumerate(texts)] + [(None, 0, "none", texts[0], 1)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, chunk_text string, class int")
    sets = {f"c{i}": (i % 23, grams(t)) for i, t in enumerate(texts) if grams(t)}
    ids = sorted(sets)
    want = {frozenset((sets[a][1], sets[b][1])) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) > 0.6 * len(sets[a][1] | sets[b][1])}
    for block in (2048, 3):
        pairs, members = near_pairs.near_duplicates(chunks, block=block)
        found = pairs.collect()
        assert len(found) == len(want) and {frozenset((sets[r.chunk_a][1], sets[r.chunk_b][1])) for r in found} == want
        for r in found:
            (da, a), (db, b) = sets[r.chunk_a], sets[r.chunk_b]
            assert da == r.doc_a < r.doc_b == db and abs(r.similarity - len(a & b) / len(a | b)) < 1e-12
        of = {}
        for m in members.collect():
            of.setdefault(m["class"], set()).add(sets[m.chunk_id][1])
        assert all(len(x) == 1 for x in of.values()) and members.count() == len(sets)
    assert near_pairs.near_duplicates(chunks.limit(0))[0].count() == 0
    top = near_pairs.closest(chunks, most=3).collect()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].similarity == 1.0


def test_closest_pairs_stop_at_the_first_level_that_has_enough(spark, monkeypatch):
    """The same pairs from any level down; equal sets alone are answered without a search for others below."""
    rng = random.Random(8)
    base = [[f"{rng.choice('abcdefg')}{rng.choice('xyz')}{rng.randrange(99)}" for _ in range(30)] for _ in range(6)]
    texts = [" ".join([*w[k:], *(f"r{j}{k}" for j in range(k))]) for w in base for k in (0, 0, 1, 2, 3, 5, 8)]
    chunks = spark.createDataFrame([(i % 17, i, f"c{i}", x) for i, x in enumerate(texts)], "doc_id long, chunk_index int, chunk_id string, chunk_text string")
    pairs = [(r.doc_a, r.index_a, r.doc_b, r.index_b, round(r.similarity, 6)) for r in near_pairs.near_duplicates(chunks)[0].collect()]
    asked, search = [], near_pairs.near_duplicates
    monkeypatch.setattr(near_pairs, "near_duplicates", lambda c, level: asked.append(level) or search(c, level))
    for most, levels in ((4, 1), (12, 3), (10**6, 6)):
        asked.clear()
        got = [tuple(r)[:5] for r in near_pairs.closest(chunks, most=most).orderBy("rank").collect()]
        assert got == sorted(pairs, key=lambda p: (-p[4], *p[:4]))[:most] and len(asked) <= levels


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abÉ1 _-.", max_size=30))
def test_trigrams_of_words(text):
    assert all(len(g) == 3 for g in grams(text)) and len(grams(text)) <= sum(len(w) + 1 for w in text.split()) + 2 * len(text)


def test_prefix_overlap_against_every_pair(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abc ") for _ in range(700))
    texts = [long, long[50:250], long[300:420], "x" * 20 + long[10:200], long[50:250], "short", None, "abc" * 60, "z" + "abc" * 60]
    rows = [(i % 4, f"c{i}", t, 1) for i, t in enumerate(texts)]
    got = {tuple(r) for r in near_pairs.prefix_overlap(spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_text string, head int")).collect()}
    assert got == {(f"c{i}", f"c{j}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 4 != j % 4 and a and b and len(b) >= 100 and b[:80] in a}


def test_prefix_overlap_shuffles_no_texts(spark):
    """Stretches that are no head stay where they are read, with few bits too, which only narrow less."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(40)]
    texts += [texts[i][:300] for i in range(5)] + ["é" + texts[7][:80]]
    c = spark.createDataFrame([(i, f"c{i}", x) for i, x in enumerate(texts)], "doc_id long, chunk_id string, chunk_text string")
    want = {(f"c{i}", f"c{j}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and len(b) >= 100 and b[:80] in a}
    for most in (1 << 28, 64):
        assert sorted(map(tuple, near_pairs.prefix_overlap(c, most_bits=most).collect())) == sorted(want) and len(want) == 11
    heads = spark.createDataFrame([(i,) for i in (5, -7, 2**62)], "h long")
    bits = near_pairs.bits_of(heads, 1 << 20)
    assert list(near_pairs.may_be(np.array([5, -7, 2**62], np.int64), bits)) == [0, 1, 2] and len(near_pairs.may_be(np.arange(10, 1010), bits)) < 600
    plan = near_pairs.prefix_overlap(c)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 2  # what is found, and the heads


def test_prefix_overlap_shuffles_few_anchors(spark):
    """Equal stretches share an anchor wherever they lie, and a text has far fewer anchors than stretches."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ü𝄞") for _ in range(n))
    texts = [text(n) for n in (80, 81, 100, 500, 4000)]
    texts += [x + text(60) + y[len(y) // 3 :] for x in texts for y in texts]
    batch = pa.RecordBatch.from_pydict({"ref": range(len(texts)), "doc_id": range(len(texts)), "chunk_text": texts})
    anchors = [(r["ref"], r["anchor"]) for b in near_pairs.anchors_of_texts([batch], 80, 40) for r in b.to_pylist()]
    assert len(anchors) < sum(len(x) - 79 for x in texts) / 12
    for i, x in enumerate(texts):
        at = sorted({0, len(x) - 80, rng.randrange(len(x) - 79)})
        heads = pa.RecordBatch.from_pydict({"b": [str(j) for j in at], "b_doc": at, "head": [x[j : j + 80] for j in at]}).rename_columns(["chunk_id", "doc_id", "chunk_text"])
        got = next(near_pairs.anchors_of_heads([heads], 80, 40)).to_pylist()
        assert [r["head"] for r in got] == [x[j : j + 80] for j in at] and all((i, r["anchor"]) in anchors for r in got)


def test_graph_search_finds_what_the_exact_search_finds(spark):
    """Recall of at least 0.95 over shards, with copies, on vectors without clusters; scores are the exact ones; a graph serves several searches."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 24)).astype(np.float32)
    x[2000:] = x[rng.integers(3, size=500)]
    rows = [(f"c{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame([*rows, ("null", None), ("zero", [0.0] * 24)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(v) for v in (x[i] if i % 2 else rng.normal(size=24))], 5 + i % 6) for i in range(60)] + [(99, None, 3), (98, [0.0] * 24, 3)], "query_id long, embedding array<float>, top_k int")
    graph, members = vector_graph.build_graph(vectors, shard_rows=700)
    assert members.count() == 2500 and graph.count() == 2000 and graph.select("shard").distinct().count() == 3
    for k in (10, "top_k"):
        want = {(r.query_id, r.chunk_id): r.score for r in retrieval.dense_search(q.filter("query_id < 90"), vectors.filter("chunk_id like 'c%'"), k).collect()}
        got = {(r.query_id, r.chunk_id): r.score for r in vector_graph.search(q, graph, members, k).collect()}
        assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
        assert all(abs(got[p] - want[p]) < 2e-6 for p in got.keys() & want.keys())
    empty = vector_graph.build_graph(vectors.limit(0))
    assert vector_graph.search(q, *empty).count() == 0


def test_flags_from_scores_alone_read_no_texts_of_hits(spark, monkeypatch):
    from conftest import SF

    from kbspark.plans import catalog, queries

    want = {n: sorted(map(tuple, catalog.QUERIES[n](spark, SF).collect())) for n in ("qlt1_quality_flags", "flt1_min_score")}
    monkeypatch.setattr(queries, "with_chunks", None)
    for name, rows in want.items():
        assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == rows and rows
