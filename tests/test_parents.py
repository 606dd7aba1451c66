import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import keyword_index, parents, retrieval

BLOCKS = "doc_id long, block_idx int, kind string, layout_type string, text string, html string, caption string, page_num int"


def random_blocks(seed, n_docs=30):
    rng = random.Random(seed)
    kinds, layouts = ["text"] * 6 + [None, "table", "image", "formula"], ["text"] * 5 + [None, "title", "equation", "reference", "header"]
    return [
        (d, i, rng.choice(kinds), rng.choice(layouts), rng.choice(["", None, "x" * rng.randrange(1, 90), "y" * 250]), rng.choice([None, "<table/>"]), rng.choice([None, "", "cap"]), rng.choice([None, i // 3]))
        for d in range(n_docs) for i in range(rng.randrange(0, 25))
    ]


def packed(rows, most):
    """Parents of one document's blocks, block by block."""
    done, open_rows, heading = [], [], ""

    def close():
        if open_rows:
            done.append(("text", heading, "\n\n".join(t for t, _ in open_rows), open_rows[0][1], open_rows[-1][1]))
            open_rows.clear()

    for _, _, kind, layout, text, html, caption, page in rows:
        kind, layout, text = kind or "text", layout or "text", text or ""
        if kind == "text" and layout in ("text", "equation"):
            size = lambda t: max(1, len(t) // 2)
            if sum(size(t) for t, _ in open_rows) + size(text) > most:
                close()
            open_rows.append((text, page))
            continue
        close()
        if kind == "text" and layout == "title":
            heading = text[:100]
            done.append(("text", heading, text, page, page))
        elif kind == "table":
            done.append(("table", heading, "\n".join(x for x in (text, html) if x), page, page))
        elif kind == "image":
            done.append(("image", heading, "\n".join(x for x in (text, caption and f"[图片说明: {caption}]") if x) or "[图片]", page, page))
    close()
    return done


@pytest.mark.parametrize("seed", [1, 2])
def test_parents_block_by_block(spark, seed):
    rows = random_blocks(seed)
    got = parents.build_parents(spark.createDataFrame(rows, BLOCKS).repartition(3), 150).orderBy("doc_id", "parent_index").collect()
    for d in range(30):
        want = packed([r for r in rows if r[0] == d], 150)
        assert [(r.kind, r.heading, r.content, r.start_page, r.end_page) for r in got if r.doc_id == d] == want
        assert [r.parent_index for r in got if r.doc_id == d] == list(range(len(want)))
    assert len({r.parent_id for r in got}) == len(got)


def test_parents_keep_all_kept_text(spark):
    """Also one text of a million characters, repeated rows, columns of clashing names, and no rows."""
    rows = [(1, i, "text", "text", f"w{i} " * 40) for i in range(50)] + [(1, 50, "text", "equation", "z" * 1_000_000), (2, 0, None, None, "twice"), (2, 0, None, None, "twice")]
    b = spark.createDataFrame(rows, "doc_id long, block_idx int, kind string, layout_type string, text string").withColumns({"parent_index": F.lit(9), "heading": F.lit("mine"), "use": F.lit(0)})
    letters = lambda df, c: sorted("".join("".join(sorted(r[0] or "")) for r in df.select(c).collect()).replace("\n", ""))
    p = parents.build_parents(b)
    assert letters(b, "text") == letters(p, "content") and {r.heading for r in p.collect()} == {""} and p.filter("n_blocks > 1 and tokens > 600").count() == 0
    assert letters(b, "text") == letters(parents.parent_children(b), "content")
    assert parents.build_parents(b.filter("false")).count() == parents.parent_children(b.filter("false")).count() == 0


def test_relations_stay_within_a_parent(spark):
    b = spark.createDataFrame([(1, 0, "text", "title", "Head"), (1, 1, "text", "text", "A sentence of some length. " * 40), (1, 2, "table", "text", "t"), (2, 0, "text", "text", "short")], "doc_id long, block_idx int, kind string, layout_type string, text string")
    c = parents.parent_children(b)
    rows = {r.chunk_id: r for r in parents.parent_relations(c).collect()}
    by_place = c.orderBy("doc_id", "chunk_index").collect()
    assert len(rows) == len(by_place) and len(by_place) > 4
    for x, y in zip(by_place, by_place[1:]):
        together = x.parent_id == y.parent_id
        assert rows[x.chunk_id].next_id == (y.chunk_id if together else None) and rows[y.chunk_id].prev_id == (x.chunk_id if together else None)
    loose = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", None), (1, 2, "c", "p")], "doc_id long, chunk_index int, chunk_id string, parent_id string")
    assert sorted(map(tuple, parents.parent_relations(loose).select("chunk_id", "prev_id", "next_id").collect())) == [("a", None, "b"), ("b", "a", None), ("c", None, None)]


def test_sub_queries_are_searched_as_if_alone(spark, tmp_path):
    """Each sub-query finds what a search of it alone finds; a question keeps the first hit of a chunk; blank and null ones find nothing."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    chunks = spark.createDataFrame([(f"c{i:03d}", i // 4, "kb", " ".join(word() for _ in range(12))) for i in range(120)], "chunk_id string, doc_id long, kb_id string, chunk_text string")
    vectors = spark.createDataFrame([(f"c{i:03d}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)], "chunk_id string, embedding array<double>")
    asked = [(1, "w1 w2 和 w3 与 w4 w1", 2), (2, "w5 w6", 3), (3, "", 2), (4, None, 2), (5, "w1 和 w1", 2)]
    subs = parents.sub_queries(spark.createDataFrame(asked, "query_id long, query string, top_k int"))
    texts = {(r.query_id, r.sub_id): r["query"] for r in subs.collect()}
    assert texts == {(1, 0): "w1 w2", (1, 1): "w3", (1, 2): "w4 w1", (2, 0): "w5 w6", (3, 0): "", (4, 0): None, (5, 0): "w1", (5, 1): "w1"}
    path = str(tmp_path / "index")
    keyword_index.refresh(chunks, path)
    search = lambda q, k: keyword_index.search(q, path, k)
    v = spark.createDataFrame([(q, s, [1.0, float(q), float(s), 0.5]) for q, s in texts if (q, s) != (2, 0)], "query_id long, sub_id int, embedding array<double>")
    hits = parents.multi_query(subs, v, vectors, search)
    got = sorted((r.query_id, r.list, r.rank, r.chunk_id) for r in hits.collect())
    want, groups = [], {}
    for (q, s), text in texts.items():
        one = subs.filter(f"query_id = {q} and sub_id = {s}").select("query_id", "query", "top_k")
        alone = retrieval.hybrid_search(one, v.filter(f"query_id = {q} and sub_id = {s}"), vectors, search).orderBy("rank").collect() if text else []
        want += [(q, s, r.rank, r.chunk_id) for r in alone]
        groups[q, s] = [r.chunk_id for r in alone]
    assert got == sorted(want) and {q for q, *_ in got} == {1, 2, 5}
    seen = {}
    for q, s, _, c in sorted(want):
        seen.setdefault((q, c), s)
    assert {(r.query_id, r.chunk_id): r.list for r in retrieval.merge_lists(hits).collect()} == seen
    assert {(r.query_id, r.list): r.chunk_ids.split(",") for r in retrieval.groups_of(hits).collect()} == {k: g for k, g in groups.items() if g}
