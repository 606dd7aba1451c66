import math
import random
import re
import zlib
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from kbspark.operators import chunking, evaluation, governance, intake, permissions, traces


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def pairs(text):
    t = "".join((text or "").split())
    return {t[i : i + 2] for i in range(len(t) - 1)}


def cited(sentences, hits, least):
    """Sentence by sentence; hits in order of rank as (chunk_id, doc_order, content, vector)."""
    used, last, out = set(), -1, []
    for i, (text, u) in enumerate(sentences):
        best, top = None, 0.0
        for chunk_id, at, content, v in hits:
            at = 9999 if at is None else at
            if u is not None and v is not None and len(u) == len(v):
                norm = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
                score = sum(x * y for x, y in zip(u, v)) / norm if norm else 0.0
            else:
                a, b = pairs(text), pairs(content)
                score = len(a & b) / len(a | b) if a and b else 0.0
            if chunk_id not in used and score >= least and (best is None or at >= last and score >= top):
                best, top, place = chunk_id, score, at
        if best is not None:
            used.add(best)
            last = place
            out.append((i, best, round(top, 3)))
    return out


def test_citations_by_vectors_and_pairs(spark):
    """Hits with a vector, with one of another length and without one, in one ordered choice for each answer."""
    rng = random.Random(5)
    said = ["The first sentence here.", "A second sentence there.", "The third sentence is here.", "Something else entirely so."]
    vector = lambda n=3: [float(rng.randrange(-2, 4)) for _ in range(n)]
    answers, hits, vectors, want = [], [], [], []
    for a in range(40):
        texts = [rng.choice(said) for _ in range(rng.randrange(1, 6))]
        rows = [(f"{a}-{i}", rng.choice([None, rng.randrange(5)]), rng.choice([*said, None]), rng.choice([None, vector(), vector(), vector(2)])) for i in range(6)]
        own = [vector() if rng.random() < 0.7 else None for _ in texts]
        answers.append((a, " ".join(texts)))
        hits += [(a, c, i, at, x, v) for i, (c, at, x, v) in enumerate(rows)]
        vectors += [(a, i, v) for i, v in enumerate(own) if v]
        want += [(a, *r) for r in cited(list(zip(texts, own)), rows, 0.5)] if len(texts) > 1 else []
    h = frame(spark, "answer_id long, chunk_id string, rank int, doc_order int, content string, embedding array<double>", *hits)
    v = frame(spark, "answer_id long, sentence_idx int, embedding array<float>", *vectors)
    a = frame(spark, "answer_id long, answer string", *answers, (99, None), (98, ""))
    got = sorted(map(tuple, intake.cite(a, h, 0.5, v).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(x[3] - y[3]) < 0.0011 for x, y in zip(got, want)) and len(got) > 40
    assert intake.cite(a.filter("false"), h, 0.5, v).count() == intake.cite(a, h.filter("false"), 0.5, v).count() == 0


def test_full_traces(spark):
    q = frame(spark, "query_id long, query string, rewritten string, intent string, n_subs int", (1, "q1", "r1", "complex", None), (2, "q2", "", "factoid", 3), (3, None, None, None, None))
    h = frame(spark, "query_id long, rank int, chunk_id string, doc_id long, source_file string, score double, chunk_text string", *[(1, i, f"c{i}", i, "f", 0.123456, "t" * 200) for i in range(1, 13)], (2, 1, "x", None, None, None, None))
    times = frame(spark, "query_id long, hybrid_ms long, rerank_ms long, planner_ms long, total_ms long", (1, 5, None, 2, 9))
    got = {r.query_id: r for r in traces.full_traces(q, h, times, frame(spark, "query_id long, dense_hits long, keyword_hits long", (1, 4, 8)), frame(spark, "query_id long, response string", (1, "a" * 600), (2, None))).collect()}
    r = got[1]
    assert (r.retrieval_path, r.n_sub_queries, r.top_k, r.hybrid_ms, r.rerank_ms, r.dense_hits, r.keyword_hits, len(r.response), r.rewritten_query) == ("dag", 0, 12, 5, 0, 4, 8, 500, "r1")
    assert [c.chunk_id for c in r.chunks] == [f"c{i}" for i in range(1, 11)] and r.chunks[0].score == 0.1235 and len(r.chunks[0].snippet) == 150
    assert (got[2].retrieval_path, got[2].n_sub_queries, got[2].rewritten_query, got[2].chunks[0].snippet, got[2].response) == ("simple", None, "q2", "", "")
    assert (got[3].original_query, got[3].rewritten_query, got[3].top_k, got[3].total_ms, got[3].chunks) == ("", "", 0, 0, None)


#: Scores whose fifth place is a half in decimals, with four places as DuckDB's round gives them.
HALVES = [(1.00185, "1.0018"), (1.00195, "1.0019"), (1.00395, "1.0039"), (0.123456, "0.1235"), (2.00005, "2.0001")]


def test_snapshots_round_as_their_sql(spark):
    h = frame(spark, "query_id long, rank int, chunk_id string, score double, chunk_text string", *[(1, i, "c", x, "t") for i, (x, _) in enumerate(HALVES, 1)])
    got = governance.build_traces(frame(spark, "query_id long", (1,)), h).first().snapshot
    assert [line.split("|")[2] for line in got.split("\n")] == [duckdb.sql(f"select printf('%.4f', round({x}::double, 4))").fetchall()[0][0] for x, _ in HALVES] == [y for _, y in HALVES]


def test_full_traces_round_as_their_sql(spark):
    h = frame(spark, "query_id long, rank int, chunk_id string, doc_id long, source_file string, score double, chunk_text string", *[(1, i, "c", 1, "f", x, "t") for i, (x, _) in enumerate(HALVES, 1)])
    none = "query_id long, " + ", ".join(f"{c} long" for c in [*traces.TIMES, "dense_hits", "keyword_hits"])
    q = frame(spark, "query_id long, query string, rewritten string, intent string, n_subs int", (1, "q", None, None, None))
    got = traces.full_traces(q, h, frame(spark, none, *[]), frame(spark, none, *[]), frame(spark, "query_id long, response string")).first().chunks
    assert [f"{c.score:.4f}" for c in got] == [y for _, y in HALVES]


def test_judges(spark):
    """The latest judgement counts whole, its nulls too; unknown and null ids are reported once."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    t = frame(spark, "trace_id long, source string, faithfulness double", (1, "web", 0.1), (2, "web", 0.2), (3, None, None))
    s = frame(spark, "trace_id long, ts timestamp, faithfulness double, answer_relevance double, context_relevance double, judge_model string, judge_latency_ms long", (1, at(0), 0.9, 0.8, 0.7, "a", 1), (1, at(5), None, 0.5, None, "b", None), (2, at(1), 0.4, None, None, "a", 3), (2, at(1), 0.6, None, None, "a", 3), (7, at(0), 1.0, 1.0, 1.0, "a", 1), (7, at(1), 1.0, 1.0, 1.0, "a", 1), (None, at(0), 1.0, 1.0, 1.0, "a", 1))
    judged = traces.apply_judge(t, s)
    got = {r.trace_id: (r.faithfulness, r.answer_relevance, r.judge_model) for r in judged.collect()}
    assert got == {1: (None, 0.5, "b"), 2: (0.6, None, "a"), 3: (None, None, None)}
    assert {r.trace_id for r in traces.missing_ids(t, s).collect()} == {7, None} and traces.missing_ids(t, s).count() == 2
    d = {r.metric: tuple(r)[1:] for r in traces.judge_dimensions(judged.withColumnRenamed("trace_id", "id"), ["faithfulness", "answer_relevance", "context_relevance"]).collect()}
    assert d == {"faithfulness": (1, 0.6, 0.6, 0.6), "answer_relevance": (1, 0.5, 0.5, 0.5), "context_relevance": (0, None, None, None)}
    assert traces.apply_judge(t, s.filter("false")).count() == 3 and traces.judge_dimensions(t.filter("false").withColumn("id", F.lit(1)), ["faithfulness"]).count() == 0


def test_span_durations(spark):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(microseconds=round(ms * 1000))
    s = frame(spark, "trace_id long, span_id string, parent_id string, node string, start_time timestamp, end_time timestamp", (1, "a", None, "n", at(0), at(2.9)), (1, "b", "a", "m", at(1), None), (1, "c", "lost", "m", at(0), at(9)), (2, "d", "2", "n", at(5), at(1)))
    assert sorted(map(tuple, traces.span_durations(s).select("span_id", "depth", "path", "duration_ms").collect())) == [("a", 0, "n", 2), ("b", 1, "n/m", 0), ("d", 0, "n", -4)]


def test_summary_actions(spark):
    m = frame(spark, "conv_id long", *[(1,)] * 9, *[(2,)] * 4, *[(3,)] * 4, *[(4,)] * 2, *[(5,)] * 4)
    s = frame(spark, "conv_id long, summary string", (1, "x" * 100), (2, "x" * 100), (3, "x"), (4, "x" * 100), (5, None))
    assert {(r.conv_id, r.overflow, r.action) for r in traces.summary_action(m, s, 1, 50, 4).collect()} == {(1, 4, "update"), (2, 0, "compress"), (3, 0, "none"), (5, 0, "none")}


def test_weighted_content_takes_from_texts_only(spark):
    c = frame(spark, "doc_id long, chunk_index int, chunk_id string, kind string, content string", (1, 0, "a", None, "a" * 20), (1, 1, "b", "table", "b" * 2000), (1, 2, "c", "text", "c" * 2000), (1, 3, "d", "text", None), (2, 0, "e", "text", "e"))
    got = {r.chunk_id: r.weighted for r in chunking.weighted_content(c).collect()}
    assert got == {"a": "a" * 20, "b": "\n".join(["b" * 2000, "aaa", "c" * 200]), "c": "c" * 2000, "d": "\n".join(["", "c" * 200]), "e": "e"}


def test_descendants_in_both_directions(spark):
    closure = permissions.group_closure(frame(spark, "group_id string, parent_group_id string", ("a", None), ("b", "a"), ("c", "b"), ("x", None)))
    assert sorted(map(tuple, permissions.descendants(closure).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert evaluation.span_stats(frame(spark, "node string, ms double", ("judge", 1.0), ("x", 2.0)), traces.NODES).count() == 1


def test_sampled_traces_by_crc(spark):
    got = {r.trace_id for r in evaluation.sample_traces(spark.range(2000).select(F.col("id").alias("trace_id"))).collect()}
    assert got == {i for i in range(2000) if zlib.crc32(str(i).encode()) % 100 < 5}


def test_sentences_against_a_loop(spark):
    """Parts up to an end mark; while a sentence is under ten characters, blanks counted, it takes the next part."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bc ", ".", "。", "!", "\n", "word ", "\u00a0"]) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    want = []
    for x in texts:
        out = []
        for part in re.findall(r"[^。！？.!?\n]+[。！？.!?\n]?", x):
            if out and len(out[-1]) < 10:
                out[-1] += part
            else:
                out.append(part)
        want.append([s.strip() for s in out])
    got = [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", evaluation.sentences(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == want
