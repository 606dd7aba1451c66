import duckdb
import pytest
from conftest import SF

from kbspark.functions import questions as fq
from kbspark.functions import text as tx
from kbspark.operators import access, evaluation, governance, permissions, retrieval
from kbspark.plans.catalog import ORACLES, QUERIES
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "None" if str(v) in ("None", "nan", "NaT", "<NA>") else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_rrf_two_lists(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, chunk_id string, rank int")
    got = [(r.chunk_id, r.n_lists) for r in retrieval.rrf([a, b]).orderBy("rank").collect()]
    assert got == [("y", 2), ("x", 1), ("z", 1)]


def test_closure_ends_on_a_cycle(spark):
    g = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "group_id string, parent_group_id string")
    got = {(r.group_id, r.ancestor) for r in permissions.group_closure(g).collect()}
    assert got == {("a", "a"), ("a", "b"), ("b", "b"), ("b", "a"), ("c", "c")}


def test_masks(spark):
    d = spark.createDataFrame([("call 13812345678 or a.b@c.org 6222021234567890",)], "text string")
    assert d.select(tx.mask_pii(F.col("text"))).first()[0] == "call 138****5678 or a.b***@c.org 6222****7890"


def test_sentences_take_what_follows_when_short(spark):
    d = spark.createDataFrame([("Hi. This is a whole sentence. Yes!",), ("",), (None,)], "text string")
    got = [r[0] for r in d.select(evaluation.sentences(F.col("text"))).collect()]
    assert got == [["Hi. This is a whole sentence.", "Yes!"], [], None]


def test_permissions_in_both_forms(spark):
    d = spark.createDataFrame([('["read","write"]',), ('{"read": true, "write": false}',), ("[]",), ("broken",), ("[broken",)], "p string")
    got = [r[0] for r in d.select(access.parse_permissions(F.col("p"))).collect()]
    assert got == [["read", "write"], ["read"], [], [], []]


def test_user_allow_overrides_a_group_deny(spark):
    standing = spark.createDataFrame([(1, "s", None, False, True), (2, "s", None, False, False), (3, "s", None, True, False)], "user_id long, space_id string, explicit string, is_global boolean, is_member boolean")
    kbs = spark.createDataFrame([("a", "s", "space_wide"), ("b", "s", "restricted")], "kb_id string, space_id string, visibility string").withColumn("deleted_at", F.lit(None).cast("date"))
    aces = spark.createDataFrame([("s", "kb", "a", "group", "g", None, "deny"), ("s", "kb", "b", "group", "g", None, "deny"), ("s", "kb", "b", "user", "1", None, "allow")], "space_id string, resource_type string, resource_id string, principal_type string, principal_id string, role_id string, effect string")
    admitted = spark.createDataFrame([(1, "s", "g")], "user_id long, space_id string, group_id string")
    got = {(r.user_id, r.kb_id) for r in access.accessible_kbs(standing, kbs, aces, admitted).collect()}
    assert got == {(1, "b"), (3, "a"), (3, "b")}


def test_excluded_documents_against_every_pair(spark):
    """Sets of groups, entries for users, none at all; the pairs of a request and a document are not shuffled."""
    import random

    rng = random.Random(4)
    standing = [(u, f"s{u % 3}", "admin" if u % 11 == 0 else None, u % 13 == 0, True) for u in range(60)] + [(7, "s0", None, False, False)]
    admitted = {(u, s, g) for u, s, *_ in standing for g in "abcd" if rng.random() < 0.4}
    docs = [(i, f"s{i % 3}", i % 4 == 0, "active" if i % 5 else "gone") for i in range(90)]
    aces = [(s, "document", str(i), "group", rng.choice("abcdz"), "r", rng.choice(["allow", "allow", "deny"])) for i, s, *_ in docs for _ in range(rng.randrange(3))]
    aces += [(s, "document", str(i), "user", str(rng.randrange(9)), "r", rng.choice(["allow", "deny"])) for i, s, *_ in docs if i % 3]
    want = set()
    for u, s, explicit, everywhere, _ in standing:
        for i, at, inherit, status in docs:
            if at == s and not inherit and status == "active" and not everywhere and explicit is None:
                hit = [e for x, _, r, kind, p, _, e in aces if x == s and r == str(i) and (p == str(u) if kind == "user" else (u, s, p) in admitted)]
                want |= {(u, s, i)} if not hit or "deny" in hit else set()
    frames = (spark.createDataFrame(standing, "user_id long, space_id string, explicit string, is_global boolean, is_member boolean"), spark.createDataFrame(docs, "doc_id long, space_id string, inherit_permissions boolean, status string"),
              spark.createDataFrame(aces, "space_id string, resource_type string, resource_id string, principal_type string, principal_id string, role_id string, effect string"), spark.createDataFrame(sorted(admitted), "user_id long, space_id string, group_id string"))
    for block in (4096, 5):
        got = [tuple(r) for r in access.excluded_docs(*frames, block=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_excluded_documents_take_little_room(spark, tmp_path):
    """Written as they come, 1,785,000 pairs take a fraction of a byte each; lists that are too long for every task give the same rows."""
    s = spark.range(300).select(F.col("id").alias("user_id"), F.lit("s0").alias("space_id"), F.lit(None).cast("string").alias("explicit"), F.lit(False).alias("is_global"), F.lit(True).alias("is_member"))
    docs = spark.range(6000).select((F.col("id") * 7).alias("doc_id"), F.lit("s0").alias("space_id"), F.lit(False).alias("inherit_permissions"), F.lit("active").alias("status"))
    aces = docs.filter("doc_id < 700").select("space_id", F.lit("document").alias("resource_type"), F.col("doc_id").cast("string").alias("resource_id"), F.lit("group").alias("principal_type"), F.lit("g").alias("principal_id"), F.lit("r").alias("role_id"), F.lit("allow").alias("effect"))
    admitted = s.filter("user_id % 2 = 0").select("user_id", "space_id", F.lit("g").alias("group_id"))
    access.excluded_docs(s, docs, aces, admitted).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.countDistinct("user_id", "doc_id")).first() == (1_785_000, 1_785_000)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1_785_000 / 2
    few = access.excluded_docs(s.filter("user_id < 40"), docs, aces, admitted, run=8, most=100)
    assert few.exceptAll(spark.read.parquet(str(tmp_path / "out"))).isEmpty() and few.count() == 20 * 6000 + 20 * 5900


def test_deep_trees_are_whole(spark):
    n = 100
    spans = spark.createDataFrame([(1, f"s{i}", f"s{i - 1}" if i else None, "n") for i in range(n)] + [(1, "x", "lost", "n"), (2, "a", "b", "n"), (2, "b", "a", "n"), (2, "r", "2", "n")], "trace_id long, span_id string, parent_id string, node string")
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in evaluation.span_tree(spans).collect()}
    assert len(got) == n + 1 and got[1, "s99"] == (99, "/".join("n" * 100)) and got[2, "r"] == (0, "n")
    groups = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)], "group_id string, parent_group_id string")
    assert permissions.group_closure(groups).count() == n * (n + 1) // 2


def test_questions_of_each_kind(spark):
    kinds = [("你好", "short_query_no_marker", True), ("hello", "short_query_no_marker", True), ("你好啊想问问题", "short_query_no_marker", False), ("对比 A 和 B vs. C", "complex_marker", False), ("", "empty_query", False), ("企业知识库系统的整体架构说明文档目录", "noun_phrase", False), ("如何在生产环境中部署这个系统并且完成配置", "default", False), (None, "empty_query", False)]
    got = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(kinds)], "i int, q string").select("i", fq.plan_reason(F.col("q")).alias("r"), fq.is_chitchat(F.col("q")).alias("c")).orderBy("i").collect()
    assert [(r.r, r.c) for r in got] == [k[1:] for k in kinds]
    one = lambda c, q: spark.createDataFrame([(q,)], "q string").select(c(F.col("q"))).first()[0]
    assert one(fq.split_compare, "A 和 B 与 C") == ["A", "B", "C"] and one(fq.split_compare, "A") == []
    assert one(fq.extract_keywords, "Ubuntu 22.04 部署 setup.sh 的 ERR-500 NginxConf") == ["22.04", "ERR-500", "setup.sh", "NginxConf", "Ubuntu", "部署"]


def test_masks_of_whole_documents(spark):
    c = spark.createDataFrame([(1, 0, "call 13812345678"), (1, 1, "mail a.b@c.org"), (2, 0, "nothing"), (3, 0, None)], "doc_id long, chunk_index int, chunk_text string")
    got = sorted((r.doc_id, r.chunk_index, r.chunk_text, r.sensitive) for r in governance.mask_blocks(c).collect() if r.doc_id < 3)
    assert got == [(1, 0, "call 138****5678", True), (1, 1, "mail a.b***@c.org", True), (2, 0, "nothing", False)]
    docs = spark.createDataFrame([(1, "13812345678 and 13912345678, 6222021234567890 x@y.org"), (2, "13812345678"), (3, None)], "doc_id long, text string")
    assert {r.rule: (r.hits, r.n_docs) for r in governance.mask_report(docs).collect()} == {"id_number": (0, 0), "mobile": (3, 2), "bank_card": (1, 1), "salary": (0, 0), "email": (1, 1)}


def test_written_chunks_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "chunk_id string, doc_id long")
    for _ in range(2):
        governance.write_chunks(rows, f"{tmp_path}/chunks")
    governance.write_chunks(spark.createDataFrame([("b", 1), ("c", 2)], "chunk_id string, doc_id long"), f"{tmp_path}/chunks")
    assert sorted(r.chunk_id for r in spark.read.parquet(f"{tmp_path}/chunks").collect()) == ["a", "b", "c"]
