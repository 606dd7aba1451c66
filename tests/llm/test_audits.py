"""Filter interaction audit, source mix and source divergence against plain versions."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

pytest.importorskip("kbspark.llm")
from kbspark.llm import divergence, filter_audit, mixing, registry  # noqa: E402


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def filter_rows():
    rng = random.Random(1)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, plain(rng.choice((10, 49, 50, 51, 90))), rng.choice(("a", "b", "é", None))) for i in range(60)]
    rows += [(100 + i, (rows[i][1] + rng.choice(("", " $", " | SHOUTING IN CAPITALS OVER AND OVER AGAIN", " again" * 40))), "a") for i in range(30)]
    rows += [(200 + i, rows[i % 7][1], rng.choice("ab")) for i in range(40)] + [(3, rows[3][1], "b"), (3, rows[3][1], "b")]
    rows += [(300, None, None), (301, "", ""), (None, "", "a"), (None, rows[4][1], "a"), (None, "only without id", "a"), (None, "only without id", "b"), (302, "  x " * 60, "a"), (303, "word " * 100_000 + "%", "c")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def test_filter_audit_against_applying_the_filters(spark):
    rows, labels = filter_rows()
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    last = float("inf")
    fails = []
    for i, t, _ in rows:
        w, t = words(t), t or ""
        mine = last if i is None else i
        fails.append({n for n, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), any((x or "") == t and j is not None and j < mine for j, x, _ in rows)), strict=True) if f})
    assert set.union(*fails) == set("ABCDE")
    want = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(r, f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, n in enumerate(order, 1):
                gone, kept = [x for x in left if n in x[1]], [x for x in left if n not in x[1]]
                early = sum(n in f for _, f in mine) - len(gone)
                want[part, "".join(order), step] = [len(kept), len(gone), early, sum(f == {n} for _, f in mine), sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone)]
                total[n] += len(gone)
                left = kept
        for p, order, step in list(want):
            if p == part:
                want[p, order, step].append(total[order[step - 1]])
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, key string")
    got = filter_audit.audit(docs.repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.MEASURES] for r in got.collect()} == want
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def mixed_rows():
    rng = random.Random(2)
    n = {"a": 400, "b": 30, "c": 250, "d": 1, "e": 3, None: 60, "\U00010000": 20, "￿": 20, "z": 2}
    rows = [(i, " ".join(["w"] * rng.choice((1, 3, 8, 20, 300))), s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    return rows + [(5000, "", "z"), (5001, None, "none"), (None, "x y", "b"), (None, "x y", "b"), (7, rows[7][1], "a")]


def poured(sizes):
    """Targets by their definition, in fractions: what is above twice a source's size goes to the others until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, stopped = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        per = (left - sum(stopped.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if per * weight[s] > 2 * sizes[s]]
        if not over:
            return stopped | {s: per * weight[s] for s in open_}
        stopped |= {s: Fraction(2 * sizes[s]) for s in over}


def test_mix_meets_its_targets(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, source string, p double, s string")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, most = poured(sizes), {s: max(len(words(t)) for _, t, x in rows if x == s) for s in sizes}
    show = lambda f: sorted((str(r.doc_id), r.source or "-", r.size, r.copies) for r in f.collect())
    for fan, cap in ((8192, 100_000), (4, 100_000), (16, 1)):  # one group, a deep tree, sources by shuffle
        plan = mixing.mix(docs, fan=fan, max_broadcast=cap)
        got = plan.collect()
        assert sorted((str(r.doc_id), r.source or "-", r.size) for r in got) == sorted((str(i), s or "-", len(words(t))) for i, t, s in rows)
        taken = defaultdict(int)
        for r in got:
            assert r.target == pytest.approx(float(want[r.source])) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
            assert r.copies in (int(want[r.source] / max(1, sizes[r.source])), int(want[r.source] / max(1, sizes[r.source])) + 1)
            taken[r.source] += r.copies * r.size
        assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
        assert show(plan) == show(mixing.mix(docs.repartition(5, "text"), fan=fan, max_broadcast=cap))  # reruns agree, however rows are dealt
    out = mixing.taken_documents(docs, plan)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.digest(mixing.mix(docs.filter("coalesce(text, '') = ''"))).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_rounding_keeps_expectations():
    """Copies of a row over many draws, and the sum of words with each."""
    rng = random.Random(3)
    sizes, n = [1, 2, 3, 5, 40], 4000
    hits = [0] * 5
    for _ in range(n):
        page = pd.DataFrame({"s": 1, "bucket": 0, "size": sizes, "p": 0.3, "u": [rng.random() for _ in sizes], "row": range(5)})
        got = pd.concat(mixing.settle(iter([page.iloc[:2], page.iloc[2:2], page.iloc[2:]]))).sort_values("row")
        assert (got["p"] * got["size"]).sum() == pytest.approx(0.3 * 51) and ((got["p"] > 0) & (got["p"] < 1)).sum() <= 1
        for i, p in enumerate(got["p"]):
            hits[i] += p
    assert all(abs(h / n - 0.3) < 0.03 for h in hits)


def divergence_rows():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("un", "dé", "TRO", "ß", "日本") for b in "abcdefghijkl"]
    rows = []
    for lang, n in (("en", 300), ("fr", 200), (None, 20)):
        for _ in range(n):
            source = rng.choice(("s0", "s0", "s1", "s2", "é3", None))
            few = vocabulary[: {"s0": 60, "s1": 30, "s2": 50}.get(source, 40)]
            rows.append((lang, source, " ".join(rng.choice(few) + rng.choice(("", ",", "1", "-")) for _ in range(rng.randrange(25)))))
    rows += [("en", "s1", rows[5][2])] * 70 + [("en", "s2", rows[5][2])] * 9 + [("de", "s0", "rare"), ("de", "s9", None), ("xx", "alone", "x"), ("en", "wordless", "12 34"), ("en", "s0", "long " * 60_000)]
    return rows


def diverging(rows, least=30, top=50):
    docs = defaultdict(list)
    for lang, source, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)))
    out = set()
    for lang, own in docs.items():
        df = Counter(t for _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for source, w in own:
            counts[source].update(t for t in w if df[t] >= least)
        whole = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in [*counts.items(), (("all",), whole)]}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - p[("all",)][t], t) for t in kept if counts[s][t] and p[s][t] > p[("all",)][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_divergence_against_its_definition(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, None, 1, "x") for r in rows], "lang string, source string, text string, doc_id long, n int, term string")
    want = diverging(rows)
    assert {x[2] for x in want} == {"pair", "term"}
    for options in ({}, {"width": 2, "height": 7, "room": 50}):  # one block, and many blocks with a task's table that fills up
        got = divergence.divergence(docs, **options).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert divergence.divergence(docs.limit(0)).count() == 0
    assert {tuple(r) for r in divergence.divergence(docs, top=2).collect()} == diverging(rows, top=2)


def test_counts_beyond_a_long_times_a_thousand_million(spark):
    r = spark.range(1).select(divergence.share(F.lit(8 * 10**14), F.lit(9 * 10**15), F.lit(10**6)).alias("p")).first()
    assert r.p == 1 + 10**9 * (8 * 10**14 + 5) // (9 * 10**15 + 5 * 10**6)


def test_mix_of_the_given_documents(spark):
    got = registry.op12_source_mix(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
