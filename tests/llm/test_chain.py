"""The classifier chain against a plain version of it, and on rows that it was not fitted on."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kbspark.llm")
from kbspark.llm import toxicity  # noqa: E402


def test_chain_against_a_plain_version(spark):
    """Choice of features by chi-square, earlier probabilities out of fold, and prediction, worked out row by row on dense matrices."""
    rng, n, folds, most = random.Random(7), 240, 3, 25
    mild, rude, poor = ([f"{p}{a}{b}" for a in "aeiou" for b in "lmnr"] for p in ("mi", "gr", "po"))
    texts, labels = [], []
    for i in range(n):
        bad, low = rng.random() < 0.4, rng.random() < 0.5
        w = [rng.choice(mild) for _ in range(8)] + [rng.choice(rude) for _ in range(3 * bad)] + [rng.choice(poor) for _ in range(3 * low)]
        rng.shuffle(w)
        texts.append(" ".join(w) + (" | SOME" if low else ""))
        labels.append((i, int(not low), int(bad)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_features=most, folds=folds)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(folds)).alias("f")).collect()}

    words = [toxicity.TOKEN.findall(t.lower()) for t in texts]
    has = [{f for x in w for f in toxicity.word_features(x)} for w in words]
    ys = np.array([(1 - q, t, t * (1 - q)) for _, q, t in labels], float)
    seen = {f for h in has for f in h if sum(f in g for g in has) >= 5}
    chosen = set()
    for y in ys.T:
        k = y.sum()

        def chi(f, y=y, k=k):
            c = sum(f in h for h in has)
            return (sum(v for v, h in zip(y, has, strict=True) if f in h) * n - c * k) ** 2 / (c * (n - c + 1) * (k * (n - k) + 1))

        chosen |= set(sorted(seen, key=lambda f: (-chi(f), f))[:most])
    assert set(chain.index) == chosen
    at = {f: i for i, f in enumerate(sorted(chosen))}
    rows = [np.array(sorted(at[f] for f in h if f in at), int) for h in has]
    dense, place = np.array([toxicity.shares(t, w) for t, w in zip(texts, words, strict=True)]), np.array([fold[i] for i in range(n)])

    def probability(w, some, x):
        full = np.array([np.bincount(rows[i], minlength=len(at)) for i in some])
        return 1 / (1 + np.exp(-(full @ w[: len(at)] + x @ w[len(at) : -1] + w[-1])))

    earlier, p = np.zeros((n, 0)), np.zeros((n, 0))
    for y in ys.T:
        w = toxicity.fit(rows, np.column_stack([dense, earlier]), y, len(at))
        p = np.column_stack([p, probability(w, range(n), np.column_stack([dense, p]))])
        unseen = np.zeros(n)
        for k in range(folds):
            a, b = np.flatnonzero(place != k), np.flatnonzero(place == k)
            v = toxicity.fit([rows[i] for i in a], np.column_stack([dense, earlier])[a], y[a], len(at))
            unseen[b] = probability(v, b, np.column_stack([dense, earlier])[b])
        earlier = np.column_stack([earlier, unseen])
    got = {r.doc_id: [r[f"p_{name}"] for name, _ in toxicity.CHAIN] for r in toxicity.score(docs, chain).collect()}
    assert np.abs(np.array([got[i] for i in range(n)]) - p).max() < 0.02
    assert np.mean((p[:, 1] >= 0.5) == ys[:, 1]) > 0.95


def test_held_out_rows(spark):
    """Fitted on four fifths of the labelled rows of sf 0.1 (some 3,000): measured on the last fifth, 69 of 97 toxic rows are found and 2 of
    728 clean ones flagged. The bars hold that level; with the 20,000 rows of larger tables nearly all are found (README)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    last = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chain = toxicity.train(docs.select("doc_id", "text"), labels.filter(~last))
    held = docs.select("doc_id", "text").join(labels.filter(last), "doc_id")
    r = toxicity.score(held, chain).groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("p_toxic") >= 0.5).alias("found")).collect()
    by = {x.toxic: (x.n, x.found) for x in r}
    assert by[1][0] > 50 and by[1][1] >= 0.67 * by[1][0] and by[0][1] <= 0.005 * by[0][0], by


def test_odd_texts_are_scored(spark):
    """Repeated rows score alike, null and empty texts as empty, a very long text whole; names of the scores give way."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["vile word here", "kind word here"] * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, (i + 1) % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    rows = [(1, "vile word here", 5.0), (1, "vile word here", 5.0), (None, "vile word here", 5.0), (2, None, 5.0), (3, "", 5.0), (4, "kind " * 200_000 + "vile", 5.0)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, p_toxic double"), chain)
    p = [r.p_toxic for r in got.collect()]
    assert got.columns[:2] == ["doc_id", "text"] and len(p) == 6 and p[0] == p[1] == p[2] > 0.5 and p[3] == p[4]
    assert zlib.crc32(b"=vile") in chain.index
    assert toxicity.score(docs.limit(0), chain).count() == 0
