"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model after the first also sees the probabilities of the earlier ones. In
training those come from models that were fitted without the row at hand (out of fold), as they will be at prediction. Features: which
words and word beginnings a text has (those that tell a category apart, by chi-square over the training rows) and a few shares of
characters. Presence is not diluted by a text's length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialize, text_or_empty

TOKEN = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile(r"[A-ZÀ-Þ]")
BEGINNINGS = (3, 4, 5, 6)
#: Order of the chain: name and label, from columns quality and toxic of the labels.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"), ("toxic_low_quality", "toxic * (1 - quality)"))


def word_features(word: str) -> list[int]:
    b = [zlib.crc32(b"=" + word.encode())]
    return b + [zlib.crc32(b"^" + word[:n].encode()) for n in BEGINNINGS if len(word) > n]


def shares(text: str, words: list[str]) -> list[float]:
    """Shares of capitals, of signs, of bars and of repeated words, and the mean length of a word; each about 0 to 1."""
    n, letters = max(1, len(text)), sum(map(len, words))
    signs = n - letters - text.count(" ") - text.count("\n")
    return [len(CAPITAL.findall(text)) / n, signs / n, min(1.0, text.count("|") / max(1, len(words))), 1 - len(set(words)) / max(1, len(words)), min(1.0, letters / max(1, len(words)) / 20)]


N_SHARES = 5


@dataclass
class Chain:
    names: list[str]
    index: dict[int, int]
    models: list[np.ndarray]

    def features(self, text: str, known: dict[str, tuple]) -> tuple[np.ndarray, list[float]]:
        words = TOKEN.findall(text.lower())
        got: set[int] = set()
        for w in set(words):
            at = known.get(w)
            if at is None:
                at = tuple(self.index[f] for f in word_features(w) if f in self.index)
                if len(known) > 500_000:
                    known.clear()
                known[w] = at
            if at:
                got.update(at)
        return np.fromiter(sorted(got), np.int64, len(got)), shares(text, words)

    def predict(self, words: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        if not self.models:
            return np.zeros((len(words), len(self.names)))
        p = np.zeros((len(words), 0))
        for w in self.models:
            p = np.column_stack([p, logistic(margin(w, words, np.column_stack([dense, p]), len(self.index)))])
        return p


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Feature numbers of many rows end to end. Sums go over some 2000 rows at a time, so that their scratch space stays small."""

    STEP = 2000

    def __init__(self, words: list[np.ndarray]) -> None:
        self.cuts = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
        self.col = np.concatenate([np.zeros(0, np.int32), *words]).astype(np.int32)

    def parts(self):
        for a in range(0, len(self.cuts) - 1, self.STEP):
            b = min(a + self.STEP, len(self.cuts) - 1)
            yield a, b, self.col[self.cuts[a] : self.cuts[b]], np.repeat(np.arange(b - a), np.diff(self.cuts[a : b + 1]))

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each row the sum of its features' weights."""
        return np.concatenate([np.zeros(0), *(np.bincount(row, w[col], b - a) for a, b, col, row in self.parts())])

    def sums(self, e: np.ndarray, n: int) -> np.ndarray:
        """For each of n features the sum of e over its rows."""
        out = np.zeros(n)
        for a, b, col, row in self.parts():
            out += np.bincount(col, e[a:b][row], n)
        return out


def margin(w: np.ndarray, words: list[np.ndarray], dense: np.ndarray, n: int) -> np.ndarray:
    return Rows(words).times(w) + dense @ w[n:-1] + w[-1]


def fit(words: list[np.ndarray], dense: np.ndarray, y: np.ndarray, n: int, steps: int = 40, ridge: float = 1e-4, memory: int = 8) -> np.ndarray:
    """Logistic regression by limited-memory quasi-Newton steps (L-BFGS) over all rows: weights of n words, of the dense columns, and the
    intercept. The sums over the rows' words are linear, so that the length of a step is found by halving without another pass."""
    w = np.zeros(n + dense.shape[1] + 1)
    base = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(base / (1 - base))
    if not len(y) or y.min() == y.max():
        return w
    rows, shrunk = Rows(words), np.ones_like(w)
    shrunk[-1] = 0

    def over_rows(v: np.ndarray) -> np.ndarray:
        return rows.times(v) + dense @ v[n:-1] + v[-1]

    def gradient(at: np.ndarray, w: np.ndarray) -> np.ndarray:
        e = logistic(at) - y
        return np.concatenate([rows.sums(e, n), dense.T @ e, [e.sum()]]) / len(y) + ridge * shrunk * w

    at = over_rows(w)
    g = gradient(at, w)
    past: list[tuple[np.ndarray, np.ndarray]] = []  # steps and how the gradient changed with them
    for _ in range(steps):
        if np.abs(g).max() < 1e-5:
            break
        d, back = -g, []
        for s, c in reversed(past):
            back.append(s @ d / (s @ c))
            d = d - back[-1] * c
        if past:
            d = d * (s0 @ c0) / (c0 @ c0)
        for (s, c), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - c @ d / (s @ c))
        along, wd, dd = over_rows(d), (shrunk * w) @ d, (shrunk * d) @ d

        def rise(t: float) -> float:
            return (logistic(at + t * along) - y) @ along / len(y) + ridge * (wd + t * dd)

        low, high = 0.0, 1.0
        while rise(high) < 0 and high < 1e6:
            low, high = high, 2 * high
        for _ in range(12):
            half = (low + high) / 2
            low, high = (half, high) if rise(half) < 0 else (low, half)
        s0, w, at = high * d, w + high * d, at + high * along
        c0, g = -g, gradient(at, w)
        c0 = c0 + g
        if s0 @ c0 <= 1e-14:
            break
        past = [*past, (s0, c0)][-memory:]
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 3000, folds: int = 4) -> Chain:
    """Fits the chain on at most about max_rows labelled rows, chosen by a hash of their doc_id. Labels with nulls are left out; several rows
    of one doc_id count as they come. Without rows (no labels, null ones only, or none of these docs) nothing is learned and every category has a probability
    of 0, so that nothing is rejected."""
    names = [name for name, _ in CHAIN]
    known = labels.select("doc_id", *(F.expr(e).cast("double").alias(f"y{i}") for i, (_, e) in enumerate(CHAIN))).dropna()
    share = min(1.0, max_rows / max(1, known.count()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    known = known.filter(at < int(share * 1_000_000))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds)))

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = page.drop(columns=["text"])
            words = [TOKEN.findall(t.lower()) for t in page["text"]]
            out["dense"] = [shares(t, w) for t, w in zip(page["text"], words, strict=True)]
            out["features"] = [sorted({f for x in set(w) for f in word_features(x)}) for w in words]
            yield out

    ys = [f"y{i}" for i in range(len(CHAIN))]
    schema = "doc_id long, " + ", ".join(f"{y} double" for y in ys) + ", fold int, dense array<double>, features array<long>"
    rows = materialize(rows.select("doc_id", *ys, F.col("fold").cast("int").alias("fold"), "text").mapInPandas(run, schema), "training")

    total = rows.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    if not total["n"]:
        return Chain(names, {}, [])
    counts = rows.select(F.explode("features").alias("f"), *ys).groupBy("f").agg(F.count("*").alias("c"), *(F.sum(y).alias(y) for y in ys)).filter("c >= 5")

    def chi(y: str) -> Column:  # of presence against the category
        n, k = float(total["n"]), float(total[y] or 0)
        return F.pow(F.col(y) * n - F.col("c") * k, 2) / (F.col("c") * (n - F.col("c") + 1) * (k * (n - k) + 1))

    chosen = {r["f"] for y in ys for r in counts.orderBy(chi(y).desc(), "f").select("f").limit(max_features).collect()}
    index = {f: i for i, f in enumerate(sorted(chosen))}
    some = rows.select(*ys, "fold", "dense", "features")

    def narrow(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            page["features"] = [np.array([index[f] for f in w if f in index], "<i4").tobytes() for w in page["features"]]
            yield page

    t = some.mapInPandas(narrow, ", ".join(f"{y} double" for y in ys) + ", fold int, dense array<double>, features binary").toPandas()  # at most about max_rows rows
    words = [np.frombuffer(w, "<i4") for w in t["features"]]
    dense = np.array(t["dense"].tolist(), float).reshape(len(t), N_SHARES)
    fold, n, models, earlier = t["fold"].to_numpy(), len(index), [], np.zeros((len(t), 0))
    for y in ys:
        target, x = t[y].to_numpy(float), np.column_stack([dense, earlier])
        models.append(fit(words, x, target, n))
        unseen = np.zeros(len(t))
        for k in range(folds):
            a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w = fit([words[i] for i in a], x[a], target[a], n)
            unseen[b] = logistic(margin(w, [words[i] for i in b], x[b], n))
        earlier = np.column_stack([earlier, unseen])
    return Chain(names, index, models)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs, any columns with text -> the same rows with p_<category> for each category of the chain. A null text is empty. Columns of docs
    named so are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    fields = [f"p_{name}" for name in chain.names]

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for page in texts:
            got = [shared.value.features(t, known) for t in page]
            dense = np.array([d for _, d in got], float).reshape(len(got), N_SHARES)
            yield pd.DataFrame(shared.value.predict([w for w, _ in got], dense), columns=fields)

    d = docs.drop(*fields, "__p")
    return d.withColumn("__p", predict(text_or_empty())).select(*d.columns, *(F.col("__p")[f].alias(f) for f in fields))


def digest(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.round("p_toxic_low_quality", 6).alias("p_toxic_low_quality"), (F.col("p_toxic") >= threshold).alias("toxic"))
