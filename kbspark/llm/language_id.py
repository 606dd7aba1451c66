"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case runs of letters with one space between. Spark sums the counts of all four-character sequences of all training
rows and derives everything else from them with aggregates and joins: continuation counts of the shorter orders, discounts from the true
numbers of sequences seen once and twice, context weights, and for each sequence its interpolated probability in every language. Nothing
is left out, and nothing but a few numbers for each language passes the driver.

The models are arrays of sequences (packed into 64 bits, which is a hash without collisions) in ascending order beside their probabilities,
written in ranges to the shared folder. Tasks read them from there: once and for good while they take up to `cache_bytes`, and beyond that
range by range for each batch of texts, so that a task never holds more than one range. Both ways look up the same arrays.

A text goes to the language with the lowest cross-entropy for each character. How far the second is behind, and the length, give a
calibrated probability that the choice is right; below `reject` the row is marked rejected.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialize

N = 4
U = np.uint64
#: The chance of a symbol that no model has seen.
UNSEEN = 1.0 / 0x10000


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the N characters that end at each character of each text (four times 16 bits), and the text number of each. Characters
    above U+FFFF share by hash the 2,048 values that stand for no character."""
    joined = "".join(" " * (N - 1) + s + " " for s in texts)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(U)
    c = np.where(c > U(0xFFFF), U(0xD800) + (c * U(2654435761) >> U(16)) % U(2048), c)
    n = np.array([len(s) + 1 for s in texts])
    starts = np.cumsum(n + N - 1) - n - N + 1
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    return (c[at] << U(48)) | (c[at + 1] << U(32)) | (c[at + 2] << U(16)) | c[at + 3], doc


def pieces(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with some `most` characters."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= most):
            n, to = n + len(texts[to]), to + 1
        yield at, to
        at = to


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(key, return_inverse=True)
    return key, np.bincount(inverse, n, len(key))


def low_bits(order: int) -> int:
    return (1 << 16 * order) - 1


def read_arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """key, value (rows x languages) of one file of a model table."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if path.startswith("file:"):
        t = pq.read_table(unquote(urlparse(path).path))
    else:
        store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        t = pq.read_table(io.BytesIO(store.open_input_stream(inner).read()))
    key, value = t.column("key").to_numpy(), t.column("value").combine_chunks()
    return key, np.asarray(value.flatten()).reshape(len(key), -1) if len(key) else np.zeros((0, 1), np.float32)


#: Arrays that this Python worker has read, by file. Workers serve many tasks.
_READ: dict[str, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Models:
    """Files of the arrays p<order> (probabilities of sequences) and w<order> (weights of contexts)."""

    langs: list[str]
    files: dict[str, list[str]]
    n_bytes: int
    cache_bytes: int = 400_000_000

    def parts(self, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for f in self.files[name]:
            got = _READ.get(f) or read_arrays(f)
            if self.n_bytes <= self.cache_bytes and f not in _READ:
                own = {x for of in self.files.values() for x in of}
                for other in [x for x in _READ if x not in own]:
                    del _READ[other]
                _READ[f] = got
            yield got

    def find(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For keys in ascending order: whether each is in the arrays, and its values."""
        hit, out = np.zeros(len(keys), bool), np.zeros((len(keys), len(self.langs)))
        for key, value in self.parts(name):
            if not len(key):
                continue
            a, b = np.searchsorted(keys, key[0]), np.searchsorted(keys, key[-1], side="right")
            at = np.searchsorted(key, keys[a:b])
            hit[a:b] = key[at] == keys[a:b]
            out[a:b][hit[a:b]] = value[at[hit[a:b]]]
        return hit, out

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Interpolated probabilities, keys (ascending) x languages. An absent sequence has its context's weight times the shorter order."""
        if not order:
            return np.full((len(keys), len(self.langs)), UNSEEN)
        hit, out = self.find(f"p{order}", keys)
        if not hit.all():
            new = keys[~hit]
            shorter, at = np.unique(new & low_bits(order - 1), return_inverse=True)
            context, of = np.unique((new.view(U) >> U(16)).view(np.int64), return_inverse=True)
            known, weight = self.find(f"w{order}", context)
            weight[~known] = 1
            out[~hit] = weight[of] * self.probability(order - 1, shorter)[at]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits for each character, texts x languages."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in pieces(texts):
            key, doc = sequences(texts[a:b])
            key, at = np.unique(key.view(np.int64), return_inverse=True)
            bits, n = -np.log2(self.probability(N, key)), np.bincount(doc, minlength=b - a)
            for i in range(len(self.langs)):
                out[a:b, i] = np.bincount(doc, bits[at, i], b - a) / n
        return out

    def best(self, texts: list[str]) -> pd.DataFrame:
        e = self.entropies(texts)
        order = np.sort(e, axis=1)
        margin = order[:, 1] - order[:, 0] if len(self.langs) > 1 else np.full(len(texts), 10.0)
        return pd.DataFrame({"lang_pred": [self.langs[i] for i in e.argmin(axis=1)], "margin": margin, "n": [len(s) for s in texts]})


def count_sequences(rows: DataFrame) -> DataFrame:
    """rows (lang, s) -> lang, gram, n. Counts are summed within a partition before anything is shuffled."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple]] = {}
        for page in pages:
            for lang, g in page.groupby("lang"):
                texts = list(g["s"])
                for a, b in pieces(texts):
                    mine = held.setdefault(lang, [])
                    mine.append(np.unique(sequences(texts[a:b])[0], return_counts=True))
                    if sum(len(k) for k, _ in mine) > 2_000_000:
                        mine[:] = [summed(np.concatenate([k for k, _ in mine]), np.concatenate([n for _, n in mine]))]
        for lang, mine in held.items():
            key, n = summed(np.concatenate([k for k, _ in mine]), np.concatenate([n for _, n in mine]))
            yield pd.DataFrame({"lang": lang, "gram": key.view(np.int64), "n": n.astype(np.int64)})

    return rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, range_rows: int = 2_000_000) -> Models:
    """rows (lang, s) -> models of all languages, over all sequences of all rows."""
    grams = materialize(count_sequences(rows), "grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return Models([], {}, 0)
    c = [f"c{i}" for i in range(len(langs))]
    counts = grams.groupBy(F.col("gram").alias("key")).agg(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(y) for x, y in zip(langs, c, strict=True)))
    orders = {N: materialize(counts, "order")}
    for k in range(N - 1, 0, -1):  # how many different characters stand before each shorter sequence
        shorter = orders[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(low_bits(k))).alias("key"))
        orders[k] = materialize(shorter.agg(*(F.count_if(F.col(x) > 0).alias(x) for x in c)), "order")

    files, rows_in = {}, 0
    lower = None
    for k in range(1, N + 1):
        seen = orders[k].agg(F.count("*").alias("rows"), *(F.count_if(F.col(x) == j).alias(f"{x}_{j}") for x in c for j in (1, 2))).first()
        d = [float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5 for n1, n2 in ((seen[f"{x}_1"], seen[f"{x}_2"]) for x in c)]
        context = F.shiftrightunsigned("key", 16)
        sums = orders[k].groupBy(context.alias("context")).agg(F.array(*(F.sum(x) for x in c)).alias("total"), F.array(*(F.count_if(F.col(x) > 0) for x in c)).alias("kinds"))
        weight = [F.when(F.col("total")[i] > 0, F.lit(d[i]) * F.col("kinds")[i] / F.col("total")[i]).otherwise(F.lit(1.0)) for i in range(len(langs))]
        sums = materialize(sums.select("context", "total", F.array(*weight).alias("weight")), "contexts")
        o = orders[k].withColumn("context", context).join(sums, "context")
        if lower is None:
            o = o.withColumn("less", F.array(*(F.lit(UNSEEN) for _ in langs)))
        else:
            o = o.withColumn("shorter", F.col("key").bitwiseAND(F.lit(low_bits(k - 1)))).join(lower.select(F.col("key").alias("shorter"), F.col("p").alias("less")), "shorter")
        own = [F.when(F.col("total")[i] > 0, F.greatest(F.col(x) - F.lit(d[i]), F.lit(0.0)) / F.col("total")[i]).otherwise(F.lit(0.0)) for i, x in enumerate(c)]
        lower = materialize(o.select("key", F.array(*(own[i] + F.col("weight")[i] * F.col("less")[i] for i in range(len(langs)))).alias("p")), "interpolated")
        parts = max(1, -(-seen["rows"] // range_rows))
        rows_in += seen["rows"]
        for name, t in ((f"p{k}", lower.select("key", F.col("p").cast("array<float>").alias("value"))), (f"w{k}", sums.select(F.col("context").alias("key"), F.col("weight").cast("array<float>").alias("value")))):
            files[name] = materialize(t.repartitionByRange(parts, "key").sortWithinPartitions("key"), name).inputFiles()
    return Models(langs, files, 2 * rows_in * (8 + 4 * len(langs)))


def weigh(b: pd.DataFrame) -> np.ndarray:
    return np.stack([np.ones(len(b)), np.minimum(b["margin"], 10), np.minimum(b["margin"] * np.sqrt(b["n"]), 50)], axis=1)


def calibrate(models: Models, sample: DataFrame, most: int) -> np.ndarray:
    """Weights of (1, margin, margin * sqrt(characters)) for the probability that the choice is right, by logistic regression on at most
    `most` rows of sample (lang, s)."""
    w = np.array([0.0, 4.0, 1.0])
    if not models.langs:
        return w

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            if len(page):
                b = models.best(list(page["s"]))
                yield b.assign(right=b["lang_pred"].to_numpy() == page["lang"].to_numpy())[["margin", "n", "right"]]

    b = sample.select("lang", "s").mapInPandas(run, "margin double, n long, right boolean").limit(most).toPandas()  # three numbers a row
    x, y, prior = weigh(b), b["right"].to_numpy().astype(float), w.copy()
    for _ in range(50):  # Newton steps, drawn to the prior weights
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) + (w - prior)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), grad)
    return w


def identify(docs: DataFrame, models: Models, weights: np.ndarray, reject: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, rejected. `und` with score 0 for texts that are null or hold no letter (or if no
    language was learned). Whole texts count, in pieces of a bounded size; of languages with equal entropy the first by name is taken; null
    ids and repeated rows are kept; other columns are ignored, whatever their names; an empty table gives no rows."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = pd.DataFrame({"doc_id": page["doc_id"], "lang_pred": "und", "score": 0.0})
            some = (page["s"].str.len() > 0).to_numpy()
            if some.any() and models.langs:
                b = models.best(list(page["s"][some]))
                out.loc[some, "lang_pred"] = b["lang_pred"].to_numpy()
                out.loc[some, "score"] = 1 / (1 + np.exp(-(weigh(b) @ weights)))
            out["rejected"] = out["score"] < reject
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(letters(F.col("text")), F.lit("")).alias("s")).mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def split_and_identify(docs: DataFrame, calibration_rows: int = 2000) -> DataFrame:
    """Learns from rows of docs (doc_id, text, lang) whose crc32 of the id as text isn't divisible by 5 and predicts all rows, as identify
    does. A twentieth of the training rows, by a hash of the id, is kept from the models; those calibration_rows of it with the least hashes
    calibrate the score. Rows with a null id or lang aren't learned from; without any others all rows are `und`."""
    docs = docs.select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    training = docs.filter(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("at"))
    aside = F.pmod("at", F.lit(20)) == 0
    spelled = lambda d: d.select("lang", letters(F.col("text")).alias("s")).filter("length(s) > 0")
    models = train(spelled(training.filter(~aside)))
    last = training.filter(aside).select("at").distinct().orderBy("at").limit(calibration_rows).agg(F.max("at")).first()[0]
    weights = calibrate(models, spelled(training.filter(aside & (F.col("at") <= F.lit(last)))), calibration_rows)
    found = identify(docs, models, weights)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
