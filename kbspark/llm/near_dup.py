"""MinHash near-dedup with ProbMinHash.

A text's weighted shingles (five words, weight: how often) are a distribution; two texts are alike if its probability Jaccard
J = sum_i 1 / sum_j max(a_j / a_i, b_j / b_i) is at least 0.8 (for weights of one this is the Jaccard similarity of the shingle sets).

Signature: each shingle sends points at exponential times of a rate equal to its weight, each to a random register, and a register keeps
the shingle that came first. A shingle stops as soon as its next time is later than the latest of all registers (early termination).
Equal texts are one row from there on. Bands of registers give buckets. Within a bucket a spanning forest of the best estimates names
the pairs to verify; verified pairs give classes. Where a pair was rejected and its ends are still apart, the bucket is gone over again
with the exact similarity of every pair of different classes, so that no link that a bucket shows is lost. What leaves a bucket is at most
an edge for each of its rows (and block).

A bucket above `block` rows is dealt out in blocks. In the first pass each block gets the bucket's few centres besides its own rows, so that
a large group of copies becomes one class in time linear in its size. Only a hot bucket that still holds several classes is gone over in
full, and there rows of its largest class meet those outside it, never each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import connected_components, folded_words, materialize, text_or_empty

SHINGLE = 5
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(words: list[np.ndarray], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several texts -> (text number, shingle hash, weight), by text and hash. A text of fewer words is one shingle."""
    doc, key = [], []
    for i, w in enumerate(words):
        w = np.asarray(w).astype(np.int64).view(U)
        if not len(w):
            continue
        k = min(size, len(w))
        h = np.zeros(len(w) - k + 1, U)
        for j in range(k):
            h = mix(h ^ w[j : len(w) - k + 1 + j])
        key.append(h)
        doc.append(np.full(len(h), i, np.int64))
    if not doc:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0)
    doc, key = np.concatenate(doc), np.concatenate(key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    return doc[first], key[first], np.diff(np.r_[first, len(doc)]).astype(float)


def prob_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers: 16 bits of the shingle that each register kept, by arrivals in rounds over all shingles still in the race."""
    when = np.full((n_docs, registers), np.inf)
    kept = np.zeros((n_docs, registers), U)
    time, active, step = np.zeros(len(doc)), np.arange(len(doc)), 0
    while len(active):
        step += 1
        u = mix(key[active] ^ mix(np.full(1, step, U)))
        time[active] += -np.log(((u >> U(11)).astype(float) + 1) / 2.0**53) / weight[active]
        d, t = doc[active], time[active]
        register = (mix(u) % U(registers)).astype(np.int64)
        flat = d * registers + register
        old = when.ravel()[flat]
        better = t < old
        np.minimum.at(when.ravel(), flat[better], t[better])
        won = better & (when.ravel()[flat] == t)
        kept.ravel()[flat[won]] = key[active][won]
        racing, at = np.unique(d, return_inverse=True)
        active = active[t < when[racing].max(axis=1)[at]]
    return (mix(kept) >> U(48)).astype(np.uint16)


def similarity(a: tuple, b: tuple) -> float:
    """Probability Jaccard of two texts, each (sorted shingle hashes, weights)."""
    (ka, wa), (kb, wb) = a, b
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(both) / (len(ka) + len(kb) - len(both))
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    above = np.r_[np.cumsum(x[::-1])[::-1][1:], 0.0]  # those with a larger ratio count with a's weight
    upto = np.cumsum(y)
    return float((x / (only_a + above + x + ratio * (only_b + upto - y))).sum())


def signatures(docs: DataFrame, registers: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h (64 bits of the text), x, y (128 bits of the word sequence; null for a text without words), sig (binary)."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            words, at = list(page["w"]), 0
            while at < len(words):  # some 200,000 words at once
                to, n = at, 0
                while to < len(words) and (to == at or n + len(words[to]) <= 200_000):
                    n, to = n + len(words[to]), to + 1
                sig = prob_minhash(*shingles(words[at:to]), to - at, registers)
                out = page.iloc[at:to][["doc_id", "h", "x", "y"]].copy()
                out["sig"] = [s.tobytes() if len(w) else None for s, w in zip(sig, words[at:to], strict=True)]
                yield out
                at = to

    w = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("h"), F.transform(folded_words(text_or_empty()), lambda x: F.xxhash64(x)).alias("w"))
    some = F.size("w") > 0
    d = w.select("doc_id", "h", F.when(some, F.xxhash64("w")).alias("x"), F.when(some, F.xxhash64(F.lit(1), F.reverse("w"))).alias("y"), "w")
    return materialize(d.mapInPandas(run, "doc_id long, h long, x long, y long, sig binary"), "signatures")


def forest(level: float, exact: bool, registers: int):
    """For rows sorted by bucket (key) and pair of blocks (p, q): edges (a, b) of a spanning forest of each group between rows of different
    classes. Estimates go from the best to `level`; with exact, a pair counts if its true similarity is at least `level`."""
    low = level - 4 * (level * (1 - level) / registers) ** 0.5
    steps = [low] if exact else [1.0, 0.95, 0.9, 0.86, 0.83, 0.8, 0.76, low]

    def one(t: np.ndarray, names: np.ndarray, sig: np.ndarray, full: list[tuple] | None) -> Iterator[tuple]:
        near = np.stack([(sig == s).sum(axis=1) for s in sig])
        names = names.copy()
        for at in steps:
            for i in range(1, len(t)):
                for j in np.flatnonzero((near[i, :i] >= at * registers) & (names[:i] != names[i])):
                    if names[i] != names[j] and (full is None or similarity(full[i], full[j]) >= level):
                        names[names == names[i]] = names[j]
                        yield t[j], t[i]
            if (names == names[0]).all():
                return

    def groups(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        t, names = rows["t"].to_numpy(), rows["class"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), registers)
        full = [(np.frombuffer(k, np.int64), np.frombuffer(w, np.int32)) for k, w in zip(rows["keys"], rows["weights"], strict=True)] if exact else None
        size, made = np.diff(cuts), []
        if not exact:  # most groups are pairs, and go at once
            first = cuts[:-1][size == 2]
            good = (names[first] != names[first + 1]) & ((sig[first] == sig[first + 1]).sum(axis=1) >= low * registers)
            made = list(zip(t[first[good]], t[first[good] + 1], strict=True))
        for a, n in zip(cuts[:-1], size, strict=True):
            if n > 2 or (exact and n == 2):
                made += one(t[a : a + n], names[a : a + n], sig[a : a + n], full and full[a : a + n])
        return pd.DataFrame(made, columns=["a", "b"], dtype="int64")

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # the last group may go on in the next page
        for page in pages:
            if not len(page):
                continue
            key = page[["key", "p", "q"]].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if rest and (rest[0][["key", "p", "q"]].to_numpy()[0] != key[0]).any():
                whole = pd.concat(rest)
                yield groups(whole, np.array([0, len(whole)]))
                rest = []
            if not len(new):
                rest.append(page)
                continue
            head = pd.concat([*rest, page.iloc[: new[-1]]])
            more = len(head) - new[-1]
            yield groups(head, np.concatenate([[0], new + more]))
            rest = [page.iloc[new[-1] :]]
        if rest:
            whole = pd.concat(rest)
            yield groups(whole, np.array([0, len(whole)]))

    return run


def edges_within(dealt: DataFrame, level: float, exact: bool, registers: int) -> DataFrame:
    """Distinct edges (a, b) of the buckets. Groups are sorted into streams, so that small ones cost no call of their own."""
    order = ["key", "p", "q"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "t").mapInPandas(forest(level, exact, registers), "a long, b long").distinct()


def number_of(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def with_centres(rows: DataFrame, block: int, centres: int) -> DataFrame:
    """Adds p and q (here equal): the row's block of its bucket (key). Of a bucket above `block` rows the `centres` rows with the least hash
    stand in every block."""
    size = rows.groupBy("key").agg(number_of(F.count("*"), block).alias("blocks"))
    hot = materialize(size.filter("blocks > 1"), "hot")
    place = lambda r, b: F.pmod(F.xxhash64(r), b).cast("int")
    r = rows.join(hot, "key", "left").withColumn("p", F.coalesce(place("t", F.col("blocks")), F.lit(0)))
    own = r.drop("blocks").withColumn("q", F.col("p"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(7), "t"), "t"))
    few = rows.join(hot, "key").withColumn("rank", rank).filter(F.col("rank") <= centres).drop("rank")
    few = few.withColumn("own", place("t", F.col("blocks"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("p <> own").withColumn("q", F.col("p"))
    return own.unionByName(few.select(*own.columns))


def with_all_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Adds p and q so that every two rows of a bucket and of different classes share one of its groups: the rows outside the bucket's
    largest class in pairs of blocks (p <= q), and each of their blocks with each block of the largest class (p, -1 - block)."""
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    of = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    r = rows.join(of, "key").withColumns({"large": number_of(F.col("most"), block), "small": number_of(F.col("all") - F.col("most"), block)}).drop("most", "all")
    at = lambda n: F.pmod(F.xxhash64("t"), n).cast("int")
    large = r.filter("class = main").withColumn("q", -1 - at(F.col("large"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("small") - 1)))
    small = r.filter("class <> main").withColumn("own", at(F.col("small")))
    inner = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("small") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    outer = small.withColumn("p", F.col("own")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("large") - 1))).withColumn("q", -1 - F.col("b"))
    names = [*rows.columns, "p", "q"]
    return large.filter("small > 0").select(*names).unionByName(inner.select(*names)).unionByName(outer.select(*names))


def with_text(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """rows (key, t and what hangs on t) joined with `others` on t: once for a text, not for each of its buckets, of which it has at most one a band."""
    by_text = rows.groupBy(*[c for c in rows.columns if c != "key"]).agg(F.collect_list("key").alias("buckets"))
    for other in others:
        by_text = by_text.join(other, "t")
    return by_text.withColumn("key", F.explode("buckets")).drop("buckets")


def identity_columns() -> list[Column]:
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("h")]


def identity() -> Column:
    """What tells a row from others, in the order in which rows of a class are kept: null ids last, rows of one id by their text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), "h")


def near_duplicates(docs: DataFrame, level: float = 0.8, bands: int = 32, rows: int = 6, block: int = 1024, centres: int = 16) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h (hash of the text), class_id (smallest doc_id of the class), class_size (rows), first (whether the row,
    by doc_id and text, is the first of its class). One row for each row of docs.

    Classes are the connected components of similarity of at least `level`. A text without words (null, empty) is alike to nothing, and
    class_id is its own doc_id. A row with a null doc_id keeps it, and takes part as if its id were the largest; its class_id is null
    when no row of its class has an id. Repeated rows are equal texts of one class, and all of them are first if one is; rows of one
    doc_id and other texts are rows of their own. Other columns are ignored, whatever their names; an
    empty table gives no rows. Texts count whole, however long."""
    registers = bands * rows
    s = signatures(docs, registers)
    texts = s.filter("sig is not null").groupBy("x", "y").agg(F.min(identity()).alias("least"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("t"), "*"), "texts")  # t names a text from here on

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * 2 * rows + 1, F.lit(2 * rows))))
    keyed = texts.select("t", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    member = materialize(keyed.join(shared, "key", "left_semi"), "members")

    with_sig = with_text(member, texts.select("t", "sig")).withColumn("class", F.col("t"))
    edges = materialize(edges_within(with_centres(with_sig, block, centres), level, False, registers), "pairs")
    sets = candidate_shingles(docs, texts, member.select("t").distinct())
    sets = materialize(sets, "shingles")

    judged = verified(edges, sets, level)
    good = materialize(judged.filter("similarity >= %r" % level).select("a", "b"), "links")
    found = connected_components(good)
    # Buckets that may hold a link still: those of a rejected pair whose ends are in different classes, and hot ones of several classes.
    c1, c2 = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = edges.join(good, ["a", "b"], "left_anti").join(c1, "a", "left").join(c2, "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    rejected = apart.join(member.withColumnRenamed("t", "a"), "a").join(member.withColumnRenamed("t", "b"), ["b", "key"]).select("key")
    classes = member.join(found.withColumnRenamed("node", "t"), "t", "left").select("key", "t", F.coalesce("component", "t").alias("class"))
    hot = classes.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("c1"), F.max("class").alias("c2")).filter((F.col("n") > block) & (F.col("c1") != F.col("c2"))).select("key")
    open_keys = materialize(rejected.unionByName(hot).distinct(), "open")
    if not open_keys.isEmpty():
        again = with_text(classes.join(open_keys, "key", "left_semi"), texts.select("t", "sig"), sets)
        more = materialize(edges_within(with_all_pairs(again, block), level, True, registers), "more_links")
        if not more.isEmpty():
            found = connected_components(good.union(more))

    named = texts.join(found, F.col("t") == F.col("node"), "left").withColumn("c", F.coalesce("component", "t"))
    groups = named.groupBy("c").agg(F.min("least").alias("least"), F.sum("copies").alias("class_size"))
    named = named.select("x", "y", "c").join(groups, "c").drop("c")
    out = s.select("doc_id", "h", "x", "y").join(named, ["x", "y"], "left")
    lone = F.col("x").isNull()
    class_id = F.when(lone, F.col("doc_id")).otherwise(F.col("least.id")).alias("class_id")
    return out.select("doc_id", "h", class_id, F.coalesce("class_size", F.lit(1)).alias("class_size"), (lone | F.col("least").eqNullSafe(identity())).alias("first"))


def candidate_shingles(docs: DataFrame, texts: DataFrame, wanted: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """t, keys, weights (binaries of int64 and int32, by key) of the wanted texts."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            doc, key, weight = shingles(list(page["w"]))
            cut = np.searchsorted(doc, np.arange(1, len(page)))
            by_key = [(k[(o := np.argsort(k.view(np.int64)))].view(np.int64).tobytes(), w[o].astype(np.int32).tobytes()) for k, w in zip(np.split(key, cut), np.split(weight, cut), strict=True)]
            yield pd.DataFrame({"t": page["t"].to_numpy(), "keys": [k for k, _ in by_key], "weights": [w for _, w in by_key]})

    # One row stands for all equal texts: the first of them. Words are made after the join.
    pick = materialize(texts.join(wanted, "t", "left_semi").select(F.col("t").alias("pick"), F.coalesce("least.id", F.lit(0)).alias("pid"), F.col("least.no_id").alias("pno"), F.col("least.h").alias("ph")), "wanted")
    if pick.count() <= max_broadcast:
        pick = F.broadcast(pick)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    d = d.join(pick, (d.h == pick.ph) & (d.id == pick.pid) & (d.no_id == pick.pno))
    one = d.select(F.col("pick").alias("t"), F.transform(folded_words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).dropDuplicates(["t"])
    return one.mapInPandas(run, "t long, keys binary, weights binary")


def verified(pairs: DataFrame, sets: DataFrame, level: float) -> DataFrame:
    """a, b, similarity."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            got = [similarity((np.frombuffer(k, np.int64), np.frombuffer(w, np.int32)), (np.frombuffer(m, np.int64), np.frombuffer(v, np.int32))) for k, w, m, v in zip(page["ka"], page["wa"], page["kb"], page["wb"], strict=True)]
            yield pd.DataFrame({"a": page["a"].to_numpy(), "b": page["b"].to_numpy(), "similarity": np.array(got, float)})

    a = sets.select(F.col("t").alias("a"), F.col("keys").alias("ka"), F.col("weights").alias("wa"))
    b = sets.select(F.col("t").alias("b"), F.col("keys").alias("kb"), F.col("weights").alias("wb"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long, similarity double")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, without those whose class has an earlier row. Rows go by doc_id and text: of each class the
    first row stays, by doc_id (null ids last), then by a hash of the text; of rows that repeat with both, one, any. Rows without words stay."""
    r = near_duplicates(docs.select("doc_id", "text"), **options)
    key = r.select(*identity_columns(), "class_size", "first").filter("class_size > 1")
    key = key.groupBy("no_id", "id", "h").agg(F.bool_or("first").alias("first"), F.count("*").alias("n")).filter("not first or n > 1")
    key = materialize(key, "classes")
    same = lambda x, y: (x.doc_id.isNull() == y.no_id) & (F.coalesce(x.doc_id.cast("long"), F.lit(0)) == y.id) & (F.xxhash64(F.coalesce(x.text, F.lit(""))) == y.h)
    left = docs.join(key, same(docs, key), "left_anti")
    twice = key.filter("first and n > 1")
    if twice.isEmpty():
        return left
    again = materialize(docs.join(twice, same(docs, twice), "left_semi"), "repeated")
    return left.unionByName(again.dropDuplicates(["doc_id", "text"]))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "class_id", "class_size", F.col("first").alias("kept"))
