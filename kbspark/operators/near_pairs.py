"""Chunks of different documents with alike texts, by a set-similarity join on character trigrams.

Words are padded with two blanks before and one behind, and cut into trigrams; two chunks are as alike as their sets (Jaccard). Equal sets
are one class, so copies meet once. Trigrams are numbered from the rarest on; two sets above the level share one of the first
n - ceil(level * n) + 1 of both. Classes meet on those numbers if their sizes allow the level, and if the places of the shared number leave
room for the overlap that it takes, and if bitmaps of the sets do not rule that overlap out. A number of very many classes is dealt out in pairs of blocks, so no task holds all of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.operators import windows
from kbspark.sources.tables import materialize

#: Fixed value: a word of letters and digits.
TERM = r"[\p{L}\p{N}]+"
#: Bounds are rounded up from products of doubles, which may lie just above a whole number.
EPS = 1e-9
#: Words of 64 bits in a set's bitmap.
WORDS = 4


def trigrams(text: Column) -> Column:
    """The set of trigrams of the text's words in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def classes_of(chunks: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (class, grams) with their first chunk (doc_id, chunk_index, chunk_id) and the first of another document, and
    members (class, chunk_id). grams is null for sets of fewer than `least`, which then are only hashed and not kept."""
    g = chunks.select("doc_id", "chunk_index", "chunk_id", F.sort_array(trigrams(F.col("chunk_text"))).alias("grams")).filter("size(grams) > 0 and doc_id is not null")
    g = g.withColumns({"x": F.xxhash64("grams"), "y": F.xxhash64(F.lit(1), "grams")})
    g = materialize(g.withColumn("grams", F.when(F.size("grams") >= least, F.col("grams"))))
    chunk = F.struct("doc_id", "chunk_index", "chunk_id")
    firsts = g.groupBy("x", "y", "doc_id").agg(F.min(chunk).alias("at"))
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("at"))
    two = firsts.withColumn("n", place).filter("n <= 2").groupBy("x", "y").agg(F.min("at").alias("first"), F.max(F.when(F.col("n") == 2, F.col("at"))).alias("other"))
    large = g.filter("grams is not null").select("x", "y", "doc_id", "chunk_id", "grams")
    one = large.join(two.select("x", "y", F.col("first.doc_id").alias("doc_id"), F.col("first.chunk_id").alias("chunk_id")), ["x", "y", "doc_id", "chunk_id"], "left_semi").select("x", "y", "grams").dropDuplicates(["x", "y"])
    named = materialize(two.join(one, ["x", "y"], "left").withColumn("class", F.monotonically_increasing_id()))
    return named.select("class", "grams", "first", "other"), g.select("x", "y", "chunk_id").join(named.select("x", "y", "class"), ["x", "y"]).select("class", "chunk_id")


def numbered(classes: DataFrame) -> DataFrame:
    """class, n (size of the set) and tokens: its trigrams as numbers, in order from the rarest."""
    e = classes.select("class", F.explode("grams").alias("gram"))
    counts = materialize(e.groupBy("gram").agg(F.count("*").alias("df")).repartitionByRange("df", "gram").withColumn("range", F.spark_partition_id()))
    before = counts.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))  # a row for each partition
    number = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("df", "gram"))
    numbers = counts.join(F.broadcast(before), "range").select("gram", number.cast("int").alias("token"))
    return e.join(numbers, "gram").groupBy("class").agg(F.sort_array(F.collect_list("token")).alias("tokens")).withColumn("n", F.size("tokens"))


def overlap_bound(a: str, b: str) -> Column:
    """At most so many elements can be shared: bits that differ belong to elements that one side lacks."""
    differ = sum((F.bit_count(F.col(f"bits_{a}")[i].bitwiseXOR(F.col(f"bits_{b}")[i])) for i in range(WORDS)), F.lit(0))
    return (F.col(f"n_{a}") + F.col(f"n_{b}") - differ) / 2


def candidates(sets: DataFrame, level: float, block: int) -> DataFrame:
    """a < b: classes that pass the filters, each pair once."""
    bits = F.array(*(F.expr(f"aggregate(filter(tokens, t -> pmod(t, {64 * WORDS}) div 64 = {i}), 0L, (s, t) -> s | shiftleft(1L, pmod(t, 64)))") for i in range(WORDS)))
    prefix = sets.withColumn("bits", bits).select("class", "n", "bits", F.posexplode(F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.lit(level) * F.col("n") - EPS) + 1).cast("int"))).alias("place", "token"))
    blocks = prefix.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int")
    p = prefix.join(blocks, "token", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = materialize(p.select("token", "class", "n", "bits", "place", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")))
    a, b = (dealt.select("token", "p", "q", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "bits", "place", "own"))) for x in "ab")
    need = F.ceil(F.lit(level / (1 + level)) * (F.col("n_a") + F.col("n_b")) - EPS)
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # if this is the first number they share, as one is
    # Within one block all rows meet, and rows of two blocks meet in the group of both only.
    fits = (F.col("class_a") < F.col("class_b")) & ((F.col("p") == F.col("q")) | (F.col("own_a") != F.col("own_b")))
    sizes = (F.col("n_a") >= level * F.col("n_b") - EPS) & (F.col("n_b") >= level * F.col("n_a") - EPS)
    return a.join(b, ["token", "p", "q"]).filter(fits & sizes & (room >= need) & (overlap_bound("a", "b") >= need)).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def similar_classes(classes: DataFrame, level: float, block: int) -> DataFrame:
    """a, b, similarity (above level) of classes with different sets."""
    sets = materialize(numbered(classes))
    side = lambda x: sets.select(F.col("class").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    j = candidates(sets, level, block).join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return j.withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).filter(F.col("similarity") > level).select("a", "b", "similarity")


def near_duplicates(chunks: DataFrame, level: float = 0.6, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """chunks (doc_id, chunk_index, chunk_id, chunk_text) -> (pairs, members).

    pairs (class_a, class_b, similarity, and the first two chunks of different documents that are in them: doc_a < doc_b, index_a, chunk_a,
    index_b, chunk_b): each two classes of sets whose similarity is above `level`, and each class that several documents share with itself
    (similarity 1). members (class, chunk_id) tells which other chunks a pair stands for. A class is all chunks with one set of trigrams;
    copies aren't paired out. Null and empty texts, texts without letters or digits and rows without doc_id are alike to nothing."""
    classes, members = classes_of(chunks, smallest(level))
    return own_pairs(classes).unionByName(other_pairs(classes, level, block)), members


def smallest(level: float) -> int:
    """Sets of fewer elements than this are no more alike than `level` to any other set: the larger of two that differ has n elements of which
    one at least is its own, so n is above 1 / (1 - level), and the smaller has more than level * n."""
    return int(level / (1 - level + EPS))


def own_pairs(classes: DataFrame) -> DataFrame:
    """Pairs within the classes that several documents share."""
    c = classes.filter("other is not null").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit(1.0).alias("similarity"), F.struct(F.col("first").alias("x"), F.col("other").alias("y")).alias("pair"))
    return with_places(c)


def with_places(pairs: DataFrame) -> DataFrame:
    cols = [F.col(f"pair.{s}.{c}").alias(f"{n}_{x}") for x, s in (("a", "x"), ("b", "y")) for c, n in (("doc_id", "doc"), ("chunk_index", "index"), ("chunk_id", "chunk"))]
    return pairs.select("class_a", "class_b", "similarity", *cols)


def other_pairs(classes: DataFrame, level: float, block: int) -> DataFrame:
    """Pairs of two classes. Those without grams are too small for the level."""
    large = classes.filter("grams is not null")
    found = similar_classes(large.select("class", "grams"), level, block)
    side = lambda x: large.select(F.col("class").alias(x), F.col("first").alias(f"first_{x}"), F.col("other").alias(f"other_{x}"))
    two = found.join(side("a"), "a").join(side("b"), "b")
    apart = F.col("first_a.doc_id") != F.col("first_b.doc_id")
    swap = F.col("first_b") < F.col("first_a")
    ordered = F.struct(F.least("first_a", "first_b").alias("x"), F.greatest("first_a", "first_b").alias("y"))
    # Both begin in one document: the earlier one there meets the other's first chunk elsewhere, if it has one, else the other way round.
    later = F.when(swap, F.struct(F.col("first_b").alias("x"), F.col("other_a").alias("y"))).otherwise(F.struct(F.col("first_a").alias("x"), F.col("other_b").alias("y")))
    turned = F.when(swap, F.struct(F.col("first_a").alias("x"), F.col("other_b").alias("y"))).otherwise(F.struct(F.col("first_b").alias("x"), F.col("other_a").alias("y")))
    pair = F.when(apart, ordered).when(later["y"].isNotNull(), later).when(turned["y"].isNotNull(), turned)
    return with_places(two.withColumn("pair", pair).filter("pair is not null").withColumnsRenamed({"a": "class_a", "b": "class_b"}))


#: Levels that are tried one after the other for the closest pairs, of as many places as similarities are rounded to.
LEVELS = (0.999999, 0.95, 0.9, 0.8, 0.7)


def closest(chunks: DataFrame, level: float = 0.6, most: int = 20) -> DataFrame:
    """The `most` closest pairs of near_duplicates, by similarity and then by place: doc_a, index_a, doc_b, index_b, similarity, rank. The bound is the report's.

    What lies above a higher level costs far less to find, so levels are lowered until `most` pairs lie above one: then all others rank behind."""
    place = [F.col("similarity").desc(), "doc_a", "index_a", "doc_b", "index_b"]
    chunks = chunks.select("doc_id", "chunk_index", F.coalesce(F.col("chunk_index").cast("string"), F.lit("")).alias("chunk_id"), "chunk_text")  # a pair names places only
    for least in [*(x for x in LEVELS if x > level), level]:
        pairs, _ = near_duplicates(chunks, least)
        pairs = pairs.select("doc_a", F.col("index_a").cast("long").alias("index_a"), "doc_b", F.col("index_b").cast("long").alias("index_b"), F.round("similarity", 6).alias("similarity"))
        best = materialize(pairs.orderBy(*place).limit(most))
        if best.filter(F.col("similarity") > least).count() >= most:
            break
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*place)))  # of `most` rows


def prefix_overlap(chunks: DataFrame, prefix: int = 80, least: int = 100, gram: int = 24, most_bits: int = 1 << 28) -> DataFrame:
    """Pairs (a, b) of chunks of different documents where the first `prefix` characters of b (of `least` characters or more) stand in a.
    chunk_id must be unique.

    Hashes of all heads go to every task as bits (up to `most_bits`); a text is searched for stretches whose hash may be a head's as it is read,
    so neither texts nor their stretches are shuffled, only those found. A text's own head counts if other documents have it too. Heads are
    compared as texts in the end, so hashes and bits only narrow."""
    at_least = lambda n: F.length("chunk_text") >= n
    texts = chunks.select("chunk_id", "doc_id", "chunk_text").filter("chunk_text is not null and doc_id is not null")
    heads = texts.filter(at_least(least)).select("chunk_id", "doc_id", F.substring("chunk_text", 1, prefix).alias("chunk_text"))
    b = heads.mapInArrow(lambda batches: anchors_of_heads(batches, prefix, gram), "b string, b_doc long, head string, h long, anchor long").drop("anchor")
    by_head = materialize(b.groupBy("h").agg((F.min("b_doc") != F.max("b_doc")).alias("shared")))
    every, shared = bits_of(by_head.select("h"), most_bits), bits_of(by_head.filter("shared").select("h"), most_bits)
    send = chunks.sparkSession.sparkContext.broadcast
    every, shared = send(every), send(shared)
    holds = texts.filter(at_least(prefix)).mapInArrow(lambda batches: heads_in_texts(batches, prefix, least, every.value, shared.value), "a string, a_doc long, head string, h long")
    return holds.join(b, ["h", "head"]).filter("a_doc <> b_doc").select("a", "b")


#: Odd multipliers, one for each bit that a hash sets.
PROBES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def places_of(h: np.ndarray, probe: np.uint64, size: int) -> np.ndarray:
    """Numbers of bits, of 2 ** size, for hashes."""
    return h.view(np.uint64) * probe >> np.uint64(64 - size)


def bits_of(hashes: DataFrame, most: int) -> np.ndarray:
    """Words of 64 bits, 16 bits or more a hash up to `most` in all, of which each of the hashes (h) sets a few."""
    size = max(6, min(most.bit_length() - 1, (16 * hashes.count()).bit_length()))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate([places_of(batch.column("h").to_numpy(zero_copy_only=False), x, size) for x in PROBES]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([longs(word), longs(bits)], ["word", "bits"])

    found = hashes.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_be(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where all bits of a hash are set."""
    at, size = np.arange(len(h)), (64 * len(bits)).bit_length() - 1
    for x in PROBES:
        place = places_of(h[at], x, size)
        at = at[(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors_of_heads(batches: Iterable[pa.RecordBatch], prefix: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in windows.pieces(batch, "chunk_text")):
        t = windows.Texts(part.column("chunk_text").to_pylist())
        first = t.left == np.bincount(t.row)[t.row]
        yield pa.RecordBatch.from_arrays([*part.columns, longs(t.hashes(prefix)[first]), longs(t.least(prefix, gram)[first])], ["b", "b_doc", "head", "h", "anchor"])


def anchors_of_texts(batches: Iterable[pa.RecordBatch], prefix: int, gram: int) -> Iterator[pa.RecordBatch]:
    """An anchor once for neighbours that share it."""
    for part in (p for batch in batches for p in windows.pieces(batch, "chunk_text")):
        t = windows.Texts(part.column("chunk_text").to_pylist())
        whole = t.left >= prefix
        row, anchor = t.row[whole], t.least(prefix, gram)[whole]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
        at = pa.array(row[new])
        yield pa.RecordBatch.from_arrays([part.column("ref").take(at), part.column("doc_id").take(at), longs(anchor[new])], ["ref", "doc_id", "anchor"])


def heads_in_texts(batches: Iterable[pa.RecordBatch], prefix: int, least: int, every: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first place of each stretch in a text that may be a head; its own head, if others may share it."""
    for part in (p for batch in batches for p in windows.pieces(batch, "chunk_text")):
        texts = part.column("chunk_text").to_pylist()
        t = windows.Texts(texts)
        length = np.array([len(x) for x in texts], np.int64)
        at = np.flatnonzero(t.left >= prefix)
        h = t.hashes(prefix)[at]
        found = may_be(h, every)
        at, h = at[found], h[found]
        row = t.row[at]
        place = length[row] - t.left[at]
        other = np.flatnonzero((place > 0) | (length[row] < least))
        own = np.flatnonzero((place == 0) & (length[row] >= least))
        keep = np.sort(np.concatenate([other, own[may_be(h[own], shared)]]))
        row, place, h = row[keep], place[keep], h[keep]
        order = np.lexsort((place, h, row))
        row, place, h = row[order], place[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, place, h = row[new], place[new], h[new]
        rows = pa.array(row)
        heads = pa.array([texts[i][j : j + prefix] for i, j in zip(row.tolist(), place.tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(rows), part.column("doc_id").take(rows), heads, longs(h)], ["a", "a_doc", "head", "h"])
