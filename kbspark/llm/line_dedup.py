"""Line dedup by a deletion-neighbourhood join (edit distance at most 1).

1. Lines that aren't blank are named by 128 bits of hashes; equal lines meet there and the earliest keeps. Only those of at least
   `min_chars` go on: in shorter lines one edit makes another word or number of them.
2. Segment neighbourhood: a line emits a key for each of `segments` segments left out (for its own length and one less). Lines within the
   bound agree outside one segment, so they share a key; lines that share none are done. Keys are counted before they are shuffled.
3. The lines left, each once, emit their whole neighbourhood: the line and every variant with one character deleted, as hashes that
   numpy rolls along in time linear in the line. Equal variants meet: the same place deleted means a substitution, a variant that equals
   a whole line an insertion or deletion. Each group names its earliest line, so no pairs within a group are made.
4. The edit distance of each line and its earliest neighbour is verified on their texts.

A line goes when an equal line, or one within the bound, stands earlier (by doc_id, then line number; null ids last). Of rows that repeat
with id and text one is the earliest, and the others lose every line that isn't blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize, text_or_empty


def identity(docs: DataFrame) -> list[Column]:
    """What tells a row from others: no_id, id, h."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_or_empty()).alias("h")]


def counts(line: Column) -> Column:
    return line.rlike(r"(?U)\S")


def lines_of(docs: DataFrame) -> DataFrame:
    d = docs.select(*identity(docs), text_or_empty().alias("text"))
    e = d.select("no_id", "id", "h", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).filter(counts(F.col("line")))
    return e.withColumns({"lh": F.xxhash64("line"), "lh2": F.xxhash64(F.lit(1), "line")})


def place(*more: str) -> Column:
    """What the order of lines goes by."""
    return F.struct("no_id", "id", "no", "h", *more)


def segment_keys(line: Column, segments: int) -> Column:
    keys = []
    for shorter in (0, 1):
        n = F.length(line) - shorter
        for s in range(segments):
            a, b = F.floor(n * s / segments).cast("int"), F.floor(n * (s + 1) / segments).cast("int")
            keys.append(F.xxhash64(F.substring(line, F.lit(1), a), F.lit(s), n, F.right(line, n - b)))
    return F.array(*keys)


def variants(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lh, lh2, line -> lh, lh2, at (-1: the whole line, else the place deleted), key and key2, a hash of what remains. Hashes modulo primes
    below 2**31 fill the keys; rolling them needs the sums before and behind a place only."""
    import numpy as np

    primes, bases = (2147483629, 2147483587, 2147483579, 2147483563), (911382323, 972663749, 1203475871, 1514978461)
    powers = [np.ones(1, np.uint64) for _ in primes]

    for page in pages:
        out = []
        for lh, lh2, line in zip(page["lh"], page["lh2"], page["line"], strict=True):
            c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            n, key = len(c), []
            for i, (p, b) in enumerate(zip(primes, bases, strict=True)):
                while len(powers[i]) < n:
                    last = np.uint64(int(powers[i][-1]) * b % p)
                    powers[i] = np.concatenate([powers[i], powers[i] * last % np.uint64(p)])
                term = c * powers[i][:n] % np.uint64(p)
                upto = np.cumsum(term) % np.uint64(p)
                whole = upto[-1]
                back = np.uint64(pow(b, -1, p))
                cut = (upto - term + np.uint64(p) + (whole + np.uint64(p) - upto) % np.uint64(p) * back) % np.uint64(p)
                key.append(np.concatenate([[whole], cut]))
            both = [((key[i] << np.uint64(32)) ^ key[i + 1]).view(np.int64) for i in (0, 2)]
            out.append(pd.DataFrame({"lh": lh, "lh2": lh2, "at": np.arange(-1, n, dtype=np.int32), "key": both[0], "key2": both[1], "size": np.concatenate([[n], np.full(n, n - 1)]).astype(np.int32)}))
            if len(out) >= 200:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)


def near_lines(lines: DataFrame, segments: int) -> DataFrame:
    """lh of the lines that have an earlier one, not equal to them, within one edit."""
    keys = lines.select("lh", F.explode(segment_keys(F.col("line"), segments)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).filter("a <> b").select("key")
    alike = materialize(keys.join(shared, "key", "left_semi").groupBy("lh").agg(F.lit(1).alias("one")), "alike").select("lh")
    first = lines.join(alike, "lh", "left_semi").groupBy("lh", "lh2").agg(F.min(place()).alias("place"), F.min("line").alias("line"))
    first = materialize(first, "candidates")

    v = first.select("lh", "lh2", "line").repartition("lh").mapInPandas(variants, "lh long, lh2 long, at int, key long, key2 long, size int")
    v = v.join(first.select("lh", "lh2", "place"), ["lh", "lh2"])
    by_key = Window.partitionBy("key", "key2", "size")
    by_place = Window.partitionBy("key", "key2", "size", "at")
    mine = F.struct("place", "lh", "lh2")
    w = v.select("lh", "lh2", "place", F.min(mine).over(by_place).alias("same"), F.min(F.when(F.col("at") < 0, mine)).over(by_key).alias("whole"), F.min(F.when(F.col("at") >= 0, mine)).over(by_key).alias("cut"), "at")
    best = F.when(F.col("at") >= 0, F.least("same", F.coalesce("whole", "same"))).otherwise(F.least("same", F.coalesce("cut", "same")))
    pairs = w.select("lh", "lh2", "place", best.alias("best")).filter("best.place < place").select("lh", "lh2", F.col("best.lh").alias("other"), F.col("best.lh2").alias("other2")).distinct()
    texts = first.select(F.col("lh").alias("other"), F.col("lh2").alias("other2"), F.col("line").alias("other_line"))
    checked = pairs.join(first.select("lh", "lh2", "line"), ["lh", "lh2"]).join(texts, ["other", "other2"]).filter(F.levenshtein("line", "other_line", 1).between(0, 1))
    return checked.select("lh", "lh2").distinct()


def dropped_lines(docs: DataFrame, min_chars: int, segments: int, hot: int = 200_000) -> DataFrame:
    """(no_id, id, h, dropped): for each text that loses lines, their numbers. A line of more than `hot` occurrences is dealt out over
    several tasks where it meets them; there is at most one such line for so many lines, which bounds what is broadcast."""
    lines, line = lines_of(docs), ["lh", "lh2"]
    firsts = lines.groupBy(*line).agg(F.min(place()).alias("first"), F.max(place()).alias("last"), F.count("*").alias("n"))
    near = materialize(near_lines(lines.filter(F.length("line") >= min_chars), segments), "near").withColumn("near", F.lit(True))
    bad = firsts.join(near, line, "left").filter("near or first <> last")
    shares = F.ceil(F.col("n") / hot).cast("int")
    bad = materialize(bad.select(*line, "first", F.coalesce("near", F.lit(False)).alias("near"), shares.alias("shares")), "bad")
    dealt = lines.select(*line, place().alias("place")).join(F.broadcast(bad.filter("shares > 1").select(*line, "shares")), line, "left")
    dealt = dealt.withColumn("share", F.coalesce(F.pmod(F.xxhash64("place"), F.col("shares")), F.lit(0))).drop("shares")
    each = bad.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)))
    gone = dealt.join(each, [*line, "share"]).filter("near or place <> first")
    return gone.groupBy("place.no_id", "place.id", "place.h").agg(F.collect_set("place.no").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 16, segments: int = 4) -> DataFrame:
    """docs, any columns with doc_id and text -> the same rows with kept (the text without the lines that go), n_lines and n_dropped.

    Null texts are empty (one empty line). Blank lines never go; those under min_chars go as exact copies only. Of rows that repeat (id and
    text; null ids too) one, any, counts as the earliest; the others keep their blank lines. Lines of texts with a null id come last, in
    order of line number and text hash. Columns of docs named as the new ones are replaced; an empty table gives no rows. A very long
    text is a row like others; a very long line takes memory in proportion to itself."""
    d, key = docs.drop("kept", "n_lines", "n_dropped", "__dropped", "__later"), ["no_id", "id", "h"]
    names = d.columns
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, segments).select(*key, F.col("dropped").alias("__dropped"))
    twice = materialize(docs.select(*identity(docs)).groupBy(*key).count().filter("count > 1").select(*key), "twice")
    same = lambda x, y: (x.doc_id.isNull() == y.no_id) & (F.coalesce(x.doc_id.cast("long"), F.lit(0)) == y.id) & (F.xxhash64(F.coalesce(x.text, F.lit(""))) == y.h)
    later = None
    if not twice.isEmpty():
        again = materialize(d.join(twice, same(d, twice), "left_semi").withColumn("__row", F.monotonically_increasing_id()), "again")
        one = again.groupBy(*identity(again)).agg(F.min("__row").alias("__row")).select("__row")
        later = again.join(one, "__row", "left_anti").select(*names)
        d = d.join(twice, same(d, twice), "left_anti").unionByName(again.join(one, "__row", "left_semi").select(*names))
    j = d.join(gone, same(d, gone), "left").select(*(d[c] for c in names), "__dropped")
    parts = F.split(text_or_empty(), "\n", -1)
    keep = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("__dropped", i), x)), lambda x: x.isNotNull())
    kept = F.when(F.col("__dropped").isNull(), text_or_empty()).otherwise(F.array_join(keep, "\n"))
    out = j.select(*names, kept.alias("kept"), F.size(parts).alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).alias("n_dropped"))
    if later is not None:
        blank = F.filter(parts, lambda x: ~counts(x))
        out = out.unionByName(later.select(*names, F.array_join(blank, "\n").alias("kept"), F.size(parts).alias("n_lines"), (F.size(parts) - F.size(blank)).alias("n_dropped")))
    return out


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.greatest(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("kept_chars"))


ORACLE = """
with d as (select row_number() over (order by doc_id nulls last, coalesce(text, '')) rid, doc_id, string_split(coalesce(text, ''), chr(10)) p from documents),
l as (select rid, (doc_id is null, coalesce(doc_id, 0), no, rid) w, no, x from (select rid, doc_id, unnest(p) x, generate_subscripts(p, 1) no from d)),
u as (select x, length(x) n, min(w) f from l where regexp_matches(x, '[^\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') group by x),
h as (select *, left(x, m // 2) a, right(x, m - m // 2) b, m from u, unnest([n, n - 1]) t(m) where n >= 16),
c as (select p.x px, q.x qx from h p join h q on p.m = q.m and p.a = q.a and q.f < p.f union select p.x, q.x from h p join h q on p.m = q.m and p.b = q.b and q.f < p.f),
nd as (select distinct px from c where abs(length(px) - length(qx)) <= 1 and levenshtein(px, qx) <= 1),
k as (select l.*, u.f is null or (nd.px is null and u.f = w) keep from l left join u using (x) left join nd on l.x = nd.px),
g as (select rid, count(*)::bigint n_lines, count(*) filter (not keep)::bigint n_dropped, coalesce(string_agg(case when keep then x end, chr(10) order by no), '') t from k group by rid)
select doc_id, n_lines, n_dropped, sha256(t) kept_sha256, length(t)::bigint kept_chars from d join g using (rid)
"""
