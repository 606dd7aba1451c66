"""Secret scan with multipart credential linking (built-in functions only).

Base spans come from three patterns. Weak candidates (temporary or labelled access identifiers, unlabelled mixed keys, endpoints)
are reported only when complementary parts stand within `scope` code points of them in the same text: an identifier needs a
secret, a key needs an identifier, an endpoint needs both. The parts meet in an interval join on bins of that width, and only parts that
don't overlap vouch for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialize, text_or_empty

#: Kind, pattern, a cheap test that any match passes (None: the pattern itself), group that must be of a least length,
#: that length, part it plays, weak. Runs shorter than a pattern's least length can't hold a longer match, so {n,} equals + and a test.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None, 2, 6, "secret", False),
    ("access", r"AKIA[A-Z0-9]{16,}", "AKIA", 0, 20, "identifier", False),
    ("hex", r"[0-9a-f]{24,}", None, 0, 24, "secret", False),
    ("id", r"""(ASIA|AROA|AIDA)[A-Z0-9]{12,}|(client_id|access_key_id|account_id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+""", None, 0, 4, "identifier", True),
    ("key", r"[A-Za-z0-9+/_-]{32,}={0,2}", None, 0, 32, "secret", True),
    ("endpoint", r"""https?://[A-Za-z0-9._:/?&=%#~+-]+""", "://", 0, 10, "endpoint", True),
]
ORDER = [k[0] for k in KINDS]
SPAN = "array<struct<s:int,k:int,e:int>>"


def sums_before(a: Column, block: int = 64) -> Column:
    """For each number of the array the sum of those before it. The sums go block by block, so that no long array is built up one by one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, F.lit(block)))
    start = lambda x: F.struct(x.cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, x: F.struct((acc.sum + x).alias("sum"), F.concat(acc.out, F.array(acc.sum)).alias("out"))
    whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    firsts = F.aggregate(whole, start(F.lit(0)), add, lambda acc: acc.out)
    return F.when(F.size(a) > 0, F.flatten(F.zip_with(blocks, firsts, lambda b, s: F.aggregate(b, start(s), add, lambda acc: acc.out)))).otherwise(F.array().cast("array<int>"))


def with_spans(df: DataFrame, k: int) -> DataFrame:
    """df (.., text) with s<k>: array of (s, k, e) for the matches of kind k. Starts follow from the lengths of what lies between matches.
    Code points, e exclusive."""
    _, pattern, sure, group, least, _, _ = KINDS[k]
    text = F.when(F.contains("text", F.lit(sure)) if sure else F.col("text").rlike(pattern), F.col("text"))
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    d = df.withColumns({"__b": F.split(text, pattern, -1), "__m": F.arrays_zip(whole.alias("w"), part.alias("p"))})
    d = d.withColumn("__l", F.zip_with(F.slice("__b", 1, F.size("__m")), "__m", lambda b, m: F.length(b) + F.length(m.w)))
    d = d.withColumn("__s", sums_before(F.col("__l")))

    def good(m: Column) -> Column:
        long = F.length(m.p) >= least
        if ORDER[k] == "key":  # mixed: an upper-case letter, a lower-case one and a digit
            return long & m.w.rlike("[A-Z]") & m.w.rlike("[a-z]") & m.w.rlike("[0-9]")
        return long

    ends = F.zip_with("__s", "__l", lambda s, n: s + n)
    found = F.zip_with(ends, "__m", lambda e, m: F.when(good(m), F.struct((e - F.length(m.w)).alias("s"), F.lit(k).alias("k"), e.alias("e"))))
    none = F.array().cast(SPAN)
    return d.withColumn(f"s{k}", F.coalesce(F.filter(found, lambda x: x.isNotNull()), none)).drop("__b", "__m", "__l", "__s")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base and linked (arrays of (s, k, e), k indexes ORDER, sorted). One row for each row of docs.

    A null text is empty; null ids and repeated rows are kept; other columns are ignored, whatever their names; an empty table gives no
    rows. Equal texts under one id share their links. A weak span that overlaps a base span is part of it and not reported, nor is an
    unlabelled key within an identifier or an endpoint. Work and space grow with a text's length, however many spans it holds."""
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), text_or_empty().alias("text"))
    for k in range(len(KINDS)):
        d = with_spans(d, k)
    d = materialize(d.drop("text").withColumn("row", F.monotonically_increasing_id()), "spans")
    # Spans that overlap: the parts of one text meet in bins, since a text may hold very many.
    each = d.select("row", F.explode(F.concat(*(F.col(f"s{k}") for k in range(len(KINDS))))).alias("x"))
    weak = each.filter(F.col("x.k") >= 3)
    rank = F.when(F.col("x.k") < 3, 0).when(F.col("x.k") == ORDER.index("key"), 2).otherwise(1)
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / scope), F.floor((e - 1) / scope)))
    mine = weak.select("row", "x", rank.alias("rank"), bins(F.col("x.s"), F.col("x.e")).alias("bin"))
    over = each.filter(rank < 2).select("row", F.col("x.s").alias("s2"), F.col("x.e").alias("e2"), rank.alias("rank2"), bins(F.col("x.s"), F.col("x.e")).alias("bin"))
    covered = mine.join(over, ["row", "bin"]).filter("rank2 < rank and x.s < e2 and s2 < x.e").select("row", "x").distinct()
    free = weak.join(covered, ["row", "x"], "left_anti").groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("weak"))
    none = F.array().cast(SPAN)
    base = F.array_sort(F.concat(*(F.col(f"s{k}") for k in range(3))))
    d = materialize(d.select("row", "doc_id", "h", base.alias("base")).join(free, "row", "left").withColumn("weak", F.coalesce("weak", none)), "parts")

    with_weak = d.filter("size(weak) > 0").dropDuplicates(["doc_id", "h"])
    part = F.element_at(F.array(*(F.lit(k[5]) for k in KINDS)), F.col("x.k") + 1)
    own = with_weak.select("doc_id", "h", F.explode("weak").alias("x"))
    other = with_weak.select("doc_id", "h", F.explode(F.concat("base", "weak")).alias("x")).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("x.s").alias("s2"), F.col("x.e").alias("e2"), part.alias("part"))
    own = own.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x.s") / scope), F.floor(F.col("x.e") / scope))))
    other = other.withColumn("bin2", F.explode(F.sequence(F.floor((F.col("s2") - scope) / scope), F.floor((F.col("e2") + scope) / scope))))
    near = own.join(other, own.doc_id.eqNullSafe(other.d2) & (own.h == other.h2) & (own.bin == other.bin2) & (F.col("x.s") <= F.col("e2") + scope) & (F.col("s2") <= F.col("x.e") + scope) & ((F.col("e2") <= F.col("x.s")) | (F.col("x.e") <= F.col("s2"))))
    near = near.groupBy("doc_id", "h", "x").agg(F.bool_or(F.col("part") == "identifier").alias("has_id"), F.bool_or(F.col("part") == "secret").alias("has_secret"))
    kind = F.element_at(F.array(*(F.lit(k) for k in ORDER)), F.col("x.k") + 1)
    good = F.when(kind == "id", F.col("has_secret")).when(kind == "key", F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    linked = near.filter(good).groupBy(F.col("doc_id").alias("d3"), F.col("h").alias("h3")).agg(F.array_sort(F.collect_list("x")).alias("linked"))
    out = d.join(linked, d.doc_id.eqNullSafe(linked.d3) & d.h.eqNullSafe(linked.h3), "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    name = F.array(*(F.lit(k) for k in ORDER))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(name, x.k + 1), x.s, x.e)), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "linked"))).alias("spans"))
