"""Benchmark decontamination as a prefix-filtered set join (built-in functions only).

An item gives windows of `width` consecutive words (an item of fewer words gives one window). Containment of a window must be
complete, so one token of it is a sufficient prefix: its rarest, by the words' counts in all documents. Documents' words meet
windows on that token; the offset of the token bounds where the window can start and end (positional and length bounds), and the
slice of the document's words is then compared with the window's, first folded and then exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import LOWER, UPPER, WORD, folded_words, materialize, text_or_empty


def exact_words(text: Column) -> Column:
    """Words after A-Z alone went to lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(words, items): distinct windows and the sorted ids of the items that have them. Null texts have no window, null ids are left out."""
    w = items.select("item_id", exact_words(text_or_empty()).alias("w")).filter("item_id is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def with_prefix(windows: DataFrame, docs: DataFrame, max_broadcast: int) -> DataFrame:
    """Adds folded (the window's folded words), prefix (its rarest word) and at (that word's place, from 0)."""
    windows = windows.withColumn("folded", F.transform("words", lambda x: F.replace(F.lower(x), F.lit("ς"), F.lit("σ"))))
    vocabulary = windows.select(F.explode("folded").alias("word")).distinct()
    seen = docs.select(F.explode(folded_words(text_or_empty())).alias("word"))
    if vocabulary.count() <= max_broadcast:
        counts = seen.join(F.broadcast(vocabulary), "word").groupBy("word").count()
    else:  # counts first, so that the shuffle has a row for a word and task
        counts = seen.groupBy("word").count().join(vocabulary, "word")
    places = windows.select("*", F.posexplode("folded").alias("at", "word")).join(counts, "word", "left")
    best = F.min_by(F.struct(F.col("word").alias("prefix"), "at"), F.struct(F.coalesce("count", F.lit(0)), "word", "at")).alias("p")
    return places.groupBy("words").agg(F.first("items").alias("items"), F.first("folded").alias("folded"), best).select("words", "items", "folded", "p.prefix", "p.at")


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, h, w (folded words), x (the exact words where they may differ, else null). Folding changes an ASCII text as the exact way does."""
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), text_or_empty().alias("text"))
    plain = F.octet_length("text") == F.length("text")
    alike = F.replace(F.lower("text"), F.lit("ς"), F.lit("σ")) == F.translate("text", UPPER, LOWER)
    return d.select("doc_id", "h", folded_words(F.col("text")).alias("w"), F.when(~plain & ~alike, exact_words(F.col("text"))).alias("x"))


def is_hit(start: Column, folded: Column, words: Column) -> Column:
    """Whether the window (folded, words) stands at start (from 0) among the words w and x."""
    n = F.size(folded)
    whole = (start >= 0) & (start + n <= F.size("w"))
    same = F.slice("w", start + 1, n) == folded
    exact = F.slice(F.coalesce("x", "w"), start + 1, n) == words
    return F.when(whole, F.when(same, exact)).otherwise(False)


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, start, length, items), and a row with start null for each document. windows is small enough to broadcast.
    The words and the match all stay within one stage; only hits and one row a document leave it."""
    e = with_words(docs).select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    j = e.join(F.broadcast(windows), e.word == windows.prefix, "left").withColumn("start", F.col("pos") - 1 - F.col("at"))
    hit = (F.col("pos") > 0) & is_hit(F.col("start"), F.col("folded"), F.col("words"))
    first = F.col("pos") == 0
    return j.filter(first | hit).select("doc_id", "h", F.when(first, F.size("w")).alias("n_words"), F.when(~first, F.col("start")).alias("start"), F.when(~first, F.size("folded")).alias("length"), "items")


def occurrences_by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for windows of any number: words meet them on the prefix in a shuffle, as (text, place) alone, and what they name is compared
    within the text."""
    d = with_words(docs)
    e = d.select("doc_id", "h", F.posexplode("w").alias("pos", "word"))
    c = e.join(windows, e.word == windows.prefix).select("doc_id", "h", F.struct((F.col("pos") - F.col("at")).alias("start"), "folded", "words", "items").alias("c"))
    g = c.filter("c.start >= 0").groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.collect_set("c").alias("c"))
    j = d.join(g, d.doc_id.eqNullSafe(g.d2) & d.h.eqNullSafe(g.h2), "left")
    hits = F.filter(F.coalesce("c", F.array()), lambda c: is_hit(c.start, c.folded, c.words))
    head = F.struct(F.size("w").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    rows = F.concat(F.array(head), F.transform(hits, lambda c: F.struct(F.lit(None).cast("int").alias("n_words"), c.start.alias("start"), F.size(c.folded).alias("length"), c["items"].alias("items"))))
    return j.select("doc_id", "h", F.explode(rows).alias("r")).select("doc_id", "h", "r.*")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, max_broadcast: int = 100_000) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, h (hash of the text), n_words, hits (array of (start, length), distinct and
    sorted), items (sorted ids), n_hit. One row for each row of docs.

    Null and empty texts have no words; repeated rows each get their row; other columns are ignored, whatever their names; without items
    nothing is hit, and without documents there are no rows. A window that is long or stands many times in a text costs in proportion to
    its length. max_broadcast bounds the windows (and words) that are broadcast; more of them meet the words in a shuffle."""
    windows = materialize(with_prefix(materialize(item_windows(items, width), "windows"), docs, max_broadcast), "prefixes")
    few = windows.count() <= max_broadcast
    found = (occurrences if few else occurrences_by_shuffle)(docs, windows)
    hit = F.when(F.col("start").isNotNull(), F.struct(F.col("start"), F.col("length")))
    g = found.groupBy("doc_id", "h").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set(hit)).alias("hits"), F.collect_set("items").alias("items"))
    end = F.lit(0).cast("int")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("int").alias("n"), end.alias("end")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.start + x.length - F.greatest(a.end, x.start))).alias("n"), F.greatest(a.end, x.start + x.length).alias("end")),
        lambda a: a.n,
    )
    g = g.select("doc_id", "h", "n_words", "copies", "hits", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), covered.alias("n_hit"))
    return g.select("doc_id", "h", "n_words", "hits", "items", "n_hit", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = """
with iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
            from benchmark where item_id is not null),
win as (select distinct item_id, w[i:i + 9] ws, len(w[i:i + 9]) l from iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(i) where len(w) > 0),
dw as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
       from documents),
lens as (select distinct l from win),
dg as (select rid, i, l, w[i:i + l - 1] ws from dw, lens, unnest(range(1, len(w) - l + 2)) r(i)),
m as (select rid, i, dg.l, item_id from dg join win on dg.l = win.l and dg.ws = win.ws),
hp as (select rid, count(distinct i + k) n_hit from m, unnest(range(0, l)) r(k) group by rid),
hi as (select rid, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct rid, item_id::varchar s from m) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hp using (rid) left join hi using (rid)
"""
