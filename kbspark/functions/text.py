"""Scalar functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One CJK character, or a run of letters and digits.
TERM = r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"
#: Masking rules in order: name, pattern, replacement (the parts that stay are groups).
MASKS = [
    ("id_number", r"(?<![0-9])([0-9]{6})[0-9]{8}([0-9]{4})(?![0-9])", "$1****$2"),
    ("mobile", r"(?<![0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})(?![0-9])", "$1****$2"),
    ("bank_card", r"(?<![0-9])([0-9]{4})[0-9]{8,12}([0-9]{4})(?![0-9])", "$1****$2"),
    ("salary", r"(年薪|月薪|工资|收入)\s*[0-9.,]+万?", "$1 [REDACTED]"),
    ("email", r"([a-zA-Z0-9._%+-]{1,3})[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2"),
]


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("long")


def chunk_id(doc: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc, index), 256)


def truncate_text(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def space_cjk(text: Column) -> Column:
    return F.regexp_replace(text, r"([一-鿿])", " $1 ")


def mask_pii(text: Column) -> Column:
    """The rules, one after the other on the text as masked so far."""
    for _, pattern, to in MASKS:
        text = F.regexp_replace(text, pattern, to)
    return text


def bigrams(text: Column) -> Column:
    chars = F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit("(?s)."), F.lit(0))
    rest = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), rest), F.slice(chars, F.lit(2), rest), lambda x, y: F.concat(x, y)))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def round_places(x: Column, places: int) -> Column:
    """Rounded as SQL does with doubles: by the product, whose half goes away from zero, and not by the decimal that is shown."""
    return F.round(x * 10**places) / 10**places


def intent(q: Column) -> Column:
    """Ordered rules, the first that holds names the intent."""
    rules = [("compare", r"(?i)对比|比较|区别|差异|不同|\bvs\b|compare|difference"), ("summary", r"(?i)总结|概括|概述|摘要|summar|overview"), ("howto", r"(?i)如何|怎么|怎样|步骤|how to|how do|steps")]
    out = F.lit("factoid")
    for name, pattern in reversed(rules):
        out = F.when(q.rlike(pattern), name).otherwise(out)
    return out


def cache_key(q: Column) -> Column:
    return F.substring(F.md5(F.trim(q)), 1, 16)


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("pdf", "docx", "xlsx", "pptx", "md", "html", "txt"), ext).when(ext == "htm", "html").when(ext == "markdown", "md").otherwise(F.lit("unknown"))
