"""The terms of functions.text over whole Arrow columns, for tasks that read many texts."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import TERM


@cache
def kinds(spark: SparkSession) -> np.ndarray:
    """For each code point 0 if it stands in no term, 1 if in a run of others, 2 if it is a term by itself: the terms in two of it, as Spark finds them."""
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    n = F.size(F.regexp_extract_all(F.concat(c, c), F.lit(TERM), F.lit(0)))
    points = spark.range(0x110000).filter("id not between 55296 and 57343")  # no halves of pairs
    found = points.select("id", n.cast("byte").alias("kind")).filter("kind > 0").toPandas()
    out = np.zeros(0x110000, np.uint8)
    out[found["id"]] = found["kind"]
    return out


def terms_of(texts: pa.StringArray, kinds: np.ndarray) -> pa.ListArray:
    """Lower-case texts without nulls -> the terms of each. Works on the UTF-8 bytes of all texts at once."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = np.frombuffer(bytearray(data.tobytes().translate(kinds[:128].tobytes() + bytes(128))), np.uint8)
    head = np.flatnonzero(data >= 0xC0)  # first bytes of longer characters
    first, size = data[head].astype(np.int32), 2 + (data[head] >= 0xE0) + (data[head] >= 0xF0)
    point = first & (0xFF >> (size + 1))
    for i in (1, 2, 3):
        more = size > i
        point[more] = point[more] << 6 | data[head[more] + i] & 0x3F
    of = kinds[point]
    kind[head] = of
    for i in (1, 2, 3):
        kind[head[size > i] + i] = of[size > i]
    inside = kind > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    alone = of == 2
    for at in (ends, head[alone], (head + size)[alone]):
        at = at[at < len(data)]
        start[at] = inside[at]
    places = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(np.flatnonzero(start), ends), pa.int32()), found)


def postings_of(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Lists of terms -> row and term of each posting, ordered by row, where its places begin (one more at the end), and all places (from 0, among the terms of a row)."""
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = lists.flatten().dictionary_encode()
    n = max(1, len(terms.dictionary))
    key = row * n + terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(np.ones(len(key[:1]), bool), key[1:] != key[:-1]))
    places = np.arange(len(row)) - lists.offsets.to_numpy()[row]
    return key[first] // n, terms.dictionary.take(pa.array(key[first] % n)), np.append(first, len(key)), places[order]
