"""Bounded-space online packing of token ids.

Each partition keeps `open_windows` windows. A document's ids (and one end id) go, in pieces of at most a window, to the open window
with the least room that holds the piece (best fit). When none holds it, the fullest window is topped up with the head of the piece and
emitted, and the rest is placed again. What is still open at the end of a partition is written too, marked open; these leftovers are laid
end to end by prefix sums and cut at multiples of the window size, so that no task sees more than one partition's few windows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize, text_or_empty

#: White space as the tokenizer's pattern has it. Its pieces never cross these chunks, so a chunk's ids don't depend on its neighbours.
_SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: The added token of byte_bpe_50k.json and its id. It is matched before anything else, so texts are split at it and no chunk spans it.
ADDED, ADDED_ID = "<|endoftext|>", 50256


def encoder(ranks_path: str | None, cache_size: int = 300_000):
    """text -> array of ids. Ids of chunks are kept for the next texts; the kept ones are dropped all at once when there are too many. A
    ranks file of one's own has no added token."""
    import numpy as np
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # A run of white space is one piece; the pattern's look-ahead would go back over all of it, and overflows the stack on long ones.
    encode_space = tiktoken.Encoding("space", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, bytes] = {}
    added = np.asarray([ADDED_ID], dtype="<u4").tobytes()

    def ids(text: str) -> bytes:
        if len(known) > cache_size:
            known.clear()
        return added.join(map(plain, text.split(ADDED))) if ranks_path is None else plain(text)

    def plain(text: str) -> bytes:
        out = []
        for chunk in CHUNK.findall(text):
            got = known.get(chunk)
            if got is None:
                got = np.asarray((encode_space if chunk.isspace() else encode)(chunk), dtype="<u4").tobytes()
                if len(chunk) <= 64:
                    known[chunk] = got
            out.append(got)
        return b"".join(out)

    return ids


class Packer:
    """Open windows of one partition. A piece is (doc, start, ids as little-endian bytes)."""

    def __init__(self, size: int, open_windows: int) -> None:
        self.size, self.most, self.windows, self.next = size, open_windows, [], 0

    def put(self, doc: int, start: int, ids: bytes) -> Iterator[tuple]:
        """Rows (window number, offset, doc, start, ids) of the windows that this piece completes."""
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.windows if w[0] >= min(n, self.size)]
            if fits and n <= self.size:
                w = min(fits, key=lambda w: w[0])
            elif len(self.windows) < self.most or n >= self.size:
                w = [self.size, []]
                self.windows.append(w)
            else:
                w = min(self.windows, key=lambda w: w[0])
            take = min(n, w[0])
            w[1].append((self.size - w[0], doc, start, ids[: 4 * take]))
            w[0] -= take
            start, ids = start + take, ids[4 * take :]
            if not w[0]:
                self.windows.remove(w)
                yield from self.rows(w)

    def rows(self, w: list) -> Iterator[tuple]:
        self.next += 1
        for piece in w[1]:
            yield (self.next - 1, *piece)


def pack(docs: DataFrame, size: int = 1024, open_windows: int = 16, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, start (ids of its document before it), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id, offset. Each sequence holds at most `size` ids; all but the very last are full.

    A null or empty text is the end id alone. Null ids and repeated rows are documents like others; other columns are ignored, whatever
    their names; an empty table gives no rows. A very long text is tokenized in chunks that no token spans, runs of white space of any
    length as one piece; the added token in a text counts as that token. The end id closes each document. Texts are tokenized once; the
    pieces are written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, encode, packer = TaskContext.get().partitionId(), encoder(ranks_path), Packer(size, open_windows)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        keys: dict[int, tuple] = {}  # of documents with pieces that aren't out yet
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])

        def batch(rows: list[tuple], still_open: bool) -> pa.RecordBatch:
            cols = [[keys[r[2]][0] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [keys[r[2]][1] for r in rows], [part] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [still_open] * len(rows)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        serial, rows, held = 0, [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                keys[serial] = (doc_id, len(ids) // 4)
                rows += packer.put(serial, 0, ids)
                held, serial = held + len(ids), serial + 1
                if held > 4_000_000:
                    yield batch(rows, False)
                    live = {p[1] for w in packer.windows for p in w[1]}
                    keys, rows, held = {k: v for k, v in keys.items() if k in live}, [], 0
        if rows:
            yield batch(rows, False)
        if left := [r for w in packer.windows for r in packer.rows(w)]:
            yield batch(left, True)

    schema = "doc_id long, start long, ids binary, doc_tokens long, part long, window long, offset long, open boolean"
    p = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema), "pieces")
    n = (F.octet_length("ids") / 4).cast("long")
    full = p.filter("not open").select("doc_id", "start", n.alias("length"), "ids", "doc_tokens", (F.shiftleft("part", 32) + F.col("window")).alias("sequence_id"), "offset")

    left = p.filter("open").withColumn("n", n)
    order = Window.partitionBy("part").orderBy("window", "offset").rowsBetween(Window.unboundedPreceding, -1)
    sums = left.groupBy("part").agg(F.sum("n").alias("sum"))  # a row for each partition that the documents came in
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.withColumn("pos", F.coalesce(F.sum("n").over(order), F.lit(0))).join(sums.select("part", before.alias("before")), "part").withColumn("pos", F.col("pos") + F.col("before"))
    cut = left.withColumn("seq", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("pos") + F.col("n") - 1) / size))))
    a, b = F.greatest("pos", F.col("seq") * size), F.least(F.col("pos") + F.col("n"), (F.col("seq") + 1) * size)
    cut = cut.select("*", (a - F.col("pos")).alias("skip"), (b - a).alias("length"), (a - F.col("seq") * size).alias("at"))
    ids = F.substring("ids", F.lit(4) * F.col("skip").cast("int") + 1, F.lit(4) * F.col("length").cast("int"))
    merged = cut.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), "length", ids.alias("ids"), "doc_tokens", (-1 - F.col("seq")).alias("sequence_id"), F.col("at").alias("offset"))
    return full.unionByName(merged)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
