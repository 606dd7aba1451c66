"""Hashes of all stretches of one length in a batch of texts, as vectors over code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the hash.
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many characters, one row at least."""
    part = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False)) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the stretches of x, each with the one of y that begins n places later; the last n are not whole."""
    z = x * A
    z[: len(z) - n] += y[n:]
    z *= B
    z ^= z >> np.uint64(29)
    return z


class Texts:
    """A few texts, one after the other, as code points."""

    def __init__(self, texts: list[str]) -> None:
        length = np.array([len(x) for x in texts], np.int64)
        self.end = np.cumsum(length)
        self.row = np.repeat(np.arange(len(texts)), length)
        self.left = np.repeat(self.end, length) - np.arange(length.sum())  # characters from here to the end of the text
        x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.levels = [joined(x, x, len(x))]  # of 1, 2, 4.. characters

    def hashes(self, n: int) -> np.ndarray:
        """The hash of the n characters from each place on; whole where left >= n."""
        while 2 << len(self.levels) - 1 <= n:
            self.levels.append(joined(self.levels[-1], self.levels[-1], min(1 << len(self.levels) - 1, len(self.row))))
        got, have = None, 0
        for bit in reversed(range(len(self.levels))):
            if n >> bit & 1:
                got, have = (self.levels[bit] if got is None else joined(got, self.levels[bit], min(have, len(self.row)))), have + (1 << bit)
        return got

    def least(self, n: int, gram: int) -> np.ndarray:
        """For each place the least hash of the stretches of `gram` characters within the n from there on; whole where left >= n."""
        x, have, want = self.hashes(gram).copy(), 1, n - gram + 1
        while have < want:
            step = min(have, want - have)
            x[: max(0, len(x) - step)] = np.minimum(x[: max(0, len(x) - step)], x[step:])
            have += step
        return x
