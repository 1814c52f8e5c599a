"""Words of many texts at once, as arrays: offsets and 64-bit hashes.

Texts are UTF-8 bytes in one buffer, each followed by a space. Hashes depend on the
bytes of a word only, so equal words of any two texts have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Bytes 0x20 and 0x09 to 0x0D end a word.
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII other than letters and digits ends a word.
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[:0x80] = True
NOT_ALPHANUMERIC[0x30:0x3A] = NOT_ALPHANUMERIC[0x41:0x5B] = NOT_ALPHANUMERIC[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)


def scatter(values: np.ndarray) -> np.ndarray:
    """Spread uint64 values so that all bits of the result depend on all bits given."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the radix and of its inverse, kept for the next chunk."""

    size = 0
    up = down = np.empty(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.size < n:
            cls.size = max(n, 1 << 16)
            cls.up, cls.down = _powers(_RADIX, cls.size), _powers(_INVERSE, cls.size)
        if cls.size > 4 * CHUNK_BYTES and n <= CHUNK_BYTES:  # after a very long text
            cls.size = 0
            return cls.upto(n)
        return cls.up[:n], cls.down[:n]


def _byte_values(seed: int) -> np.ndarray:
    return scatter(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D + 2 * seed))


class Words:
    """Words of the texts of one chunk."""

    def __init__(self, texts: list[bytes | None], ends: np.ndarray, lower: bool = False):
        sizes = np.fromiter((len(x) + 1 if x else 1 for x in texts), np.int64, len(texts))
        self.data = np.frombuffer(b" ".join(x or b"" for x in texts) + b" ", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        inside = ~ends[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[::2], edges[1::2]
        #: index of the first word of each text; one more entry for the end
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        up, down = _Powers.upto(len(self.data))
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_byte_values(seed)[self.data] * up, out=sums[1:])
        return scatter((sums[self.end] - sums[self.start]) * down[self.start])

    def fits(self, size: int) -> np.ndarray:
        """For each word, whether `size` words of its text start there."""
        if len(self.start) < size:
            return np.zeros(len(self.start), bool)
        out = np.zeros(len(self.start), bool)
        out[: len(out) - size + 1] = self.text[: len(out) - size + 1] == self.text[size - 1 :]
        return out


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` consecutive values from each place on; 0 where they run out.

    Runs of 1, 2, 4, ... are joined pairwise, then those that add up to `size`.
    """
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n < size:
        return out
    total, done, run, length = None, 0, hashes, 1
    while True:
        if size & length:
            part = run[done : done + n - size + 1]
            total = part if total is None else scatter(total * np.uint64(_RADIX) + part)
            done += length
        if done == size:
            break
        run = scatter(run[:-length] * np.uint64(0xD6E8FEB86659FD93) + run[length:])
        length *= 2
    out[: n - size + 1] = total
    return out


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The least of `size` consecutive values from each place on, as far as they go."""
    out, length = values.copy(), 1
    while length < size:
        step = min(length, size - length)
        if step >= len(out):
            break
        out[:-step] = np.minimum(out[:-step], out[step:])
        length += step
    return out


def chunks(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the batches with about `limit` bytes of text, and their texts."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text or b"") + 1
            if size >= limit or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
