"""Count-min sketch of 64-bit keys, built per partition and merged by Spark.

Every batch sends, for each row of the sketch, the cells it hits and how often. Cells
are cut into shards, which are added up one after the other, row by row. What remains
of the sum is two bits per cell: whether a key that hits it may occur twice, and
whether often.
Counts are never too low; the size is fixed by its parameters, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS, CELL_BITS, SHARD_BITS = 2, 26, 16
#: Counts from here on are "often"; sums stop growing there.
OFTEN = 200

_SHARD = 1 << SHARD_BITS


def _cell(keys: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    mixed = keys * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[row])
    return mixed >> np.uint64(64 - cell_bits)


def _sent(keys: np.ndarray, cell_bits: int, often: int) -> Iterator[pa.RecordBatch]:
    """Cells hit by the keys of one batch, as two-byte numbers in their shard."""
    ids, payloads, extras = [], [], []
    for row in range(ROWS):
        cells = np.sort(_cell(keys, row, cell_bits))
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        counts = np.minimum(np.diff(np.append(first, len(cells))), often).astype(np.uint8)
        cells = cells[first]
        shard = (cells >> np.uint64(SHARD_BITS)).astype(np.int64)
        low = (cells & np.uint64(_SHARD - 1)).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(low))):
            ids.append((row << (cell_bits - SHARD_BITS)) + int(shard[a]))
            payloads.append(low[a:b].tobytes())
            extras.append(counts[a:b].tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(payloads, pa.binary()), pa.array(extras, pa.binary())],
        ["shard", "cells", "counts"],
    )


def _merged(often: int):
    """The bits of each shard, from rows sorted by shard; one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda bits: zlib.compress(np.packbits(bits).tobytes(), 1)
        current, total = None, np.zeros(_SHARD, np.int32)

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([packed(total >= 2)]), pa.array([packed(total >= often)])],
                ["shard", "twice", "often"],
            )

        for batch in batches:
            for shard, cells, counts in zip(*(batch.column(i) for i in range(3))):
                if shard.as_py() != current:
                    if current is not None:
                        yield done()
                    current = shard.as_py()
                    total[:] = 0
                at = np.frombuffer(cells.as_buffer(), np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), often)
        if current is not None:
            yield done()

    return run


class Estimate:
    """The merged sketch, as tasks use it."""

    def __init__(self, shards: dict[int, tuple[bytes, bytes]], cell_bits: int):
        """`shards` has the compressed bits of those shards that any key hits."""
        self.cell_bits = cell_bits
        many = ROWS << (cell_bits - SHARD_BITS)
        self.bits = [np.zeros((many, _SHARD // 8), np.uint8) for _ in range(2)]
        for shard, parts in shards.items():
            for bits, part in zip(self.bits, parts):
                bits[shard] = np.frombuffer(zlib.decompress(part), np.uint8)
        self.bits = [x.reshape(ROWS, -1) for x in self.bits]

    def _all(self, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            cell = _cell(keys, row, self.cell_bits)
            out &= (bits[row][cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return out

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """True for all keys that occur twice, and for few others."""
        return self._all(keys, self.bits[0])

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        return self._all(keys, self.bits[1])


def estimate(
    df: DataFrame,
    keys: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]],
    cell_bits: int | None = None,
    often: int | None = None,
) -> Callable[[], Estimate]:
    """The sketch of the keys that `keys` makes of the batches of `df`.

    Two bits per cell reach the driver and are broadcast, compressed: at most
    2 * ROWS * 2**cell_bits bits, 32 MB with CELL_BITS.
    """
    cell_bits, often = cell_bits or CELL_BITS, often or OFTEN

    def run(batches):
        held, size = [], 0
        for found in keys(batches):
            held.append(found)
            size += len(found)
            if size >= 1 << 20:
                yield from _sent(np.concatenate(held), cell_bits, often)
                held, size = [], 0
        if size:
            yield from _sent(np.concatenate(held), cell_bits, often)

    spark = df.sparkSession
    merged = (
        df.mapInArrow(run, "shard int, cells binary, counts binary")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_merged(often), "shard int, twice binary, often binary")
    )
    sent = spark.sparkContext.broadcast({shard: (bytes(a), bytes(b)) for shard, a, b in merged.collect()})
    built: list[Estimate] = []

    def get() -> Estimate:
        if not built:
            built.append(Estimate(sent.value, cell_bits))
        return built[0]

    return get
