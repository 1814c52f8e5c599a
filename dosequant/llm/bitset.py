"""Sets of 64-bit hashes as bits of fixed number, for tests in tasks that never miss."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits per member, as far as MOST_BITS (16 MB) goes; with more members more hashes
#: than need be pass, up to all.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 27
_SECOND = np.uint64(0x9E3779B97F4A7C15)


class Bits:
    def __init__(self, parts: dict[int, bytes], bits: int):
        """`parts` has, by number, the compressed parts in which any bit is set."""
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits >> 3, np.uint8)
        for number, part in parts.items():
            part = np.frombuffer(zlib.decompress(part), np.uint8)
            self.bytes[(number - 1) * len(part) : number * len(part)] = part

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """True for all members, and for few others."""
        out = np.ones(len(hashes), bool)
        for at in places(hashes, self.mask):
            out &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that stand for each hash."""
    return hashes & mask, ((hashes * _SECOND) >> np.uint64(32)) & mask


def bits_of(members: DataFrame, hashes: Callable, columns: list[str], count: int) -> Callable[[], Bits]:
    """The set of the hashes that `hashes` makes of batches of `members`.

    `count` is about how many there are. Bits are set and merged by Spark in parts of
    4 kB; only the parts reach the driver, MOST_BITS at most, and are broadcast.
    """
    bits = LEAST_BITS
    while bits < min(count * BITS_EACH, MOST_BITS):
        bits *= 2
    mask = np.uint64(bits - 1)

    def run(batches):
        for found in hashes(batches):
            for at in places(found, mask):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int64))], ["at"])

    parts = (
        members.select(columns)
        .mapInArrow(run, "at long")
        .groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    )
    sent = members.sparkSession.sparkContext.broadcast(
        {r["part"]: zlib.compress(bytes(r["bits"]), 1) for r in parts.collect()}
    )
    built: list[Bits] = []

    def get() -> Bits:
        if not built:
            built.append(Bits(sent.value, bits))
        return built[0]

    return get
