"""SimHash near-dedup with pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Two of them can only differ in
few bits if they agree in some of the blocks the bits are cut into, so equal blocks
bring candidates together. There, a table of the distances of every fingerprint to
the same reference fingerprints decides first: the distances of two fingerprints to
a reference differ by at most their own distance, so a pair with a greater difference
in any column is discarded. What is left is verified bit by bit.

Equal fingerprints are merged before, and of the links within a bucket a spanning
forest is kept, so the links stay fewer than the fingerprints of a bucket. Buckets of
more than SLAB members are compared slab against slab, each pair of slabs on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from dosequant.llm.components import components
from dosequant.llm.storage import written
from dosequant.llm.words import scatter
from dosequant.operators.skew import join_apart

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Number of blocks; fingerprints meet if they agree in all but DISTANCE of them.
BLOCKS = 6
#: Number of reference fingerprints, and of members compared in one go.
PIVOTS, SLAB = 16, 50_000
#: Buckets of up to so many members are compared all at once with others.
SMALL = 48

REFERENCES = scatter(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text; 0 without words. Fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`df` with `fp`, the fingerprint as a signed long, instead of its texts."""
    kept = [f for f in df.schema.fields if f.name not in (text, "fp")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], [*names, "fp"])

    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return df.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, schema)


def _keys(blocks: int, distance: int) -> list[int]:
    """Masks of the bits in which two close fingerprints agree at least once."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(masks, blocks - distance)]


class Forest:
    """Links between fingerprints, less those that others imply."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.root(x)) for x in self.parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to the references: one row per reference."""
    return np.bitwise_count(fps[None, :] ^ REFERENCES[:, None]).astype(np.int8)


def close_pairs(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int):
    """Of the pairs (a, b) those that no reference discards and whose bits agree."""
    for column in table:
        near = np.abs(column[a] - column[b]) <= distance
        if not near.all():
            a, b = a[near], b[near]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
    return a[near], b[near]


def link_bucket(fps: np.ndarray, sides: np.ndarray, distance: int, forest: Forest) -> None:
    """Link the members of a large bucket.

    Members reached from another are set aside, as they need not be reached again;
    each is compared with the members not yet reached whose distance to the first
    reference is close enough. With two slabs, only pairs across them are new.
    """
    order = np.argsort(np.bitwise_count(fps ^ REFERENCES[0]), kind="stable")
    fps, sides = fps[order], sides[order]
    table = pivot_table(fps)
    first = table[0].astype(np.int64)
    both = len(np.unique(sides)) > 1
    left = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            low, high = np.searchsorted(first, (first[x] - distance, first[x] + distance + 1))
            members = low + np.flatnonzero(left[low:high])
            if both and len(members):
                members = members[sides[members] != sides[x]]
            _, found = close_pairs(fps, table, np.full(len(members), x), members, distance)
            for y in found.tolist():
                forest.link(int(fps[x]), int(fps[y]))
            left[found] = False
            todo.extend(found.tolist())


def _link(distance: int):
    def group_ends(key: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))

    def handle(key: np.ndarray, fps: np.ndarray, sides: np.ndarray, forest: Forest) -> None:
        ends = group_ends(key)
        sizes = np.diff(np.concatenate(([0], ends)))
        for end, size in zip(ends[sizes > SMALL], sizes[sizes > SMALL]):
            link_bucket(fps[end - size : end], sides[end - size : end], distance, forest)
        each = np.repeat(sizes, sizes)
        keep = (each > 1) & (each <= SMALL)
        key, fps, each = key[keep], fps[keep], each[keep]
        if not len(key):
            return
        table = pivot_table(fps)
        for step in range(1, int(each.max())):
            a = np.flatnonzero(key[step:] == key[:-step])
            if not len(a):
                break
            a, b = close_pairs(fps, table, a, a + step, distance)
            for x, y in zip(fps[a].tolist(), fps[b].tolist()):
                forest.link(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            key = part[0]
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])  # the last bucket may go on
            if last:
                handle(*[x[:last] for x in part], forest)
            held = [x[last:] for x in part]
        if held is not None:
            handle(*held, forest)
        u, v = forest.links()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (u, v)], ["u", "v"]
        )

    return run


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (`u`, `v`) between distinct fingerprints (`fp`, long) that differ in at
    most `distance` bits; pairs that others connect may be left out."""
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    keys = [
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(mask))))
        for i, mask in enumerate(_keys(blocks, distance))
    ]
    met = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SLAB)
    slabs = F.ceil(F.col("n") / SLAB).cast("int")
    met = join_apart(met, sizes, "key", "size", "left")
    slab = F.pmod(F.xxhash64("fp", F.lit(7)), slabs).cast("int")
    pairs = F.when(
        F.col("n").isNotNull(),
        F.transform(F.sequence(F.lit(0), slabs - 1), lambda j: F.struct(F.least(j, slab).alias("i"), F.greatest(j, slab).alias("j"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    met = met.withColumn("side", F.when(F.col("n").isNotNull(), slab).otherwise(0)).withColumn("pair", F.explode(pairs))
    route = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", "pair"))
    return (
        met.select(route.alias("route"), "fp", "side")
        .repartition("route")
        .sortWithinPartitions("route")
        .mapInArrow(_link(distance), "u bigint, v bigint")
    )


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """One row per row of `df`: `doc_id`, `fingerprint` (16 hex digits) and
    `component_id`, the least id in the row's group of linked fingerprints.

    Rows with equal fingerprints are linked; null and empty texts have fingerprint 0.
    Rows without an id belong to groups but never name them; a group without any id
    has a null component_id. Repeated rows are returned as often; other columns, what-
    ever their names, are neither read nor returned. A text is one row of one task from
    its words to its fingerprint, so its length is bounded by a task's memory only.
    """
    rows = written(
        with_fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", shingle),
        "fingerprints",
    )
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(fingerprint_links(fps.select("fp"), distance))
    rooted = join_apart(fps, roots.withColumnRenamed("node", "fp"), "fp", "root", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_apart(rooted.select("fp", "root"), groups, "root", "group").select("fp", "component_id")
    return join_apart(rows, named, "fp", "rows").select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
