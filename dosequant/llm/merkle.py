"""Merkle dataset manifest: one root for a table, and a witness for each of its rows.

The leaves of a group, in order, are appended to a tree of runs of FAN nodes. A node
that is appended takes its place in the open run of its level; the run is its partial
witness, and each sibling that is completed later extends it. A run that is full
becomes a node of the next level, which is appended there.

Appends are aligned to blocks of FAN ** BLOCK_LEVELS leaves, so that blocks do not
depend on each other: each is one short stream within a task. The roots of the blocks
are treated as further appends, block by block again, until one node is left, and the
nodes that are left of the groups are appended to one tree of groups in the same way.
On the way back the witness of a block's root goes to the block as one row, and
extends the witnesses of all leaves in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dosequant.llm.storage import written

FAN, BLOCK_LEVELS = 16, 3
BLOCK = FAN**BLOCK_LEVELS
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that a task gathers before it sends them on.
HELD_NODES = 4096
_DIGITS = 64
_WITNESS = "array<struct<left:string,right:string>>"


def leaf_hash(*values: Column) -> Column:
    """Digest of the values in order: `-` for a null one, else its number of UTF-8
    bytes, `:` and the value, whole numbers in decimal."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and the siblings of a witness lead to."""
    return F.aggregate(witness, leaf, lambda d, w: F.sha2(F.concat(w["left"], d, w["right"]).cast("binary"), 256))


def proof_hash(witness: Column) -> Column:
    """Digest of all siblings of a witness, level by level, left to right."""
    siblings = F.transform(witness, lambda w: F.concat(w["left"], w["right"]))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def levels_of(n: int) -> int:
    """How many levels of runs lie between `n` nodes and the one that remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Run:
    """Up to FAN consecutive nodes, and what they become when the run is closed."""

    __slots__ = ("digests", "nodes", "text", "parent")

    def __init__(self):
        self.digests, self.nodes, self.text, self.parent = [], [], "", None


class Node:
    __slots__ = ("digest", "run", "at", "known")

    def __init__(self, digest: str):
        self.digest, self.run, self.at, self.known = digest, None, 0, None

    def witness(self, outer: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Siblings to the left and right on each level, and those of `outer` above."""
        if self.run is None:
            return outer
        if self.known is None:
            text, at = self.run.text, self.at * _DIGITS
            self.known = [(text[:at], text[at + _DIGITS :]), *self.run.parent.witness(outer)]
        return self.known


class Appender:
    """Streaming append to one block of a tree."""

    def __init__(self, levels: int):
        self.open = [Run() for _ in range(levels)]
        self.root: Node | None = None

    def append(self, digest: str) -> Node:
        node = Node(digest)
        self._place(node, 0)
        return node

    def _place(self, node: Node, level: int) -> None:
        if level == len(self.open):
            self.root = node
            return
        run = self.open[level]
        node.run, node.at = run, len(run.digests)
        run.digests.append(node.digest)
        if len(run.digests) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        run.text = "".join(run.digests)
        run.parent = Node(hashlib.sha256(run.text.encode()).hexdigest())
        self._place(run.parent, level + 1)

    def finish(self) -> Node:
        """Close the runs still open, from the leaves on; the last node is the root."""
        for level in range(len(self.open)):
            if self.open[level].digests:
                self._close(level)
        return self.root


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of one block after the other, from rows sorted by tree and block."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != key:
                yield key, rows
                rows = []
            key = (row["tree"], row["block"])
            rows.append(row)
    if rows:
        yield key, rows


def _appended(n: int, rows: list[dict]) -> tuple[Appender, list[Node]]:
    appender = Appender(min(BLOCK_LEVELS, levels_of(n)))
    nodes = [appender.append(r["digest"]) for r in rows]
    appender.finish()
    return appender, nodes


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each block, as a node of the next tree of blocks."""
    out = []

    def sent():
        columns = list(zip(*out))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "n", "position", "digest"]
        )

    for (tree, block), rows in _blocks(batches):
        n = rows[0]["n"]
        out.append((tree, -(-n // BLOCK), block, _appended(n, rows)[0].root.digest))
        if len(out) >= HELD_NODES:
            yield sent()
            out = []
    if out:
        yield sent()


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a block with its whole witness; the block's own comes first."""
    names = ["tree", "position", "digest", "subroot", "root", "carried"]
    held: list[tuple] = []

    def sent(carried_type):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), carried_type]
        arrays = [pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)]
        ends = [0]
        for h in held:
            ends.append(ends[-1] + len(h[-1]))
        sides = [pa.array([pair[i] for h in held for pair in h[-1]], pa.string()) for i in (0, 1)]
        pairs = pa.StructArray.from_arrays(sides, ["left", "right"])
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
        return pa.RecordBatch.from_arrays(arrays, [*names, "witness"])

    kind = []

    def noted():
        for batch in batches:
            kind[:] = [batch.schema.field("carried").type]
            yield batch

    for (tree, _), rows in _blocks(noted()):
        outer, rows = rows[0], rows[1:]
        above = [(w["left"], w["right"]) for w in outer["witness"]]
        _, nodes = _appended(rows[0]["n"], rows)
        for row, node in zip(rows, nodes):
            held.append(
                (tree, row["position"], row["digest"], outer["subroot"], outer["root"], row["carried"], node.witness(above))
            )
        if len(held) >= HELD_NODES:
            yield sent(kind[0])
            held.clear()
    if held:
        yield sent(kind[0])


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")


def _block() -> Column:
    return F.expr(f"position div {BLOCK}L").alias("block")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (with `tree`) and their `position` among the rows of their tree, from 0,
    and the `n` rows that it has.

    Rows are sorted by ranges of tree and order, so a tree with many rows is spread
    over many tasks; what is added up afterwards is one row per tree and task. Rows
    alike in all columns of `order` may take each other's place.
    """
    by = ["tree", *order, "_any"]
    sorted_rows = (
        rows.withColumn("_any", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_any")
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nth"))
    )
    numbered = written(sorted_rows, "manifest")
    parts = numbered.groupBy("tree", "_part").agg(F.min("_nth").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(
        F.col("tree").alias("_tree"), F.col("_part").alias("_of"), "_first",
        before.alias("_before"), F.sum("_rows").over(tree).alias("n"),
    )
    joined = numbered.join(parts, F.expr("tree <=> _tree AND _part = _of"))
    position = F.col("_nth") - F.col("_first") + F.col("_before")
    return joined.select(*rows.columns, position.alias("position"), "n")


def _roots(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes on the way up, one per BLOCK_LEVELS levels, and the last."""
    rounds = []
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        rounds.append(nodes)
        found = _in_blocks(nodes.select("tree", "n", _block(), "position", "digest"))
        nodes = written(found.mapInArrow(_up, "tree string, n long, position long, digest string"), "manifest")
    return rounds, nodes


def _witnessed(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The nodes of the first round with their witnesses.

    `outer` has those of the last nodes: tree, position, witness, subroot, root.
    """
    for nodes in reversed(rounds):
        if "carried" not in nodes.columns:
            nodes = nodes.withColumn("carried", F.lit(None).cast("int"))
        carried = nodes.schema["carried"].dataType.simpleString()
        inner = nodes.select(
            "tree", _block(), "position", "n", "digest", "carried",
            F.lit(None).cast(_WITNESS).alias("witness"),
            F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"),
        )
        first = outer.select(
            "tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"),
            F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
            F.lit(None).cast(carried).alias("carried"), "witness", "subroot", "root",
        )
        outer = _in_blocks(inner.unionByName(first)).mapInArrow(
            _down,
            "tree string, position long, digest string, subroot string, root string, "
            f"carried {carried}, witness {_WITNESS}",
        )
    return outer


def manifest(
    df: DataFrame, columns: tuple[str, ...] = LEAF_COLUMNS, group: str = "source", order: str = "doc_id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Each row of `df` as a leaf: `order`, `group`, the columns to `carry` along,
    `leaf`, `position` in its group, `subroot` of the group, `root`, and `witness`,
    the digests to the left and right of its path, level by level up to the root.

    A leaf is the digest of `columns`, null or empty ones included. Within a group
    (the null one is a group as well, and comes first) leaves ascend by `order`, null
    first, then by digest; rows that are alike have the same leaf, a place each, and
    may swap their places. Other columns of `df` are neither read nor returned. An
    empty table has no rows and no root.
    """
    quoted = lambda c: F.col(f"`{c}`")
    leaf = leaf_hash(*[quoted(c) for c in columns])
    carried = F.struct(quoted(order).alias("order"), quoted(group).alias("group"), F.struct(*[quoted(c) for c in carry], F.lit(0).alias("_")).alias("more"))
    # texts are read once, and digests travel from here on
    leaves = written(
        df.select(quoted(group).cast("string").alias("tree"), quoted(order).alias("_order"), leaf.alias("digest"), carried.alias("carried")),
        "manifest",
    )
    leaves = written(placed(leaves, ["_order", "digest"]).drop("_order"), "manifest")
    rounds, subroots = _roots(leaves)
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "digest")
    carried_group = groups.withColumn("carried", F.struct("_group")).withColumn("_present", F.col("_group").isNotNull())
    groups = written(placed(carried_group, ["_present", "_group"]).drop("_present", "_group"), "manifest")
    group_rounds, root = _roots(groups)
    top = root.select(
        "tree", F.lit(0).cast("long").alias("position"), F.array().cast(_WITNESS).alias("witness"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    if group_rounds:
        found = _witnessed(group_rounds, top)
    else:  # at most one group, whose subroot is the root
        found = groups.select("carried", "digest", F.array().cast(_WITNESS).alias("witness"), F.col("digest").alias("root"))
    outer = found.select(
        F.col("carried._group").alias("tree"), F.lit(0).cast("long").alias("position"), "witness",
        F.col("digest").alias("subroot"), "root",
    )
    if rounds:
        found = _witnessed(rounds, outer)
    else:  # one leaf in each group
        same = outer.select(F.col("tree").alias("_tree"), "witness", "subroot", "root")
        found = leaves.join(same, F.expr("tree <=> _tree"))
    return found.select(
        F.col("carried.order").alias(order), F.col("carried.group").alias(group),
        *[F.col(f"carried.more.`{c}`").alias(c) for c in carry],
        F.col("digest").alias("leaf"), "position", "subroot", "root", "witness",
    )
