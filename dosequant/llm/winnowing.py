"""Benchmark decontamination by winnowing.

A window of WINDOW words is marked by the first of the smallest hashes of GRAM words
in it, so any two texts that share WINDOW words share a mark there, at the same place
of the window. Consecutive windows mostly have the same one: a text keeps each marked
place once, as its fingerprint, with the words of the windows that it marks.
Fingerprints of documents are joined with those of the benchmark, and each hit is
extended to both sides as long as the words agree; what reaches a window is shared.
Benchmark items shorter than a window are one window of their own length.

Documents are read once and their texts stay where they are: of their fingerprints
only those travel whose mark is in the set of marks of the benchmark, which is held as
bits of fixed number; the more of them a benchmark fills, the more fingerprints
travel, and the join and the words decide in any case. Benchmark fingerprints alike in
all words are one row with all their items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dosequant.llm import words as W
from dosequant.llm.arrays import spread
from dosequant.llm.bitset import bits_of
from dosequant.llm.storage import written
from dosequant.operators.skew import join_apart

WINDOW, GRAM = 10, 5

#: at: first window; n: windows; off: marked place, from the first window on; words:
#: hashes of all words of the windows.
_FINGERPRINTS = "array<struct<at:int,n:int,off:int,size:int,mark:bigint,words:array<bigint>>>"


def _first_least(values: np.ndarray, size: int) -> np.ndarray:
    """Where the first of the least of `size` consecutive values is, from each place on."""
    out, length = np.arange(len(values)), 1
    while length < size:
        step = min(length, size - length)
        if step >= len(out):
            break
        left, right = out[:-step], out[step:]
        out = np.concatenate((np.where(values[right] < values[left], right, left), out[-step:]))
        length += step
    return out


def _selected(words: W.Words, hashes: np.ndarray, at: np.ndarray, size: int, gram: int):
    """Fingerprints of the windows of `size` words at the places `at`: first window,
    number of windows, marked place, mark."""
    gram = min(gram, size)
    grams = W.joined(hashes, gram)
    marked = _first_least(grams, size - gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (marked[1:] != marked[:-1]) | (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return at[first], n, marked[first], grams[marked[first]]


def _marked(batches: Iterator[pa.RecordBatch], pick, sizes: list[int] | None, window: int, gram: int):
    """Per text: number of words, and the fingerprints with pick(marks) only.

    With sizes None a text of fewer words than `window` is one window.
    """
    for batch, texts in W.chunks(batches, "text"):
        words = W.Words(texts, W.NOT_ALPHANUMERIC, lower=True)
        hashes = words.hashes()
        found = []
        for size in sizes if sizes is not None else range(1, window + 1):
            fits = words.fits(size)
            if sizes is None and size < window:
                fits &= words.count[words.text] == size
            at = np.flatnonzero(fits)
            if len(at):
                at, n, place, marks = _selected(words, hashes, at, size, gram)
                some = pick(marks)
                found.append((at[some], n[some], place[some], np.full(int(some.sum()), size), marks[some]))
        at, n, place, size, marks = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 5
        order = np.argsort(at, kind="stable")
        at, n, place, size, marks = at[order], n[order], place[order], size[order], marks[order]
        text = words.text[at]
        ends = np.concatenate(([0], np.searchsorted(text, np.arange(len(texts)), "right"))).astype(np.int32)
        lengths = n + size - 1
        covered = hashes[spread(at, lengths)].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(covered))
        numbers = (at - words.first[text], n, place - at, size)
        structs = pa.StructArray.from_arrays(
            [*[pa.array(x.astype(np.int32)) for x in numbers], pa.array(marks.view(np.int64)), lists],
            ["at", "n", "off", "size", "mark", "words"],
        )
        yield batch, words.count.astype(np.int64), pa.ListArray.from_arrays(pa.array(ends), structs)


def _with_fingerprints(df: DataFrame, pick, sizes: list[int] | None, window: int, gram: int) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        chosen = pick()
        for batch, n_words, found in _marked(batches, chosen, sizes, window, gram):
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), found], [*names, "n_words", "fingerprints"])

    schema = T.StructType(
        [*kept, T.StructField("n_words", T.LongType()), T.StructField("fingerprints", T._parse_datatype_string(_FINGERPRINTS))]
    )
    return df.select(*[f"`{n}`" for n in names], "text").mapInArrow(run, schema)


def _agreeing(left: list[int], right: list[int]) -> int:
    n = 0
    for a, b in zip(left, right):
        if a != b:
            break
        n += 1
    return n


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined fingerprints that share windows: row, first shared window, number of
    them, size, and the benchmark's fingerprint."""
    for batch in batches:
        out: list[tuple] = []
        for x in batch.to_pylist():
            a, b, i, j = x["words"], x["b_words"], x["off"], x["b_off"]
            before = _agreeing(a[:i][::-1], b[:j][::-1])
            after = _agreeing(a[i:], b[j:])
            # windows of which all words agree, counted from the marked place
            first = max(0, i - before)
            last = min(x["n"] - 1, i + after - x["size"])
            if first <= last:
                out.append((x["row"], x["at"] + first, last - first + 1, x["size"], x["fingerprint"]))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "at", "n", "size", "fingerprint"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of each row, in order, as maximal runs of words."""
    for batch in batches:
        out = []
        for hits in batch.column(1).to_pylist():
            spans: list[dict] = []
            for x in hits:
                end = x["at"] + x["n"] - 1 + x["size"]
                if spans and x["at"] <= spans[-1]["to"]:
                    spans[-1]["to"] = max(spans[-1]["to"], end)
                else:
                    spans.append({"from": x["at"], "to": end})
            out.append(spans)
        spans = pa.array(out, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["row", "spans"])


def shared_passages(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """One row per row of `documents` (columns `doc_id`, `text`) with `doc_id`,
    `n_words`, `spans` (maximal runs [from, to) of shared words), `n_hit` (words in
    them) and `items` (ids of the items shared, sorted as text).

    Null texts have no words, items without a word share nothing, and items without
    an id take part but are not listed. Repeated rows are judged one by one; other
    columns, whatever their names, are not read. A text of any length is one row, and
    its hits are those of the benchmark only.
    """
    everything = lambda: lambda marks: np.ones(len(marks), bool)
    marked = _with_fingerprints(benchmark.select(F.col(item_id).alias("item_id"), "text"), everything, None, window, gram)
    alike = (
        marked.select(F.col("item_id").cast("string").alias("item"), F.explode("fingerprints").alias("f"))
        .groupBy("f.size", "f.mark", "f.off", "f.words")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("fingerprint", F.monotonically_increasing_id())
    )
    alike = written(alike, "benchmark-fingerprints")
    sizes = sorted(r[0] for r in alike.select("size").distinct().collect())

    def marks_of(batches):
        for batch in batches:
            yield batch.column(0).to_numpy().view(np.uint64)

    get = bits_of(alike, marks_of, ["mark"], alike.count())
    pick = lambda: get().has
    texts = documents.select(F.col(doc_id).alias("doc_id"), "text")
    candidates = written(
        _with_fingerprints(texts, pick, sizes, window, gram).withColumn("row", F.monotonically_increasing_id()),
        "document-fingerprints",
    )
    key = F.struct("size", "mark").alias("key")
    ours = candidates.where(F.size("fingerprints") > 0).select("row", F.explode("fingerprints").alias("f")).select("row", "f.*")
    theirs = alike.select(key, F.col("off").alias("b_off"), F.col("words").alias("b_words"), "fingerprint")
    joined = join_apart(ours.select("row", "at", "n", "off", "size", "words", key), theirs, "key", "marks").drop("key")
    hits = joined.mapInArrow(_extended, "row bigint, at int, n int, size int, fingerprint bigint")
    hits = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("at", "n", "size"))).alias("hits"), F.collect_set("fingerprint").alias("found")
    )
    hits = written(hits, "hits")
    of_items = alike.select(F.col("fingerprint").alias("one"), "items")
    items = (
        join_apart(hits.select("row", F.explode("found").alias("one")), of_items, "one", "items")
        .select("row", F.explode("items").alias("item"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    spans = hits.select("row", "hits").mapInArrow(_merged, "row bigint, spans array<struct<from:int,to:int>>")
    none = F.expr("CAST(array() AS array<struct<from:int,to:int>>)")
    return (
        candidates.select("row", "doc_id", "n_words")
        .join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            F.col("doc_id").alias(doc_id),
            "n_words",
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        )
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"]))
    )
