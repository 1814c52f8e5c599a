"""Substring dedup: word windows that started in an earlier document are removed.

First pass: every window is counted, in a count-min sketch per partition, under the
smallest hash among its GRAM-word sequences. Neighbouring windows mostly share that
sequence, so few keys are counted; the merged estimate is at least the number of
times a window occurs, so no repeated window is missed. Second pass: only windows
estimated repeated are grouped, by 64-bit hashes of all their words.

Windows with the same sequence form a segment and travel together. Before they do,
a batch keeps those of its earliest document only and decides on the others itself,
so a group of copies shrinks to one row per batch. Windows of a sequence that occurs
often travel one by one, so that a frequent phrase is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dosequant.llm import words as W
from dosequant.llm.arrays import runs, spread
from dosequant.llm.columns import packed, unpacked
from dosequant.llm.rows import row_id
from dosequant.llm.sketch import Estimate, estimate
from dosequant.operators.skew import join_apart

WINDOW, GRAM = 13, 5
_LAST = np.iinfo(np.int64).max
_ROUTED = "route bigint, doc bigint, row bigint, at int, n int, windows array<bigint>"


def _segments(texts: list[bytes | None], window: int, gram: int):
    """Window hashes by word, and the segments: first word, windows, key, text."""
    words = W.Words(texts, W.WHITE_SPACE)
    hashes = words.hashes()
    fits = words.fits(window)
    keys = W.smallest(W.joined(hashes, gram), window - gram + 1)
    windows = W.joined(W.scatter(hashes ^ np.uint64(0x5DEECE66D)), window)
    at = np.flatnonzero(fits)
    new = np.ones(len(at), bool)
    new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])
    first = np.flatnonzero(new)
    return words, windows, at[first], np.diff(np.append(first, len(at))), keys[at[first]]


def first_owner(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window the least document it occurs in."""
    order = np.lexsort((docs, windows))
    new = np.ones(len(order), bool)
    new[1:] = windows[order][1:] != windows[order][:-1]
    least = docs[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty_like(docs)
    out[order] = least
    return out


def _routed(route, doc, row, at, n, windows, sizes) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(route), pa.array(doc), pa.array(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(windows.view(np.int64)))],
        ["route", "doc", "row", "at", "n", "windows"],
    )


def _candidates(window: int, gram: int, get):
    """Rows to be grouped; rows without windows are runs already decided on."""

    def send(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, row, at, n, windows = (np.concatenate(x) for x in zip(*parts))
        if not len(key):
            return
        segment = np.repeat(np.arange(len(key)), n)
        owned = first_owner(windows, doc[segment]) == doc[segment]
        place = spread(at, n)
        decided = runs(~owned, row[segment], place)
        left = np.bincount(segment, owned, len(key)) > 0
        estimate: Estimate = get()
        often = estimate.frequent(key)
        # one row per segment, or per window of a frequent sequence
        whole, single = left & ~often, (left & often)[segment] & owned
        inside = whole[segment]
        yield _routed(
            key[whole].view(np.int64), doc[whole], row[whole], at[whole], n[whole], windows[inside], n[whole]
        )
        ones = np.ones(int(single.sum()), np.int64)
        yield _routed(
            windows[single].view(np.int64), doc[segment][single], row[segment][single], place[single], ones,
            windows[single], ones,
        )
        rows, starts, sizes = decided
        yield _routed(
            W.scatter(rows.view(np.uint64) + starts.astype(np.uint64)).view(np.int64), np.zeros(len(rows), np.int64),
            rows, starts, sizes, np.empty(0, np.uint64), np.zeros(len(rows), np.int64),
        )

    def run(batches):
        parts, size = [], 0
        for batch, texts in W.chunks(batches, "text"):
            docs, rows = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "row"))
            words, windows, at, n, key = _segments(texts, window, gram)
            some = get().repeated(key)
            at, n, key = at[some], n[some], key[some]
            text = words.text[at]
            found = windows[spread(at, n)]
            parts.append((key, docs[text], rows[text], at - words.first[text], n, found))
            size += len(found)
            if size >= 1 << 20:
                yield from send(parts)
                parts, size = [], 0
        if parts:
            yield from send(parts)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows to remove, from rows sorted by route and document.

    Documents of a route come in order, so what is seen of it is enough to decide;
    of the last route of a batch each window and its first document are kept.
    """
    seen_windows, seen_docs = np.empty(0, np.uint64), np.empty(0, np.int64)
    seen_route = None
    for batch in batches:
        route, doc, row, at, n = (batch.column(i).to_numpy() for i in range(5))
        lists = batch.column(5)
        sizes = np.diff(lists.offsets.to_numpy())
        windows = lists.flatten().to_numpy().view(np.uint64)
        at, n = at.astype(np.int64), n.astype(np.int64)
        decided = sizes == 0
        segment = np.repeat(np.arange(len(route)), sizes)
        if len(route) and route[0] != seen_route:
            seen_windows, seen_docs = seen_windows[:0], seen_docs[:0]
        docs = doc[segment]
        owner = first_owner(np.concatenate((seen_windows, windows)), np.concatenate((seen_docs, docs)))
        later = owner[len(seen_windows) :] < docs
        rows, starts, counts = runs(later, row[segment], spread(at, sizes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((rows, row[decided]))),
             pa.array(np.concatenate((starts, at[decided])).astype(np.int32)),
             pa.array(np.concatenate((counts, n[decided])).astype(np.int32))],
            ["row", "at", "n"],
        )
        if len(route):
            last = route[segment] == route[-1]
            if route[0] != route[-1]:
                seen_windows, seen_docs = seen_windows[:0], seen_docs[:0]
            seen_route = route[-1]
            kept_windows = np.concatenate((seen_windows, windows[last]))
            kept_docs = np.concatenate((seen_docs, docs[last]))
            order = np.lexsort((kept_docs, kept_windows))
            new = np.ones(len(order), bool)
            new[1:] = kept_windows[order][1:] != kept_windows[order][:-1]
            seen_windows, seen_docs = kept_windows[order][new], kept_docs[order][new]


def repeated_windows(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows (`row`, `at`, `n`) that also start in a row with less `doc`.

    `df` has `doc` (long, not null), `row` (long) and `text`.
    """

    def keys(batches):
        for _, texts in W.chunks(batches, "text"):
            yield _segments(texts, window, gram)[4]

    get = estimate(df.select("text"), keys)
    return (
        df.select("doc", "row", "text")
        .mapInArrow(_candidates(window, gram, get), _ROUTED)
        .repartition("route")
        .sortWithinPartitions("route", "doc")
        .mapInArrow(_resolve, "row bigint, at int, n int")
    )


def _cut(window: int):
    def run(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            total, gone, kept, spans = [], [], [], []
            for text, found in zip(column("text").cast(pa.binary()).to_pylist(), column("_runs").to_pylist()):
                words = text.split() if text else []
                removed: list[list[int]] = []
                for x in sorted((x["at"], x["at"] + x["n"] + window - 1) for x in found or ()):
                    if removed and x[0] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], x[1])
                    else:
                        removed.append(list(x))
                at, rest = 0, []
                for a, b in removed:
                    rest += words[at:a]
                    at = b
                rest += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
                spans.append([{"from": a, "to": b} for a, b in removed])
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            columns = [column("_input"), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            columns += [pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_input", "n_words", "n_removed", "removed", "kept_text"])

    return run


def remove_repeated_windows(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Each row of `df` with `n_words`, `n_removed`, `removed` (runs [from, to) of
    words) and `kept_text` (the other words, joined by one space), without `text`.

    A word goes if a window of `window` words that covers it also starts in a row
    with a smaller id. Rows without an id count as later than all others; rows with
    the same id, repeated rows among them, leave each other alone. Null and empty
    texts have no words.
    """
    columns = [c for c in df.columns if c != text]
    row = row_id(df, [doc_id, text])
    doc = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST))
    rows = packed(df, text, row=row, doc=doc)
    found = repeated_windows(rows.select("doc", "row", "text"), window, gram)
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("_runs"))
    joined = join_apart(rows, found, "row", "cut", "left").select("_input", "text", "_runs")
    schema = T.StructType(
        [rows.schema["_input"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
         T.StructField("removed", T._parse_datatype_string("array<struct<from:int,to:int>>")),
         T.StructField("kept_text", T.StringType())]
    )
    cut = joined.mapInArrow(_cut(window), schema)
    return unpacked(cut, columns, "n_words", "n_removed", "removed", "kept_text")
