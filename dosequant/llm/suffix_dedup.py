"""Suffix-array dedup: byte strings that occur twice are removed, by bucket refinement.

Starts of SIZE-byte strings are put in buckets and the buckets are refined until a
bucket holds equal strings only, as in sorting suffixes by bucket pointers. The
identifier of a place for 2k bytes is made of those of k bytes at the place and k
bytes later, so identifiers are reused level by level: 1, 2, 4, ... 128 bytes, and
the last refinement sorts on those of 128 bytes at an offset of SIZE - 128. Order
between buckets does not matter here, so identifiers are 64-bit hashes.

A start's first bucket is the least identifier of QGRAM bytes within its string.
Neighbouring starts mostly share it; they form a segment and travel together with
the bytes they cover. Only buckets that a count-min sketch takes for repeated
travel. A batch first refines its own: starts that are equal there are decided on,
and of each string one start goes on, so a group of copies shrinks to one row per
batch.

A frequent bucket would bring together what only shares a short line. Its starts are
refined at once to the identifiers of their whole strings: those that a second sketch
takes for single are dropped, and what is left of a segment, a fragment, travels as
one row with these identifiers, to the bucket of all of them. Equal fragments are
decided on as a whole, and one fragment of each kind goes on start by start, to the
buckets of single strings, where fragments that differ may still share some.
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
from dosequant.llm.sketch import estimate
from dosequant.operators.skew import join_apart

SIZE, QGRAM = 200, 32
#: Bytes of segments and of single starts that a batch holds before it sends them.
HELD_BYTES = 4 << 20
#: Starts that a fragment has at most; with no more than SIZE, equal first and last
#: strings and numbers make fragments equal.
LONGEST = 128
#: Kinds of rows: a segment with its bytes, a run that is decided on, a fragment with
#: the identifiers of its strings.
_SEGMENT, _DECIDED, _FRAGMENT = range(3)
_ROUTED = "route bigint, kind int, row bigint, at int, n int, content binary"
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE_IDS = W.scatter(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def identifiers(data: np.ndarray, length: int, ids: np.ndarray | None = None, done: int = 1) -> np.ndarray:
    """Bucket identifiers of `length` (a power of two) bytes from each place on.

    `ids` are those for `done` bytes, if at hand. The last places, where the bytes
    run out, are left out.
    """
    if ids is None:
        ids = _BYTE_IDS[data]
    while done < length:
        if len(ids) <= done:
            return ids[:0]
        ids = ids[:-done] * _RADIX + ids[done:]
        ids ^= ids >> np.uint64(32)
        done *= 2
    return ids


def refine(buckets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the members of each bucket on their identifiers and number the parts.

    Returns the new bucket of each member and how many members that has.
    """
    key = W.scatter(buckets * _RADIX + ids)
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    numbers = np.cumsum(new) - 1
    sizes = np.bincount(numbers)
    out, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    out[order], many[order] = numbers, sizes[numbers]
    return out.astype(np.uint64), many


def equal_strings(buckets: np.ndarray, data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Final bucket of each start and how many starts have an equal string.

    Starts alone in their bucket after a refinement take no part in the next one.
    """
    length = 1 << (size.bit_length() - 1)
    ids = identifiers(data, length)
    final, many = np.zeros(len(starts), np.uint64), np.ones(len(starts), np.int64)
    if not len(starts):
        return final, many
    bucket, members = refine(buckets, ids[starts])
    left = np.flatnonzero(members > 1)
    final[:] = bucket + np.uint64(len(starts))
    if size > length and len(left):
        last, members = refine(bucket[left], ids[starts[left] + size - length])
        final[left] = last
        many[left] = members
    else:
        many = members
    return final, many


def whole_strings(
    data: np.ndarray, starts: np.ndarray, size: int, ids: np.ndarray | None = None, done: int = 1
) -> np.ndarray:
    """Identifiers of all `size` bytes from each start on."""
    length = 1 << (size.bit_length() - 1)
    ids = identifiers(data, length, ids, done)
    return W.scatter(ids[starts] * _RADIX + ids[starts + size - length])


class Segments:
    """Segments of the texts of one chunk: text, first start, number of starts, bucket.

    `fragments` has what is left of frequent segments: text, first start, number of
    starts, identifier of the whole; and `strings` the identifiers of their strings.
    """

    def __init__(self, texts: list[bytes | None], size: int, qgram: int):
        sizes = np.fromiter((len(x) if x else 0 for x in texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(x for x in texts if x), np.uint8)
        self.size, self.qgram = size, qgram
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        self.ids = identifiers(self.data, qgram)
        span = size - qgram + 1
        starts = np.maximum(sizes - size + 1, 0)
        self.at = spread(self.text_at[:-1][starts > 0], starts[starts > 0])
        self.text = np.repeat(np.arange(len(texts)), starts)
        keys = W.smallest(self.ids, span)[self.at] if len(self.at) else np.empty(0, np.uint64)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        self.first, self.n = self.at[first], np.diff(np.append(first, len(keys)))
        self.key, self.owner = keys[first], self.text[first]
        self.each = keys
        self.fragments, self.strings = (self.owner[:0], self.first[:0], self.n[:0], self.key[:0]), self.key[:0]

    def occurrences(self) -> np.ndarray:
        """Buckets, one entry for each place whose sequence is the least of a string.

        A segment has several such places if its bytes repeat within it.
        """
        span = self.size - self.qgram + 1
        least = np.zeros(len(self.ids), np.uint64)
        least[self.at] = self.each
        largest = ~W.smallest(~least[::-1], span)[::-1]
        return self.ids[(largest == self.ids) & (largest > 0)]

    def frequent(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, place and string of the starts of the segments that are `often`."""
        starts = spread(self.first[often], self.n[often])
        if not len(starts):
            return starts, starts, self.key[:0]
        strings = whole_strings(self.data, starts, self.size, self.ids, self.qgram)
        return np.repeat(np.flatnonzero(often), self.n[often]), starts, strings

    def choose(self, estimate, strings) -> None:
        """Keep repeated buckets; take frequent ones apart into fragments of starts
        whose strings are repeated."""
        some, often = estimate.repeated(self.key), estimate.frequent(self.key)
        if often.any():
            segment, starts, ids = self.frequent(often)
            twice = strings.repeated(ids)
            segment, starts, self.strings = segment[twice], starts[twice], ids[twice]
            new = np.ones(len(starts), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (starts[1:] != starts[:-1] + 1)
            run_start = starts[np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))]
            new |= (starts - run_start) % min(LONGEST, self.size) == 0
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(starts)))
            whole = self.strings[first] * _RADIX + self.strings[first + n - 1]
            whole = W.scatter(W.scatter(whole) + n.astype(np.uint64))
            self.fragments = (self.owner[segment[first]], starts[first], n, whole)
            some &= ~often
        self.first, self.n, self.key, self.owner = self.first[some], self.n[some], self.key[some], self.owner[some]

    def content(self) -> np.ndarray:
        return self.data[spread(self.first, self.n + self.size - 1)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _routed(kind, route, row, at, n, data, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(route.view(np.int64)), pa.array(np.full(len(route), kind, np.int32)), pa.array(row),
         pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), _binary(data, sizes)],
        ["route", "kind", "row", "at", "n", "content"],
    )


def _candidates(size: int, qgram: int, get, get_strings):
    """Segments and fragments to be refined together, and runs decided on already."""

    def decided(rows, first, count) -> pa.RecordBatch:
        apart = W.scatter(rows.view(np.uint64) + first.astype(np.uint64))
        return _routed(_DECIDED, apart, rows, first, count, apart[:0].view(np.uint8), np.zeros(len(rows), np.int64))

    def send_fragments(parts) -> Iterator[pa.RecordBatch]:
        row, at, n, whole, strings = (np.concatenate(x) for x in zip(*parts))
        if not len(whole):
            return
        _, leading, which, many = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        content = strings[spread((np.cumsum(n) - n)[leading], n[leading])].view(np.uint8)
        yield _routed(_FRAGMENT, whole[leading], row[leading], at[leading], n[leading], content, 8 * n[leading])
        equal = many[which] > 1
        yield decided(row[equal], at[equal], n[equal])

    def send(parts) -> Iterator[pa.RecordBatch]:
        key, row, at, n = (np.concatenate(x) for x in list(zip(*parts))[:4])
        if not len(key):
            return
        data = np.concatenate([x[4] for x in parts])
        sizes = n + size - 1
        offset = np.cumsum(sizes) - sizes
        starts, segment = spread(offset, n), np.repeat(np.arange(len(key)), n)
        final, many = equal_strings(key[segment], data, starts, size)
        order = np.argsort(final, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = final[order][1:] != final[order][:-1]
        leading = np.zeros(len(order), bool)
        leading[order[new]] = True
        going = np.bincount(segment, leading, len(key)) > 0
        yield _routed(
            _SEGMENT, key[going], row[going], at[going], n[going], data[np.repeat(going, sizes)], sizes[going]
        )
        yield decided(*runs(many > 1, row[segment], spread(at, n)))

    def run(batches):
        parts, fragments, held = [], [], 0
        for batch, texts in W.chunks(batches, "text"):
            rows = batch.column(batch.schema.get_field_index("row")).to_numpy()
            found = Segments(texts, size, qgram)
            found.choose(get(), get_strings())
            at = found.first - found.text_at[found.owner]
            content = found.content()
            parts.append((found.key, rows[found.owner], at, found.n, content))
            owner, start, n, whole = found.fragments
            fragments.append((rows[owner], start - found.text_at[owner], n, whole, found.strings))
            held += len(content) + found.strings.nbytes
            if held >= HELD_BYTES:
                yield from send(parts)
                yield from send_fragments(fragments)
                parts, fragments, held = [], [], 0
        if parts:
            yield from send(parts)
            yield from send_fragments(fragments)

    return run


_RESOLVED = "row bigint, at int, n int, string bigint"


def _resolved(rows, at, n, strings=None) -> pa.RecordBatch:
    string = pa.nulls(len(rows), pa.int64()) if strings is None else pa.array(strings.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), string], ["row", "at", "n", "string"]
    )


def _segments_of(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all entries, and the size of each."""
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1]
    data = np.frombuffer(content.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets).astype(np.int64)


def _resolve(size: int):
    """Runs of equal strings, from segments sorted by route, and from fragments; of
    each kind of fragment, one start of each string with the string.

    Of the last route of a batch one start of each string is kept for the next batch,
    and the last fragment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        last_route, kept = None, (none, none, np.empty(0, np.uint8))  # row, at, bytes
        last_fragment = (none, none, none, none)  # route, row, at, n
        for batch in batches:
            route, kind, row, at, n = (batch.column(i).to_numpy() for i in range(5))
            at, n = at.astype(np.int64), n.astype(np.int64)
            data, sizes = _segments_of(batch.column(5))
            kind_of_byte = np.repeat(kind, sizes)

            whole = kind == _FRAGMENT
            after = len(last_fragment[0])
            routes, rows, places, counts = (np.concatenate(x) for x in zip(last_fragment, (route[whole], row[whole], at[whole], n[whole])))
            equal = routes[1:] == routes[:-1]
            twice, first = np.zeros(len(routes), bool), np.ones(len(routes), bool)
            twice[1:] |= equal
            twice[:-1] |= equal
            first[1:] = ~equal
            yield _resolved(rows[twice], places[twice], counts[twice])
            last_fragment = (routes[-1:], rows[-1:], places[-1:], counts[-1:])
            first = np.flatnonzero(first[after:])  # those seen for the first time here
            strings = np.frombuffer(data[kind_of_byte == _FRAGMENT].tobytes(), np.uint64)
            many = n[whole]
            strings = strings[spread((np.cumsum(many) - many)[first], many[first])]
            owner, place = np.repeat(row[whole][first], many[first]), spread(at[whole][first], many[first])
            _, leading, which, times = np.unique(strings, return_index=True, return_inverse=True, return_counts=True)
            yield _resolved(owner[leading], place[leading], np.ones(len(leading), np.int64), strings[leading])
            yield _resolved(*runs(times[which] > 1, owner, place))

            if len(route) and route[0] != last_route:
                kept = (none, none, np.empty(0, np.uint8))
            some = kind == _SEGMENT
            sizes = np.where(some, sizes, 0)
            data = data[kind_of_byte == _SEGMENT]
            n_kept = len(kept[0])
            offset = np.concatenate((np.arange(n_kept) * size, len(kept[2]) + (np.cumsum(sizes) - sizes)[some]))
            counts = np.concatenate((np.ones(n_kept, np.int64), n[some]))
            firsts = np.concatenate((kept[1], at[some]))
            owners = np.concatenate((kept[0], row[some]))
            routes = np.concatenate((np.full(n_kept, last_route or 0, np.int64), route[some]))
            data = np.concatenate((kept[2], data))
            starts, segment = spread(offset, counts), np.repeat(np.arange(len(counts)), counts)
            place = spread(firsts, counts)
            final, many = equal_strings(routes.view(np.uint64)[segment], data, starts, size)
            yield _resolved(*runs(many > 1, owners[segment], place))
            decided = kind == _DECIDED
            yield _resolved(row[decided], at[decided], n[decided])
            if len(route):
                last_route = route[-1]
                ours = np.flatnonzero(routes[segment] == last_route)
                _, index = np.unique(final[ours], return_index=True)
                chosen = ours[index]
                kept = (
                    owners[segment[chosen]], place[chosen],
                    data[spread(starts[chosen], np.full(len(chosen), size, np.int64))],
                )

    return run


def _same_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs decided on, and starts whose string another one has, from rows sorted by
    string. The last start of a batch is kept for the next one."""
    last = tuple(np.empty(0, np.int64) for _ in range(3))  # string, row, at
    for batch in batches:
        row, at, n = (batch.column(i).to_numpy() for i in range(3))
        alone = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        string = batch.column(3).drop_null().to_numpy()
        strings, rows, places = (np.concatenate(x) for x in zip(last, (string, row[alone], at[alone])))
        equal = strings[1:] == strings[:-1]
        twice = np.zeros(len(strings), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        last = (strings[-1:], rows[-1:], places[-1:])
        ones = np.ones(int(twice.sum()), np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in ((row[~alone], rows[twice]), (at[~alone], places[twice].astype(np.int32)), (n[~alone], ones))],
            ["row", "at", "n"],
        )


def equal_byte_runs(df: DataFrame, size: int = SIZE, qgram: int = QGRAM) -> DataFrame:
    """Runs (`row`, `at`, `n`) of starts whose `size` bytes also start elsewhere.

    `df` has `row` (long) and `text`.
    """

    def keys(batches):
        for _, texts in W.chunks(batches, "text"):
            yield Segments(texts, size, qgram).occurrences()

    get = estimate(df.select("text"), keys)

    def strings(batches):
        for _, texts in W.chunks(batches, "text"):
            found = Segments(texts, size, qgram)
            yield found.frequent(get().frequent(found.key))[2]

    get_strings = estimate(df.select("text"), strings)
    found = (
        df.select("row", "text")
        .mapInArrow(_candidates(size, qgram, get, get_strings), _ROUTED)
        .repartition("route")
        .sortWithinPartitions("route")
        .mapInArrow(_resolve(size), _RESOLVED)
    )
    to = F.coalesce("string", F.xxhash64("row", "at"))
    return (
        found.withColumn("to", to)
        .repartition("to")
        .sortWithinPartitions("to", "string")
        .select("row", "at", "n", "string")
        .mapInArrow(_same_strings, "row bigint, at int, n int")
    )


def _cut(size: int, as_text: bool):
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            total, kept, spans = [], [], []
            for text, found in zip(column("text").cast(pa.binary()).to_pylist(), column("_runs").to_pylist()):
                text = text or b""
                removed: list[list[int]] = []
                for a, b in sorted((x["at"], x["at"] + x["n"] + size - 1) for x in found or ()):
                    if removed and a <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], b)
                    else:
                        removed.append([a, b])
                edges = [0, *(x for r in removed for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                total.append(len(text))
                spans.append([{"from": a, "to": b} for a, b in removed])
            rest = pa.array([x.decode("utf-8", "ignore") for x in kept] if as_text else kept, pa.string() if as_text else pa.binary())
            columns = [column("_input"), pa.array(total, pa.int64()), pa.array(spans, span), rest]
            yield pa.RecordBatch.from_arrays(columns, ["_input", "n_bytes", "removed", "kept_text" if as_text else "kept_bytes"])

    return run


def remove_repeated_bytes(
    df: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SIZE, qgram: int = QGRAM,
    as_text: bool = False,
) -> DataFrame:
    """Each row of `df` with `n_bytes`, `removed` (maximal runs [from, to) of bytes)
    and `kept_bytes` (the other bytes, in order), without `text`. With `as_text`
    the latter is `kept_text`, without characters of which only a part is left.

    A byte goes if a string of `size` bytes that covers it also starts anywhere else,
    in the same row too; all occurrences go. Null and empty texts have no bytes.
    `key` names the columns that tell rows with equal texts apart; rows equal in
    those and the text, repeated rows that is, have the same outcome.
    """
    columns = [c for c in df.columns if c != text]
    rows = packed(df, text, row=row_id(df, [*key, text]))
    found = equal_byte_runs(rows.select("row", "text"), size, qgram)
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("_runs"))
    joined = join_apart(rows, found, "row", "cut", "left").select("_input", "text", "_runs")
    rest = T.StructField("kept_text", T.StringType()) if as_text else T.StructField("kept_bytes", T.BinaryType())
    schema = T.StructType(
        [rows.schema["_input"], T.StructField("n_bytes", T.LongType()),
         T.StructField("removed", T._parse_datatype_string("array<struct<from:int,to:int>>")), rest]
    )
    cut = joined.mapInArrow(_cut(size, as_text), schema)
    return unpacked(cut, columns, "n_bytes", "removed", rest.name)
