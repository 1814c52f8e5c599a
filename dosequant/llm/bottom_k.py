"""Document fingerprints: the least K hashes of a document's word shingles.

The K least of the distinct shingle hashes are a uniform sample of the document's
shingles, and the same for whatever parts it is put together from, so fingerprints
merge: the K least of several together are the fingerprint of the whole. The K least
of two documents together, of which some lie in both, estimate their resemblance and
containment, and how dense the least ones lie estimates how many shingles there are.

Hashes have 48 bits. A fingerprint is text: each hash in ascending order as eight
characters of base64. With up to K shingles it has all of them, and what it says is
exact but for equal hashes of different shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dosequant.llm import words as W

K, SHINGLE = 128, 5
_BITS = 48
#: Ranges of ids that documents are dealt to, at most, and bytes of text held at once.
MAX_RANGES = 1 << 14
HELD_BYTES = 1 << 20


def shingle_hashes(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the text each is of.

    Words are what lies between white space. A text of fewer words than a shingle has
    is one shingle, one without words has none.
    """
    words = W.Words(texts, W.WHITE_SPACE)
    hashes = words.hashes()
    at = np.flatnonzero(words.fits(shingle))
    found, owner = [W.joined(hashes, shingle)[at]], [words.text[at]]
    for n in range(1, shingle):
        short = np.flatnonzero(words.count == n)
        found.append(W.joined(hashes, n)[words.first[short]] if len(short) else np.empty(0, np.uint64))
        owner.append(short)
    return W.scatter(np.concatenate(found)) >> np.uint64(64 - _BITS), np.concatenate(owner)


def least_hashes(texts: list[bytes | None], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The `k` least distinct shingle hashes of each text, ascending."""
    hashes, owner = shingle_hashes(texts, shingle)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [hashes[a : min(b, a + k)] for a, b in zip(edges[:-1], edges[1:])]


def to_text(hashes: np.ndarray) -> str:
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return base64.b64encode(raw).decode()


def from_text(fingerprint: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, 6)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, 2:] = raw
    return whole.view(">u8").reshape(-1).astype(np.uint64)


def merged(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The least hashes of a whole, from those of its parts."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))[:k]


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """How many distinct shingles there are; exact with fewer than `k`."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) * 2.0**_BITS / (float(a[k - 1]) + 1)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Of the least of both: how many, how many are in `a`, how many in both."""
    least = merged((a, b), k)
    in_a = np.isin(least, a, assume_unique=True)
    return len(least), int(in_a.sum()), int((in_a & np.isin(least, b, assume_unique=True)).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of shingles that are in both; 1 for two documents without any."""
    n, _, both = _shared(a, b, k)
    return both / n if n else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of `a` that are in `b`; 1 if `a` has none, and 0 if none
    of them is among the least of both."""
    _, in_a, both = _shared(a, b, k)
    return both / in_a if in_a else float(not len(a))


def fingerprints(df: DataFrame, text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each row of `df` with its `fingerprint` and `n_shingles`, the estimated number
    of distinct shingles, instead of `text`.

    Null and empty texts, and those of white space, have an empty fingerprint. Columns
    named like the new ones give way to them; equal texts, repeated rows among them,
    have equal fingerprints.
    """
    others = [c for c in df.columns if c not in (text, "fingerprint", "n_shingles")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("_input"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch, texts in W.chunks(batches, "text"):
            found = least_hashes(texts, k, shingle)
            columns = [
                batch.column(batch.schema.get_field_index("_input")), pa.array([to_text(x) for x in found], pa.string()),
                pa.array([distinct_shingles(x, k) for x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_input", "fingerprint", "n_shingles"])

    kept = rows.schema["_input"].dataType.simpleString()
    made = rows.mapInArrow(run, f"_input {kept}, fingerprint string, n_shingles double")
    return made.select(*[F.col(f"_input.`{c}`").alias(c) for c in others], "fingerprint", "n_shingles")


def compared(df: DataFrame, left: str, right: str, k: int = K) -> DataFrame:
    """`df` with `resemblance` of its fingerprint columns `left` and `right`, and
    `containment` of left in right. Null counts as an empty fingerprint."""
    plain = df.drop("resemblance", "containment")
    rows = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("_input"), F.col(f"`{left}`").alias("a"), F.col(f"`{right}`").alias("b"))

    def run(batches):
        for batch in batches:
            pairs = [(from_text(a), from_text(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([f(a, b, k) for a, b in pairs], pa.float64()) for f in (resemblance, containment)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_input", "resemblance", "containment"])

    kept = rows.schema["_input"].dataType.simpleString()
    return rows.mapInArrow(run, f"_input {kept}, resemblance double, containment double").select("_input.*", "resemblance", "containment")


def merged_fingerprints(df: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint of all documents that share a value of `by`, null among them:
    `by`, `fingerprint`, `n_shingles`.

    Each batch merges its own first. What is left travels hash by hash, and each task
    passes on the least `k` of a value only, so a value with many rows loads no task.
    """
    rows = df.select(F.col(f"`{by}`").alias("_by"), F.col(f"`{fingerprint}`").alias("_f"))
    kind = rows.schema["_by"].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            groups: dict = {}
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups.setdefault(value, []).append(from_text(text))
            for value, parts in groups.items():
                found = merged(parts, k).astype(np.int64)
                found = found if len(found) else np.full(1, -1)  # the value is there, without shingles
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value] * len(found), batch.schema.field(0).type), pa.array(found)], ["_by", "_hash"]
                )

    def joined(batches):
        for batch in batches:
            parts = [np.array([h for h in x if h >= 0], np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(x) for x in parts], pa.string()),
                 pa.array([distinct_shingles(x, k) for x in parts], pa.float64())],
                ["_by", "fingerprint", "n_shingles"],
            )

    hashes = rows.mapInArrow(spread, f"_by {kind}, _hash long").distinct()
    # one more than k, as the mark of a value without shingles sorts first
    first = Window.partitionBy("_by").orderBy("_hash")
    least = hashes.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k + 1)
    lists = least.groupBy("_by").agg(F.array_sort(F.collect_list("_hash")).alias("_hashes"))
    lists = lists.withColumn("_hashes", F.slice(F.filter("_hashes", lambda h: h >= 0), 1, k))
    return lists.mapInArrow(joined, f"_by {kind}, fingerprint string, n_shingles double").select(
        F.col("_by").alias(by), "fingerprint", "n_shingles"
    )


# Edits: each document against itself with its end replaced, and against the next one.

_LEAST_ID = -(1 << 63)


def _order(doc_id: str, text: str) -> list[Column]:
    """A key that ascends as ids descend, null last, then by the hash of the text."""
    place = F.bitwise_not(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LEAST_ID)))
    return [place.alias("place"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("hash")]


def _ranges(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Keys (place, hash) at which ranges of about equal numbers of rows begin.

    A place with the rows of several ranges is cut by hash, evenly.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.percentile_approx("place", F.array(*[F.lit(s) for s in shares]), F.lit(10 * ranges))).first()[0] if shares else None
    places: dict[int, int] = {}
    for place in found or []:
        places[place] = places.get(place, 0) + 1
    return [
        (place, -(1 << 63) + ((i << 64) // times))
        for place, times in sorted(places.items())
        for i in range(times)
    ]


def _range_of(place: np.ndarray, hashes: np.ndarray, starts: list[tuple[int, int]]) -> np.ndarray:
    """The range of each key: how many begin at or before it."""
    if not starts:
        return np.zeros(len(place), np.int64)
    places, cuts = (np.array(x, np.int64) for x in zip(*starts))
    first = np.searchsorted(places, place, "left")
    last = np.searchsorted(places, place, "right")
    out = first.copy()
    for at in np.flatnonzero(first < last):  # places that begin a range
        out[at] = first[at] + np.searchsorted(cuts[first[at] : last[at]], hashes[at], "right")
    return out


def _heads(keys: DataFrame, starts: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The first key of each range that has any."""

    def least(batches):
        for batch in batches:
            place, hashes = (batch.column(i).to_numpy() for i in range(2))
            of = _range_of(place, hashes, starts)
            order = np.lexsort((hashes, place, of))
            first = np.ones(len(order), bool)
            first[1:] = of[order][1:] != of[order][:-1]
            at = order[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[at]), pa.array(place[at]), pa.array(hashes[at])], ["of", "place", "hash"]
            )

    found = keys.mapInArrow(least, "of long, place long, hash long").groupBy("of").agg(F.min(F.struct("place", "hash")).alias("key"))
    return {r["of"]: (r["key"]["place"], r["key"]["hash"]) for r in found.collect()}


def _dealt(starts: list[tuple[int, int]], heads: dict[int, tuple[int, int]]):
    """Rows with their range, those equal in id and text once per batch; the first
    document of a range goes to the end of the one before as well."""
    order = sorted(heads)
    follower = {heads[after]: before for before, after in zip(order, order[1:] + order[:1])}

    def run(batches):
        for batch in batches:
            place, hashes = (batch.column(i).to_numpy() for i in range(2))
            of = _range_of(place, hashes, starts)
            sort = np.lexsort((hashes, place))
            new = np.ones(len(sort), bool)
            new[1:] = (place[sort][1:] != place[sort][:-1]) | (hashes[sort][1:] != hashes[sort][:-1])
            first = np.flatnonzero(new)
            at, copies = sort[first], np.diff(np.append(first, len(sort)))
            tails = [(i, follower[key]) for i, key in zip(at, zip(place[at].tolist(), hashes[at].tolist())) if key in follower]
            taken = np.concatenate((at, np.array([i for i, _ in tails], np.int64)))
            ranges = np.concatenate((of[at], np.array([r for _, r in tails], np.int64)))
            times = np.concatenate((copies, np.zeros(len(tails), np.int64)))
            rows = batch.take(pa.array(taken))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges), pa.array((times == 0).astype(np.int32)), pa.array(times), *rows.columns],
                ["range", "tail", "copies", *batch.schema.names],
            )

    return run


def _rows(batches: Iterable[pa.RecordBatch], some: int = 256) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, some):
            yield from batch.slice(start, some).to_pylist()


def _edited(k: int, shingle: int):
    """Fingerprints of the documents of each range and of their edited texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict | None = None  # the document whose next one is to come
        todo: list[tuple[dict, dict]] = []
        size = 0

        def done():
            texts, edits = [], []
            for a, b in todo:
                half = len(a["text"]) // 2
                texts.append(a["text"].encode())
                edits.append((a["text"][: len(a["text"]) - half] + b["text"][:half]).encode())
            found = least_hashes([*texts, *edits, todo[-1][1]["text"].encode()], k, shingle)
            n, out = len(todo), []
            for i, (a, _) in enumerate(todo):
                # the next row begins with the next document, unless a range ends here
                after = found[i + 1] if i + 1 < n and todo[i][1] is todo[i + 1][0] else None
                if after is None:
                    after = found[-1] if i + 1 == n else least_hashes([todo[i][1]["text"].encode()], k, shingle)[0]
                out.append(
                    (a["doc_id"], len(a["text"]), hashlib.sha256(edits[i]).hexdigest(), to_text(found[i]), to_text(found[n + i]),
                     resemblance(found[i], found[n + i], k), resemblance(found[i], after, k), a["copies"])
                )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _EDITED)

        for row in _rows(batches):
            row["text"] = row["text"] or ""
            key = (row["place"], row["hash"])
            if waiting is not None and waiting["range"] == row["range"]:
                if not row["tail"] and key == (waiting["place"], waiting["hash"]):
                    waiting["copies"] += row["copies"]
                    continue
                todo.append((waiting, row))
                size += len(waiting["text"]) + len(row["text"])
                if size >= HELD_BYTES:
                    yield done()
                    todo, size = [], 0
            waiting = None if row["tail"] else row
        if todo:
            yield done()

    return run


_EDITED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"]


def edited_fingerprints(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE
) -> DataFrame:
    """Fingerprints of each document and of its text with the last half replaced by
    the beginning of the next document's, in descending order of ids.

    `doc_id`, `n_chars` (code points), `edited_sha256`, `fingerprint`,
    `edited_fingerprint`, `near_edited` and `near_next` (resemblance to the edited
    text and to the next document). After the last document comes the first; an only
    one is followed by itself. A null text is an empty one; a null id counts as the
    least. Of documents with one id, those with other texts follow in the order of a
    hash; rows equal in both are one document that is returned as often. Other columns
    are not read. An empty table has no rows.

    Texts travel once, to ranges of ids that are cut where rows are dense; the first
    document of a range also goes to the range before, which tells its last one what
    comes next.
    """
    rows = df.select(*_order(doc_id, text), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keys = rows.select("place", "hash")
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    starts = _ranges(keys, min(8 * wanted, MAX_RANGES))
    dealt = rows.mapInArrow(
        _dealt(starts, _heads(keys, starts)),
        "range long, tail int, copies long, place long, hash long, doc_id long, text string",
    )
    found = (
        dealt.repartition("range")
        .sortWithinPartitions("range", "tail", "place", "hash")
        .mapInArrow(
            _edited(k, shingle),
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, copies long",
        )
    )
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.withColumn("_copy", once).drop("copies", "_copy")
