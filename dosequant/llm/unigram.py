"""SentencePiece encoding and decoding: unigram segmentation over a double-array trie.

The pieces of a text are those with the greatest sum of log scores, found by Viterbi
search over all pieces that a double-array trie finds in it. Characters without a
piece are written as byte pieces. Spaces become a marker before segmentation and
spaces again when decoding, so decoding gives the text back exactly.

No piece of the usual vocabularies goes on across the beginning of a word, nor from
letters to other characters or back. Where that holds, which is checked, words and
runs of letters are segmented apart, and what came out is kept for the next time
they come up in the same task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: The space marker, and how much worse than the worst piece an
#: unknown character is.
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose segmentation a task keeps.
KEPT_WORDS = 1 << 19


class DoubleArray:
    """A trie over bytes in two arrays: node + byte leads to base[node] + byte, if
    check there names the node. `value` is the piece that ends at a node, or -1."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: Sequence[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free_from = wide_from = 257  # where to look for one cell, and for several
        todo = [(0, 0, len(keys), 0)]  # node, first and last key below it, depth
        while todo:
            node, low, high, depth = todo.pop()
            children: list[tuple[int, int, int]] = []
            for i in range(low, high):
                key = keys[i][0]
                if len(key) == depth:
                    value[node] = keys[i][1]
                elif not children or children[-1][0] != key[depth]:
                    children.append((key[depth], i, i + 1))
                else:
                    children[-1] = (children[-1][0], children[-1][1], i + 1)
            if not children:
                continue
            first = children[0][0]
            place = began = free_from if len(children) == 1 else wide_from
            while True:
                while place < len(check) and check[place] != -1:
                    place += 1
                at = place - first
                if at > 0:
                    if at + 256 >= len(check):
                        more = len(check)
                        base += [0] * more
                        check += [-1] * more
                        value += [-1] * more
                    if all(check[at + c] == -1 for c, _, _ in children):
                        break
                place += 1
            if len(children) > 1 and place - began > 512:  # what lies before is nearly full
                wide_from = place
            base[node] = at
            for c, a, b in children:
                check[at + c] = node
                todo.append((at + c, a, b, depth + 1))
            while free_from < len(check) and check[free_from] != -1:
                free_from += 1
        used = max(i for i, c in enumerate(check) if c != -1) + 257
        return cls(*(np.array((x + [y] * 257)[:used], np.int32) for x, y in ((base, 0), (check, -1), (value, -1))))

    def lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.base.tolist(), self.check.tolist(), self.value.tolist()


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores. Control and unknown pieces match no text."""

    pieces: tuple[bytes, ...]
    scores: tuple[float, ...]
    matches: tuple[bool, ...]
    byte_ids: tuple[int, ...]  # id of each byte's piece

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Pieces and scores of a SentencePiece model file; it must have byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        return cls(
            tuple(model.id_to_piece(i).encode() for i in ids),
            tuple(float(model.get_score(i)) for i in ids),
            tuple(not x for x in special),
            tuple(byte_ids[b] for b in range(256)),
        )


class Segmenter:
    """Encoder and decoder of one vocabulary, as a task uses it."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray):
        self.vocabulary = vocabulary
        self.base, self.check, self.value = trie.lists()
        used = [s for s, m in zip(vocabulary.scores, vocabulary.matches) if m]
        self.unknown = min(used, default=0.0) - UNKNOWN_PENALTY
        marker = MARKER.encode()
        inside = re.compile(b"(?<!%b)%b" % (marker, marker))
        used_pieces = [p for p, m in zip(vocabulary.pieces, vocabulary.matches) if m]
        self.by_word = not any(inside.search(p, 1) for p in used_pieces)
        mixed = any(_MIXED.search(p.decode()) for p in used_pieces)
        self.parts = None if not self.by_word else _WORD if mixed else _RUN
        self.longest = max((len(p) for p, m in zip(vocabulary.pieces, vocabulary.matches) if m), default=0)
        self.known: dict[str, tuple[int, ...]] = {}
        self.texts = {i: p.replace(marker, b" ") for i, p in enumerate(vocabulary.pieces)}
        self.texts |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}

    def best(self, text: bytes) -> tuple[int, ...]:
        """Ids of the best segmentation of marked text.

        Of equally good ones that with the longest last piece, and so on backwards.
        """
        base, check, value = self.base, self.check, self.value
        scores, byte_ids = self.vocabulary.scores, self.vocabulary.byte_ids
        n, worst = len(text), -math.inf
        total = [worst] * (n + 1)
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        total[0] = 0.0
        for start, byte in enumerate(text):
            here = total[start]
            if here == worst:
                continue
            width = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            single, node, at = False, 0, start
            for c in text[start : start + self.longest]:
                following = base[node] + c
                if check[following] != node:
                    break
                node, at = following, at + 1
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if at == start + width:
                        single = True
                    if score > total[at]:
                        total[at], came[at] = score, (start, piece)
            if not single:
                at, score = start + width, here + self.unknown
                if score > total[at]:
                    total[at], came[at] = score, (start, -1)
        ids: list[int] = []
        at = n
        while at:
            start, piece = came[at]
            ids += [piece] if piece >= 0 else [byte_ids[c] for c in reversed(text[start:at])]
            at = start
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for an empty one. A marker in the text itself is
        written as bytes, so that it is not taken for a space later."""
        if not text:
            return []
        ids: list[int] = []
        for i, part in enumerate(text.split(MARKER)):
            if i:
                ids += [self.vocabulary.byte_ids[b] for b in MARKER.encode()]
            marked = part.replace(" ", MARKER)
            if not i:
                marked = MARKER + marked
            for word in self._words(marked):
                found = self.known.get(word)
                if found is None:
                    if len(self.known) >= KEPT_WORDS:
                        self.known.clear()
                    found = self.best(word.encode())
                    if len(word) <= 64:
                        self.known[word] = found
                ids += found
        return ids

    def _words(self, marked: str) -> list[str]:
        if self.parts is None:
            return [marked] if marked else []
        return self.parts.findall(marked)

    def decode(self, ids: Sequence[int]) -> str:
        data = b"".join([self.texts[i] for i in ids])
        return data[1:].decode() if data[:1] == b" " else data.decode()


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
#: Runs of letters or of other characters, with the markers before them.
_RUN = re.compile(f"{MARKER}*[{_LETTERS}]+|{MARKER}*[^{MARKER}{_LETTERS}]+|{MARKER}+")
_MIXED = re.compile(f"[{_LETTERS}][^{MARKER}{_LETTERS}]|[^{MARKER}{_LETTERS}][{_LETTERS}]")


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def with_ids(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """`df` with `ids`, the piece ids of each text, and if asked for with the text
    decoded from them. Null and empty texts have no ids and decode to empty texts.

    Columns of `df` that are named like `ids` or `decoded` give way; all others go
    along, and repeated rows are coded each. Of ways to cut a text with the same total
    score the one with the longer last piece is taken, so equal texts have equal ids. A
    word is segmented as a whole and held with a few numbers for each of its letters.
    The vocabulary is broadcast; its size is that of a tokenizer, whatever the input.
    """
    spark = df.sparkSession
    keys = [(p, i) for i, (p, m) in enumerate(zip(vocabulary.pieces, vocabulary.matches)) if m]
    sent = spark.sparkContext.broadcast((vocabulary, DoubleArray.build(keys)))
    df = df.drop(*[c for c in (ids, decoded) if c and c != text])
    names = df.columns
    kept = [n for n in names if n != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [segmenter.encode(x) if x else [] for x in _column(part, text).to_pylist()]
                columns = [_column(part, n) for n in kept] + [pa.array(found, pa.list_(pa.int32()))]
                labels = [*kept, ids]
                if decoded:
                    columns.append(pa.array([segmenter.decode(x) for x in found], pa.string()))
                    labels.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, labels)

    fields = [f for f in df.schema.fields if f.name in kept]
    fields.append(T.StructField(ids, T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return df.mapInArrow(run, T.StructType(fields))


def with_text(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """`df` with the text decoded from `ids`; empty for null or no ids."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, DoubleArray.build([])))
    df = df.drop(text)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*sent.value)
        for batch in batches:
            texts = [segmenter.decode(x or []) for x in _column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))
