"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Lookalike letters and digits are folded to plain letters first, then everything
else between letters becomes a space. Entries are whole words (" word "), beginnings
of words (" wor") or exception phrases (" word next "), all matched in one pass by
one automaton. A word counts once, with its heaviest entry, unless an exception
phrase covers it. The sum is related to the length and turned into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from dosequant.llm.columns import packed, unpacked

#: Letters of other scripts that look like Latin ones, and digits and
#: signs written for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝһαβεικνορτυχ", "abekmhopctyxijsdqwhabeikvoptux", strict=True))
SUBSTITUTES = dict(zip("013457", "oieast", strict=True))

#: An entry must occur in this share of the toxic training documents, and in so many,
#: and be so many times likelier there (as a logarithm).
MIN_SHARE, MIN_DOCUMENTS, MIN_WEIGHT = 0.01, 3, 2.5
#: Letters of the beginnings of words that may become entries.
MIN_PREFIX, MAX_PREFIX = 4, 10


class _Folding(dict):
    """Folded form of each character, found when first seen."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in LOOKALIKES:
            out = LOOKALIKES[c]
        elif c in SUBSTITUTES:
            out = SUBSTITUTES[c]
        else:
            plain = unicodedata.normalize("NFKD", c)
            out = "".join(x for x in plain if x.isalpha() and not unicodedata.combining(x)) or (
                "" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else " "
            )
        self[code] = out
        return out


_FOLDING = _Folding()
_SIGNS = re.compile(r"[@$](?=\w)")


def fold(text: str) -> str:
    """Lower-case text of letters and spaces, with a space at both ends."""
    text = text.lower()
    if "$" in text or "@" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return f" {text.translate(_FOLDING)} "


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    intercept: float = -3.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def automaton(self):
        patterns = {phrase: (0.0, len(phrase)) for phrase in self.exceptions}
        patterns |= {entry: (weight, len(entry)) for entry, weight in self.entries}
        out = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            out.add_word(pattern, value)
        if patterns:
            out.make_automaton()
        return out if patterns else None


def weigh(automaton, folded: str) -> tuple[float, int, list[int]]:
    """Sum of weights, number of words counted and where those words start."""
    if automaton is None:
        return 0.0, 0, []
    words: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    for end, (weight, size) in automaton.iter(folded):
        start = end - size + 1
        if weight:
            if weight > words.get(start, 0.0):
                words[start] = weight
        else:
            excepted.append((start, end))
    for start, end in excepted:
        for at in [at for at in words if start <= at < end]:
            del words[at]
    return sum(words.values()), len(words), sorted(words)


def _terms(folded: str) -> set[str]:
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:k]}" for k in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1))
    return found


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        texts, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "label"))
        for text, label in zip(texts, labels):
            (toxic if label else clean).update(_terms(fold(text)))
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(terms, pa.string()), "toxic": pa.array([toxic[t] for t in terms], pa.int64()),
             "clean": pa.array([clean[t] for t in terms], pa.int64())}
        )


def _without_longer(found: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Leave out entries that begin with a kept one of about the same weight."""
    kept: dict[str, float] = {}
    for term, weight in sorted(found, key=lambda x: (len(x[0]), x[0])):
        shorter = (term[:k] for k in range(MIN_PREFIX + 1, len(term)))
        if not any(kept.get(s, -math.inf) >= weight - 0.7 for s in shorter):
            kept[term] = weight
    return sorted(kept.items())


def _scorer(lexicon: Lexicon, text: str, names: list[str]):
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(lexicon.automaton())
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            weights, hits, sizes = [], [], []
            for x in texts:
                folded = fold(x) if x else ""
                if lexicon.exceptions:
                    folded = " ".join(["", *folded.split(), ""])
                weight, n, _ = weigh(built[0], folded)
                weights.append(weight)
                hits.append(n)
                sizes.append(len(x.split()) if x else 0)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array(weights, pa.float64()), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "weight", "n_hits", "n_words"])

    return run


def weighed(df: DataFrame, lexicon: Lexicon, carried: str) -> DataFrame:
    """`carried` of `df`, with `weight`, `n_hits` and `n_words` of each `text`."""
    names = ("weight", T.DoubleType()), ("n_hits", T.LongType()), ("n_words", T.LongType())
    schema = T.StructType([df.schema[carried], *[T.StructField(n, t) for n, t in names]])
    return df.select(carried, "text").mapInArrow(_scorer(lexicon, "text", [carried]), schema)


def _strengths():
    per_length = F.col("weight") * 1000 / (F.col("n_words") + 50)
    return F.log1p("weight").alias("x0"), F.log1p(per_length).alias("x1")


def fit(
    training: DataFrame, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS, min_weight: float = MIN_WEIGHT
) -> Lexicon:
    """Learn entries, exceptions and the probability from (text, label) rows.

    An entry occurs in `min_share` of the toxic rows and in `min_documents` of them,
    and is likelier there by `min_weight` (a logarithm); an exception occurs as often
    in clean rows, and in no toxic one. There is no further limit on either: their
    number is bounded by that of the rows, since `training` is a bounded sample, see
    `labelled.training_rows`. Equal texts count once, null ones are empty. Without
    toxic or without clean rows the lexicon is empty.
    """
    rows = training.groupBy("text").agg(F.max("label").alias("label")).persist()
    try:
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n_toxic, n_clean = counts.get(1.0, 0), counts.get(0.0, 0)
        if not n_toxic or not n_clean:
            return Lexicon((), intercept=3.0 if n_toxic else -3.0)
        least = max(min_documents, math.ceil(min_share * n_toxic))
        weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
        terms = (
            rows.mapInArrow(_count_terms, "term string, toxic long, clean long")
            .groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") >= least)
            .withColumn("weight", weight)
            .where(F.col("weight") >= min_weight)
        )
        entries = tuple(_without_longer([(r["term"], r["weight"]) for r in terms.collect()]))
        lexicon = Lexicon(entries, _exceptions(rows, entries, min_documents))
        scored = weighed(rows, lexicon, "label").select("label", *_strengths())
        scored = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(scored)
        model = LogisticRegression(regParam=1e-4, maxIter=100).fit(scored.select("label", "features"))
        slopes = tuple(float(x) for x in model.coefficients.toArray())
        return Lexicon(entries, lexicon.exceptions, float(model.intercept), slopes)
    finally:
        rows.unpersist()


def _exceptions(rows: DataFrame, entries: tuple[tuple[str, float], ...], min_documents: int) -> tuple[str, ...]:
    """Phrases of a lexicon word and a neighbour that only clean documents have."""
    lexicon = Lexicon(entries)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found, labels = [], []
            for text, label in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "label"))):
                folded = " ".join(["", *fold(text).split(), ""])
                for at in weigh(automaton, folded)[2]:
                    word = folded[at : folded.index(" ", at + 1) + 1]
                    before, after = folded[:at].rpartition(" ")[2], folded[at + len(word) :].partition(" ")[0]
                    near = ([f" {before}{word}"] if before else []) + ([f"{word}{after} "] if after else [])
                    found += near
                    labels += [label] * len(near)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(found, pa.string()), "label": pa.array(labels, pa.float64())})

    found = (
        rows.mapInArrow(phrases, "phrase string, label double")
        .groupBy("phrase")
        .agg(F.count("*").alias("n"), F.max("label").alias("label"))
        .where((F.col("n") >= min_documents) & (F.col("label") == 0))
    )
    return tuple(sorted(r["phrase"] for r in found.collect()))


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", least: float = 0.7) -> DataFrame:
    """One row for each of `df`, without the text: `score` (0 to 1), `predicted` (1
    from `least` on), `n_hits`, `n_words`.

    Null and empty texts score as no match. Other columns go along, but for those
    named like one of the four, which give way; repeated rows are scored each.
    """
    x0, x1 = _strengths()
    linear = F.lit(lexicon.intercept) + lexicon.slopes[0] * x0 + lexicon.slopes[1] * x1
    scored = weighed(packed(df, text), lexicon, "_input").withColumn("score", 1 / (1 + F.exp(-linear)))
    scored = scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
    return unpacked(scored, [c for c in df.columns if c != text], "score", "predicted", "n_hits", "n_words")
