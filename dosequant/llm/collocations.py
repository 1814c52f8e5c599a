"""Phrase collocation mining: the best-scored phrases of each language, by growth.

Phrases grow word by word from their first one. The count of a prefix bounds what can
grow from it: no phrase occurs more often than its parts, so a phrase of a first word
with count f scores at most 1000 * n / f, and none that is to be kept has a part
below the least count. The rarest words promise most, so growth starts with them and
goes on to more frequent ones, round by round, until all that is left cannot reach the
last of a language's best surviving phrases, nor tie with it.

A round counts, length by length, the phrases that extend a prefix of the round (one
pass over the texts each), and then, in one pass, the parts that the cuts of the grown
phrases need and the phrases that are longer by a word in front. Tasks tell by sets of
bits which phrases are wanted; these let too many pass, never too few, and phrases are
counted by Spark as texts, so all counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from dosequant.llm import words as W
from dosequant.llm.arrays import spread
from dosequant.llm.bitset import bits_of
from dosequant.llm.storage import written
from dosequant.operators.skew import join_apart

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: The first round takes words of less than so many times the least count; while a
#: language lacks phrases, each round takes words so many times as frequent.
FIRST, FURTHER = 8, 64
CHUNK_BYTES = 1 << 20

#: These characters, and line ends, end a piece.
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD_ENDS = _PIECE_ENDS.copy()
_WORD_ENDS[[0x20, 0x09]] = True


class Phrases:
    """Words of the texts of one chunk, hashed with their language."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        words = W.Words(texts, _WORD_ENDS, lower=True)
        self.langs = langs
        seeds = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], np.uint64)
        self.text = words.text
        self.hashes = W.scatter(words.hashes() ^ seed[words.text]) if len(words.text) else words.hashes()
        ends = np.cumsum(_PIECE_ENDS[words.data], dtype=np.int32)
        self.piece = ends[words.start] + words.text if len(words.start) else words.start
        self.data, self.start, self.sizes = words.data, words.start, words.end - words.start

    def fits(self, size: int) -> np.ndarray:
        """Places from which `size` words of one piece go on."""
        n = len(self.piece) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])

    def joined(self, size: int) -> np.ndarray:
        return W.joined(self.hashes, size)

    def counted(self, places: np.ndarray, size: int) -> pa.RecordBatch:
        """(lang, phrase, f) of the phrases at the places, each once."""
        _, first, many = np.unique(self.joined(size)[places], return_index=True, return_counts=True)
        starts = places[first]
        # each word with the byte after it, which becomes one space between words
        words = spread(starts, np.full(len(starts), size))
        sizes = self.sizes[words] + 1
        text = self.data[spread(self.start[words], sizes)]
        ends = np.cumsum(sizes)
        text[ends - 1] = 0x20
        inside = np.ones(len(text), bool)
        inside[ends[size - 1 :: size] - 1] = False
        text = np.ascontiguousarray(text[inside])
        edges = np.concatenate(([0], ends[size - 1 :: size] - np.arange(1, len(starts) + 1))).astype(np.int32)
        phrases = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(text)])
        langs = pa.array(self.langs).take(pa.array(self.text[starts]))
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(many)], ["lang", "phrase", "f"])


def _chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[Phrases]:
    """The words of the batches, part by part of about CHUNK_BYTES; only one part is
    held beside the batch, and what Arrow keeps of earlier ones is given back."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        langs = batch.column(batch.schema.get_field_index("lang"))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
            yield Phrases(texts.slice(start, end - start).to_pylist(), langs.slice(start, end - start).to_pylist())
            start = end
        pa.default_memory_pool().release_unused()


_COUNTED = "lang string, phrase string, f long"


def _summed(counted: DataFrame, least: int) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def word_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of single words with `least` occurrences, and for each
    language a row without a phrase, whose f counts all words."""

    def run(batches):
        for found in _chunks(batches):
            yield found.counted(found.fits(1), 1)
            names, of = np.unique(np.array(found.langs, object), return_inverse=True)
            many = np.bincount(of[found.text], minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(many)], ["lang", "phrase", "f"]
            )

    counts = texts.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counts.where(F.col("phrase").isNull() | (F.col("f") >= least))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of whole phrases, from batches of them."""
    for found in _chunks(batches, "phrase"):
        many = np.bincount(found.text, minlength=len(found.langs))
        first = np.concatenate(([0], np.cumsum(many)))[:-1]
        for n in np.unique(many[many > 0]):
            yield found.joined(int(n))[first[many == n]]


def _set(phrases: DataFrame, count: int):
    return bits_of(phrases, _whole, ["lang", "phrase"], count)


def extensions(texts: DataFrame, size: int, prefixes, words, least: int) -> DataFrame:
    """Counts of phrases of `size` words that extend one of `prefixes` by one of `words`."""

    def run(batches):
        for found in _chunks(batches):
            at = found.fits(size)
            at = at[prefixes().has(found.joined(size - 1)[at])]
            at = at[words().has(found.hashes[at + size - 1])]
            yield found.counted(at, size)

    return _summed(texts.mapInArrow(run, _COUNTED), least)


def wanted_counts(texts: DataFrame, longest: int, parts, rests, words, least: int) -> DataFrame:
    """Counts of the phrases in `parts`, and of those that are one of `rests` with one
    of `words` in front."""

    def run(batches):
        for found in _chunks(batches):
            for size in range(2, longest + 1):
                at = found.fits(size)
                some = parts().has(found.joined(size)[at]) if size < longest else np.zeros(len(at), bool)
                if size > 2:
                    some |= rests().has(found.joined(size - 1)[at + 1]) & words().has(found.hashes[at])
                yield found.counted(at[some], size)

    return _summed(texts.mapInArrow(run, _COUNTED), least)


def _n_words(phrase: str) -> str:
    return f"size(split({phrase}, ' '))"


def _key(df: DataFrame, phrase: str, name: str = "_of") -> DataFrame:
    return df.withColumn(name, F.struct("lang", F.expr(phrase).alias("phrase")))


def _grown(texts: DataFrame, seeds: DataFrame, words, longest: int, least: int) -> DataFrame | None:
    """All phrases that grow from the seeds: lang, phrase, a, heads (the counts of
    their prefixes), n, and whether a word behind them makes no difference."""
    level, levels = seeds, []
    for size in range(2, longest + 1):
        many = level.count()
        if not many:
            break
        found = _key(extensions(texts, size, _set(level, many), words, least), f"substring_index(phrase, ' ', {size - 1})")
        before = level.select(F.struct("lang", "phrase").alias("_of"), F.concat("heads", F.array("a")).alias("heads"), "n")
        grown = join_apart(found, before, "_of", "grow")
        level = written(grown.select("lang", "phrase", F.col("f").alias("a"), "heads", "n"), "phrases")
        levels.append(level)
    if not levels:
        return None
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    longer = _key(every, f"substring_index(phrase, ' ', {_n_words('phrase')} - 1)").groupBy("_of").agg(F.max("a").alias("_longer"))
    joined = join_apart(_key(every, "phrase"), longer, "_of", "right", "left").drop("_of")
    return joined.where("_longer IS NULL OR _longer < a").drop("_longer")


#: 1000 * a * n / (l * r), without remainder, in whole numbers of up to 38 digits.
_SCORE = (
    "(CAST(1000 AS decimal(4, 0)) * CAST(a AS decimal(17, 0)) * CAST(n AS decimal(17, 0)))"
    " div (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0)))"
)


def _scored(texts: DataFrame, grown: DataFrame, counts: DataFrame, words, plan: DataFrame, longest: int, least: int) -> DataFrame:
    """The grown phrases that no longer one stands for, with their lowest cut."""
    words_of = counts.where("phrase IS NOT NULL").select(F.struct("lang", "phrase").alias("_of"), F.col("f").alias("r"))
    # the cut before the last word needs no further count and bounds the score
    last = join_apart(_key(grown, "substring_index(phrase, ' ', -1)"), words_of, "_of", "last")
    last = last.withColumn("l", F.element_at("heads", -1)).withColumn("_bound", F.expr(_SCORE)).drop("l", "r", "_of")
    limit = plan.select(F.col("lang").alias("_lang"), "settled")
    some = last.join(limit, F.expr("lang = _lang")).where("settled IS NULL OR _bound >= settled").drop("_lang", "settled", "_bound")
    some = written(some, "phrases")
    cuts = some.select("lang", "phrase", "a", "n", F.posexplode("heads").alias("k", "l"))
    cuts = cuts.withColumn("k", F.expr("k + 1")).withColumn("rest", F.expr(f"substring_index(phrase, ' ', k - {_n_words('phrase')})"))
    parts = cuts.where("instr(rest, ' ') > 0").select("lang", F.col("rest").alias("phrase")).distinct()
    shorter = some.where(f"{_n_words('phrase')} < {longest}").select("lang", "phrase")
    found = written(
        wanted_counts(texts, longest, _set(parts, parts.count()), _set(shorter, shorter.count()), words, least), "phrases"
    )
    all_parts = words_of.unionByName(found.select(F.struct("lang", "phrase").alias("_of"), F.col("f").alias("r")))
    whole = join_apart(_key(cuts, "rest"), all_parts, "_of", "cut").withColumn("score", F.expr(_SCORE))
    lowest = whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    behind = _key(found.where(f"{_n_words('phrase')} > 2"), "substring(phrase, instr(phrase, ' ') + 1)")
    behind = behind.groupBy("_of").agg(F.max("f").alias("_longer"))
    kept = join_apart(_key(lowest, "phrase"), behind, "_of", "left", "left").where("_longer IS NULL OR _longer < a")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _best(phrases: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    first: int = FIRST,
) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank, phrase,
    a, l, r, n, score.

    `a` counts the phrase, `n` all words of the language. Cut in two, it has a first
    part with count `l` and a rest with count `r`; of all cuts the one with the lowest
    score, the whole of 1000 * a * n / (l * r), counts, of those alike the shortest
    first part. Phrases below `least` are left out, and those that lie in a longer one
    that occurs as often. Ties of the score go to the greater count, then to the
    smaller phrase by bytes.

    Case of A to Z is not told apart; `.,;:!?` and line ends end a piece, which no
    phrase crosses, blanks and tabs end a word. Null and empty texts have no words, a
    null language is `und`, repeated rows count as often, other columns are not read.
    A language without such phrases, and an empty table, has no rows.
    """
    texts = df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text")
    ).where("text IS NOT NULL")
    counts = written(word_counts(texts, least), "phrases")
    vocabulary = counts.where("phrase IS NOT NULL")
    words = _set(vocabulary, vocabulary.count())
    most = counts.groupBy("lang").agg(
        F.max(F.expr("IF(phrase IS NULL, f, NULL)")).alias("n"), F.max(F.expr("IF(phrase IS NULL, NULL, f)")).alias("most")
    )
    no_score = F.lit(None).cast("long").alias("settled")
    plan = written(
        most.where("most IS NOT NULL").select("lang", "n", "most", F.lit(0).cast("long").alias("above"), F.lit(first * least).cast("long").alias("upto"), no_score),
        "phrases",
    )
    best = None
    while plan.count():
        seeds = vocabulary.join(plan.select(F.col("lang").alias("_lang"), "n", "above", "upto"), F.expr("lang = _lang AND f > above AND f <= upto"))
        seeds = written(seeds.select("lang", "phrase", F.col("f").alias("a"), F.array().cast("array<long>").alias("heads"), "n"), "phrases")
        grown = _grown(texts, seeds, words, longest, least)
        if grown is not None:
            found = _scored(texts, grown, counts, words, plan, longest, least)
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = written(_best(found, top), "phrases")
        plan = written(_next_plan(plan, best, top), "phrases")
    if best is None:
        best = df.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long, rank long")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _next_plan(plan: DataFrame, best: DataFrame | None, top: int) -> DataFrame:
    """What is left to grow: languages with words whose bound reaches the last of the
    best phrases so far, and up to which count their words do."""
    if best is None:
        plan = plan.withColumn("_last", F.lit(None).cast("long"))
    else:
        last = best.where(F.col("rank") == top).select(F.col("lang").alias("_lang"), F.col("score").alias("_last"))
        plan = plan.join(last, F.expr("lang = _lang"), "left").drop("_lang")
    # 1000 * n / f reaches the score up to this f
    reach = F.expr("(CAST(1000 AS decimal(4, 0)) * CAST(n AS decimal(17, 0))) div CAST(greatest(_last, 1) AS decimal(19, 0))")
    upto = F.when(F.col("_last").isNull(), F.col("upto") * FURTHER).when(F.col("_last") == 0, F.col("most")).otherwise(reach)
    after = plan.select("lang", "n", "most", F.col("upto").alias("above"), F.least(upto, F.col("most")).alias("upto"), F.col("_last").alias("settled"))
    return after.where("above < most AND upto > above")
