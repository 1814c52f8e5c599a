"""Quality rules: a table of thresholds compiled into one projection.

All figures of a text are built-in expressions over the text, and a rule is one row
of a table: figure, least and greatest value. Nothing is shuffled and no user
function runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from dosequant.llm.columns import packed, unpacked

#: Characters between words, and characters counted as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "como con del el es esta la las los no para por que se su una y".split()
)


class Rule(NamedTuple):
    """Texts whose figure lies outside [least, most] are rejected; None: no limit."""

    figure: str
    least: float | None
    most: float | None


#: Ratios are per code point of the words (symbol_ratio, upper_ratio), per word
#: (mark_ratio, stop_ratio) or per line with a word (dup_line_ratio).
THRESHOLDS = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.08),
    Rule("mark_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.4),
    Rule("stop_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.6),
)

MIN_WORDS = 50
MAX_REPEATED = 0.5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the counts and ratios the rules are about, in a struct `_figures`.

    A null text has the figures of an empty one. Ratios of nothing are 0, and
    stop_ratio is 1, so that a text without words is judged by its length alone.
    """
    text = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    has_word = lambda x: F.length(_without(x, " \t\n\x0b\x0c\r")) > 0
    following = lambda a, i, k: F.get(a, i + k)
    df = df.withColumn("_text", text)
    df = df.withColumn("_words", F.filter(F.split("_text", SPACES), lambda x: x != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), has_word))
    df = df.withColumn("_joined", _without(F.col("_text"), " \t\n\x0b\x0c\r"))
    # equal 3-word windows stand side by side when sorted by their hash
    df = df.withColumn(
        "_windows",
        F.sort_array(
            F.slice(
                F.transform(
                    "_words",
                    lambda w, i: F.struct(
                        F.xxhash64(w, following(F.col("_words"), i, 1), following(F.col("_words"), i, 2)).alias("h"),
                        i.alias("at"),
                    ),
                ),
                1,
                F.greatest(F.size("_words") - 2, F.lit(0)),
            )
        ),
    )
    windows = F.col("_windows")
    same = lambda x, i, k: F.coalesce(F.get(windows, i + k)["h"] == x["h"], F.lit(False))
    df = df.withColumn(
        "_repeats",
        F.sort_array(
            F.transform(
                F.filter(windows, lambda x, i: F.when(i > 0, same(x, i, -1)).otherwise(False) | same(x, i, 1)),
                lambda x: x["at"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "_repeats",
            lambda at, i: F.least(F.lit(3), F.coalesce(following(F.col("_repeats"), i, 1) - at, F.lit(3))),
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    count = lambda x: x.cast("long")
    removed = lambda characters: F.length("_joined") - F.length(_without(F.col("_joined"), characters))
    upper = F.length("_joined") - F.length(F.regexp_replace("_joined", r"\p{Lu}", ""))
    stops = F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))
    df = df.withColumn(
        "_counts",
        F.struct(
            count(F.size("_words")).alias("n_words"),
            count(F.length("_joined")).alias("word_chars"),
            count(F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).alias("n_symbols"),
            count(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            count(F.size("_lines")).alias("n_lines"),
            count(removed("!?")).alias("n_marks"),
            count(upper).alias("n_upper"),
            count(stops).alias("n_stop_words"),
        ),
    )
    c = F.col("_counts")
    ratio = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)
    figures = F.struct(
        "_counts.*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        F.when(c["n_words"] > 0, c["n_stop_words"] / c["n_words"]).otherwise(1.0).alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    return df.withColumn("_figures", figures).drop(
        "_text", "_words", "_lines", "_joined", "_windows", "_repeats", "_counts"
    )


def broken_rules(figures: Column, rules: Sequence[Rule]) -> Column:
    """Names of the figures whose rule is broken, as one array expression."""
    checks = []
    for rule in rules:
        value = figures[rule.figure]
        wrong = F.lit(False)
        if rule.least is not None:
            wrong = wrong | (value < rule.least)
        if rule.most is not None:
            wrong = wrong | (value > rule.most)
        checks.append(F.when(wrong, F.lit(rule.figure)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def judge_quality(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = THRESHOLDS,
    min_words: int = MIN_WORDS,
    max_repeated: float = MAX_REPEATED,
) -> DataFrame:
    """Each row of `df` with its figures and the verdict, in struct columns
    `figures` and `broken` (names of broken rules), `base_failed` and `kept`.

    Null and empty texts have no words and fail the base rule. Rows stay one to one,
    repeated ones too; columns of `df` named like a result are replaced.
    """
    columns = [c for c in df.columns if c != text]
    df = text_figures(packed(df, text).withColumnRenamed("text", "_whole"), "_whole")
    figures = F.col("_figures")
    base = (figures["n_words"] < min_words) | (
        figures["n_repeat_words"] > max_repeated * figures["n_words"]
    )
    judged = (
        df.withColumn("broken", broken_rules(figures, rules))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.size("broken") == 0))
        .withColumnsRenamed({"_figures": "figures", "_whole": text})
    )
    return unpacked(judged, columns, text, "figures", "broken", "base_failed", "kept")
