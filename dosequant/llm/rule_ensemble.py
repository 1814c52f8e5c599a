"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow trees are grown on a labelled sample; every path from a root is a rule, a
conjunction of bounds on statistics. A logistic regression with lasso penalty keeps
few of them, and those are compiled into one column expression, so that scoring is
a projection without shuffle or user function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from dosequant.llm.columns import packed, unpacked
from dosequant.llm.quality_rules import SPACES, STOP_WORDS

STATISTICS = (
    "n_words", "mean_word_chars", "symbol_ratio", "bar_ratio", "mark_ratio", "upper_ratio",
    "digit_ratio", "distinct_ratio", "same_next_ratio", "dup_line_ratio", "stop_ratio",
)
TREES, DEPTH, LASSO, SEED = 16, 3, 0.001, 11

#: feature index -> (greater than, at most)
Bounds = tuple[tuple[int, float, float], ...]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with a struct `_stats` of the statistics; a null text counts as empty.

    Ratios of nothing are 0, so an empty text has only zeros.
    """
    space = " \t\n\x0b\x0c\r"
    df = df.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn("_words", F.filter(F.split("_text", SPACES), lambda x: x != ""))
    df = df.withColumn("_joined", F.translate("_text", space, ""))
    df = df.withColumn(
        "_lines",
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, space, "")) > 0),
    )
    n, chars = F.size("_words"), F.length("_joined")
    without = lambda pattern: chars - F.length(F.regexp_replace("_joined", pattern, ""))
    these = lambda marks: chars - F.length(F.translate("_joined", marks, ""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    same_next = F.size(F.filter("_words", lambda w, i: w == F.get(F.col("_words"), i + 1)))
    stops = F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))
    lines = F.size("_lines")
    values = dict(
        n_words=n.cast("double"),
        mean_word_chars=ratio(chars, n),
        symbol_ratio=ratio(these("#*$%&"), chars),
        bar_ratio=ratio(these("|"), n),
        mark_ratio=ratio(these("!?"), n),
        upper_ratio=ratio(without(r"\p{Lu}"), chars),
        digit_ratio=ratio(these("0123456789"), chars),
        distinct_ratio=ratio(F.size(F.array_distinct("_words")), n),
        same_next_ratio=ratio(same_next, n),
        dup_line_ratio=ratio(lines - F.size(F.array_distinct("_lines")), lines),
        stop_ratio=ratio(stops, n),
    )
    struct = F.struct(*[values[name].alias(name) for name in STATISTICS])
    return df.withColumn("_stats", struct).drop("_text", "_words", "_joined", "_lines")


def tree_paths(root) -> list[Bounds]:
    """All paths from the root of a tree, as bounds on features; `root` is the node
    that a fitted tree model has on the JVM."""
    found, todo = [], [(root, {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            found.append(tuple((f, *bounds[f]) for f in sorted(bounds)))
        if node.getClass().getSimpleName() != "InternalNode":
            continue
        feature, at = node.split().featureIndex(), node.split().threshold()
        low, high = bounds.get(feature, (-math.inf, math.inf))
        todo.append((node.rightChild(), bounds | {feature: (max(low, at), high)}))
        todo.append((node.leftChild(), bounds | {feature: (low, min(high, at))}))
    return found


def rule_sql(rule: Bounds, stats: str = "_stats") -> str:
    """A rule as SQL condition."""
    parts = []
    for feature, low, high in rule:
        name = f"{stats}.{STATISTICS[feature]}"
        if low > -math.inf:
            parts.append(f"{name} > {low!r}D")
        if high < math.inf:
            parts.append(f"{name} <= {high!r}D")
    return " AND ".join(parts)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Bounds, float], ...]

    def score(self, stats: str = "_stats") -> Column:
        """Probability of label 1, as one expression over the statistics."""
        terms = [f"{self.intercept!r}D"]
        terms += [f"IF({rule_sql(r, stats)}, {w!r}D, 0D)" for r, w in self.rules]
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def fit(training: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Learn from (text, label) rows; a bounded sample, see `labelled.training_rows`.

    With no rows the score is 0.5 everywhere, with one class only its smoothed share.
    """
    rows = statistics(training).select(
        "label", *[F.col(f"_stats.{name}").alias(name) for name in STATISTICS]
    )
    rows = rows.repartition(8).persist()  # at most a bounded sample of small rows
    try:
        n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if ones in (0, n):
            share = (ones + 1) / (n + 2)
            return RuleEnsemble(math.log(share / (1 - share)), ())
        vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
        forest = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, maxBins=64, seed=SEED, subsamplingRate=0.7,
            featureSubsetStrategy="onethird",
        ).fit(vectors.transform(rows))
        paths = sorted({p for tree in forest.trees for p in tree_paths(tree._call_java("rootNode"))})
        if not paths:
            share = ones / n
            return RuleEnsemble(math.log(share / (1 - share)), ())
        stats = F.struct(*STATISTICS).alias("_stats")
        rules = ", ".join(f"CAST({rule_sql(p)} AS DOUBLE)" for p in paths)
        fired = rows.select("label", stats).select(
            "label", array_to_vector(F.expr(f"array({rules})")).alias("features")
        )
        model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=30, tol=1e-4).fit(fired)
        weights = [float(w) for w in model.coefficients.toArray()]
        return RuleEnsemble(
            float(model.intercept), tuple((p, w) for p, w in zip(paths, weights) if w)
        )
    finally:
        rows.unpersist()


def score_quality(df: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """`df` with `score` (0 to 1, higher is better) and `predicted` (1 from 0.5 on).

    Null and empty texts, and those of white space, have statistics of 0 and are scored
    by them. Columns named `score` or `predicted` give way, all others go along,
    whatever their names; repeated rows are scored each. An empty table has no rows.
    """
    columns = [c for c in df.columns if c != text]
    scored = (
        statistics(packed(df, text).withColumnRenamed("text", "_whole"), "_whole")
        .withColumn("score", model.score())
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .withColumnRenamed("_whole", text)
    )
    return unpacked(scored, columns, text, "score", "predicted")
