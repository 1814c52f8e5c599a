"""Joins that stay even when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, functions as F


def join_apart(
    left: DataFrame, right: DataFrame, key: str, step: str = "", how: str = "inner"
) -> DataFrame:
    """Join on `key`, partitioned for this join alone.

    Spark broadcasts the smaller side if its size allows. Beyond that it sorts and
    merges, and splits a partition with a hot key over several tasks at runtime;
    but only if both sides come straight from a shuffle and the next step does not
    build on the join's partitioning. Chains of joins and groupings on one key
    break that rule, since Spark saves shuffles there.

    Here the sides are matched on the key wrapped in a struct. No other step is
    partitioned by that, so both sides are shuffled for the join, a later grouping
    combines its rows before its own shuffle, and a hot key can be split. Two such
    joins in a row need different `step` names.

    A left join keeps rows without a key. In no join do missing keys match, which
    structs around them would do.
    """
    match = f"struct('{step}', `{key}`) = struct('{step}', _key) AND _key IS NOT NULL"
    if how == "inner":
        match += f" AND `{key}` IS NOT NULL"
    right = right.withColumnRenamed(key, "_key")
    return left.join(right, F.expr(match), how).drop("_key")
