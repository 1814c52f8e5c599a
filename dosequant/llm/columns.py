"""Rows carried along beside the text an operator works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def packed(df: DataFrame, text: str, **more: Column) -> DataFrame:
    """`df` as `_input`, a struct of all its columns but the text, `text`, and the
    columns given, so that no name of `df` meets one that an operator makes."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    carried = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    return df.select(carried.alias("_input"), F.col(f"`{text}`").alias("text"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], *results: str) -> DataFrame:
    """The columns given, from `_input`, but for those named like a result, and the
    results."""
    kept = [F.col(f"_input.`{c}`").alias(c) for c in columns if c not in results]
    return df.select(*kept, *results)
