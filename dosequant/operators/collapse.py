"""One row per key, previews and field listings."""

from pyspark.sql import Column, DataFrame, functions as F


def first_non_null(df: DataFrame, key: str, columns, order_by) -> DataFrame:
    """Per key and column, the first value that is not NULL in `order_by`.

    A result row may mix values of several source rows. Rows with a NULL key are
    dropped. `order_by` should tell all rows of a key apart.
    """
    found = [
        F.expr(f"min_by(`{c}`, _order) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)
        for c in columns
    ]
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_order", F.struct(*order_by))
        .groupBy(key)
        .agg(*found)
    )


def preview(df: DataFrame, key, rows: int = 5) -> DataFrame:
    """The first rows in the order of `key`."""
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    return df.orderBy(*keys).limit(rows)


def field_values(products: DataFrame) -> DataFrame:
    """The values of the two form fields, each as one text in sorted order.

    Products without form units count as having blank ones. Both fields come from
    lookup tables, which bounds what the listing has to hold.
    """
    def listed(value: str) -> Column:
        return F.expr(f"concat_ws(', ', array_sort(collect_set({value})))")

    return products.agg(
        listed("form_indicator").alias("form_indicator"),
        listed("coalesce(form_units, '')").alias("form_units"),
    )
