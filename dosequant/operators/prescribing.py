"""Operators over the prescribing table, the one that is really large."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dosequant.operators.skew import join_apart

PROVIDED_COLUMNS = (
    "Practice_Code",
    "BNF_Code",
    "BNF_Description",
    "Items",
    "Quantity",
    "ADQ_Usage",
)


def representative_presentation(
    prescribing: DataFrame,
    order_by=("Practice_Code", "Items", "Quantity", "ADQ_Usage", "BNF_Description"),
) -> DataFrame:
    """One prescribing row with positive ADQ usage per presentation.

    The first row in `order_by`, which covers every column returned, so that the
    outcome does not depend on how the table is laid out. Only the first row per
    code and task reaches the shuffle.
    """
    first = Window.partitionBy("BNF_Code").orderBy(*order_by)
    return (
        prescribing.where(F.col("ADQ_Usage") > 0)
        .select(*PROVIDED_COLUMNS)
        .withColumn("rownum", F.row_number().over(first))
        .where(F.col("rownum") == 1)
        .drop("rownum")
    )


def usage() -> Column:
    """ADQs of a prescribing row, from its quantity, items and ADQs per quantity."""
    return F.expr("Quantity * Items * adq_per_quantity")


def practice_usage(
    prescribing: DataFrame, presentations: DataFrame, by=("Practice_Code",)
) -> DataFrame:
    """ADQs prescribed per practice, over the whole prescribing table.

    `presentations` holds one row per code with its adq_per_quantity. Rows whose
    code it lacks, or has no figure for, or whose quantity or items are missing,
    are counted in n_uncomputed. Give it as a written table, as `Release` does: Spark
    then knows its size when planning, and if it fits a broadcast the reduced rows
    are not shuffled for the join.

    The table is reduced to one row per practice and code before its first
    shuffle; quantities are whole numbers, so their sums are exact, and a sum
    beyond the range of a long fails. What is left per practice, at most a row per
    code with a figure, is added up in ascending order, so that the total does not
    depend on the order in which executors deliver their parts.
    """
    figures = presentations.select("bnf_code", "adq_per_quantity")
    amounts = prescribing.groupBy(*by, F.col("BNF_Code").alias("bnf_code")).agg(
        F.expr("count(*)").alias("n"),
        F.expr("count(Quantity * Items)").alias("n_known"),
        F.expr("sum(Quantity * Items)").alias("amount"),
    )
    return (
        join_apart(amounts, figures, "bnf_code", how="left")
        .select(
            *by,
            "n",
            F.expr("IF(adq_per_quantity IS NULL, n, n - n_known)").alias("n_missing"),
            F.expr("amount * adq_per_quantity").alias("usage"),
        )
        .groupBy(*by)
        .agg(
            F.expr("sum(n)").alias("n_rows"),
            F.expr("sum(n_missing)").alias("n_uncomputed"),
            F.array_sort(F.collect_list("usage")).alias("usages"),
        )
        .select(
            *by,
            "n_rows",
            "n_uncomputed",
            F.expr(
                "CASE WHEN size(usages) > 0 THEN aggregate(usages, 0D, (a, x) -> a + x) END"
            ).alias("adq_usage"),
        )
    )


def back_computed(prescribing: DataFrame) -> DataFrame:
    """ADQs per quantity as implied by the published usage of each row."""
    return prescribing.select(
        *PROVIDED_COLUMNS,
        F.expr("try_divide(ADQ_Usage, Items * Quantity)").alias("adq_per_quantity"),
    )
