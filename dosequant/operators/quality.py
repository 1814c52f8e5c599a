"""Comparison of our usage figures with the published ones."""

from pyspark.sql import Column, DataFrame, functions as F

from dosequant.fixed_values import (
    HIGH_USAGE,
    IBUPROFEN_LIQUID_PATTERN,
    PRESENTATION_COLUMNS,
    SQU_LABELS,
)
from dosequant.functions.text import (
    null_if_token,
    number_sql,
    rounded_to_tenth,
    sql_text,
)
from dosequant.operators.prescribing import usage
from dosequant.schemas import ADQ_SHEET


def usage_comparison(provided: DataFrame, presentations: DataFrame) -> DataFrame:
    """Published and our own usage of each presentation, side by side."""
    return (
        provided.withColumnsRenamed(
            {"BNF_Code": "bnf_code", "ADQ_Usage": "their_adq_usage"}
        )
        .join(presentations.select(*PRESENTATION_COLUMNS), "bnf_code")
        .withColumn("our_adq_usage", usage())
    )


def is_delta() -> Column:
    """Whether the figures differ at one decimal; a missing figure differs."""
    theirs, ours = rounded_to_tenth("their_adq_usage"), rounded_to_tenth("our_adq_usage")
    return F.coalesce(theirs != ours, F.lit(True))


def usage_delta(comparison: DataFrame) -> DataFrame:
    return comparison.where(is_delta())


def high_usage(delta: DataFrame, above: float = HIGH_USAGE) -> DataFrame:
    return delta.where(F.col("their_adq_usage") > above)


def qa_summary(
    comparison: DataFrame,
    ibuprofen_pattern: str = IBUPROFEN_LIQUID_PATTERN,
    above: float = HIGH_USAGE,
) -> DataFrame:
    """The figures of the quality report in one row, from one pass.

    All but n_total are counted among the rows whose figures differ.
    """
    figures = {
        "n_delta": "true",
        "n_uncomputed": "adq_per_quantity IS NULL",
        "n_patch": "unit_of_measure = 'patch'",
        "n_unit_dose": "unit_of_measure IN ('unit dose', 'dose')",
        "n_ibuprofen": f"bnf_code RLIKE {sql_text(ibuprofen_pattern)}",
        "n_high": f"their_adq_usage > {above}",
        "n_sachet": "unit_of_measure = 'sachet'",
    }
    return (
        comparison.withColumn("is_delta", is_delta())
        .agg(
            F.count("*").alias("n_total"),
            *[
                F.expr(f"count_if(is_delta AND {condition})").alias(name)
                for name, condition in figures.items()
            ],
        )
        .withColumn("pct", F.expr("rint(try_divide(n_delta, n_total) * 100D)"))
    )


def reject_report(sheet: DataFrame, dispensing: DataFrame) -> DataFrame:
    """How many input cells the rules had to turn into NULL, per kind of cell.

    An unreadable or zero ADQ value gives no figure. A dispensing row with an
    unknown unit code, or with one that could not be read, gives no SQU, and one
    without a month ranks below all dated ones. A caller who wants such input to
    fail can check that every count is 0. What readers leave out of their tables is
    in `sources.monthly_rejects` and `sources.unreadable_cells`. Dispensing rows with
    a column `n` stand for as many.
    """
    text = "cast(adq_value AS string)"
    sheet_counts = (
        sheet.toDF(*ADQ_SHEET.names)
        .select(null_if_token(text).alias("text"), F.expr(number_sql(text)).alias("value"))
        .agg(
            F.expr("count_if(text IS NOT NULL AND value IS NULL)").alias(
                "adq_value_unreadable"
            ),
            F.expr("count_if(value = 0)").alias("adq_value_zero"),
        )
    )
    many = F.col("n") if "n" in dispensing.columns else F.lit(1).cast("long")
    rows_where = lambda c: F.coalesce(F.sum(F.when(c, many)), F.lit(0).cast("long"))
    dispensing_counts = dispensing.agg(
        rows_where(~F.col("squ_code").isin(*SQU_LABELS)).alias("squ_code_unknown"),
        rows_where(F.col("squ_code").isNull()).alias("squ_code_unreadable"),
        rows_where(F.col("month").isNull()).alias("month_missing"),
    )

    def as_rows(counts: DataFrame) -> DataFrame:
        return counts.unpivot([], counts.columns, "reject", "n")

    return as_rows(sheet_counts).unionByName(as_rows(dispensing_counts))
