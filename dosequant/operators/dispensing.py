"""Standard quantity units (SQUs) from the monthly dispensing tables."""

from pyspark.sql import Column, DataFrame, functions as F

from dosequant.fixed_values import APPLIANCE_CLASS, SQU_LABELS


def squ_label(code: Column) -> Column:
    """The unit a code stands for; NULL for an unknown code."""
    pairs = [F.lit(part) for pair in SQU_LABELS.items() for part in pair]
    return F.create_map(*pairs)[code]


def coded_dispensing(dispensing: DataFrame) -> DataFrame:
    """Dispensing rows that tell a unit: no appliances, code and unit known.

    A row whose preparation class is missing is not an appliance and is kept.
    """
    return dispensing.where(
        ~F.col("preparation_class").eqNullSafe(F.lit(APPLIANCE_CLASS))
        & F.col("bnf_code").isNotNull()
        & F.col("squ_code").isin(*SQU_LABELS)
    )


def squ_pairs(dispensing: DataFrame) -> DataFrame:
    """Every distinct (bnf_code, squ) over all months.

    Takes a stream of dispensing rows as well, and then gives each pair once.
    """
    return (
        coded_dispensing(dispensing)
        .select("bnf_code", "squ_code")
        .dropDuplicates()
        .select("bnf_code", squ_label(F.col("squ_code")).alias("squ"))
    )


def squ_latest(dispensing: DataFrame) -> DataFrame:
    """The SQU of each code's most recent month; the larger code number on a tie.

    Month and code travel in one number, because a maximum over a number is a
    hash aggregate with map-side combine, while one over a struct makes Spark
    sort the whole dispensing table first.
    """
    width = max(SQU_LABELS) + 1
    # Day 0 is 1970-01-01; rows without a month rank below every dated one.
    day = F.coalesce(F.unix_date("month"), F.lit(-1_000_000)).cast("bigint")
    ranked = coded_dispensing(dispensing).select(
        "bnf_code", (day * width + F.col("squ_code")).alias("month_and_code")
    )
    latest = ranked.groupBy("bnf_code").agg(F.max("month_and_code").alias("latest"))
    code = F.pmod(F.col("latest"), F.lit(width)).cast("int")
    return latest.select("bnf_code", squ_label(code).alias("squ"))


def squ_of(squs: DataFrame, bnf_code: str) -> DataFrame:
    """The SQU rows of one code."""
    return squs.where(F.col("bnf_code") == bnf_code)
