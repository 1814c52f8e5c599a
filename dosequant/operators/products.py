"""Product composition from the medicines dictionary tables."""

from pyspark.sql import DataFrame, functions as F

from dosequant.operators.skew import join_apart

STRENGTH = (
    "strnt_nmrtr_val",
    "strnt_nmrtr_uomcd",
    "strnt_dnmtr_val",
    "strnt_dnmtr_uomcd",
)


def ingredient_counts(vpi: DataFrame) -> DataFrame:
    """Number of ingredient rows per medicinal product."""
    return vpi.groupBy("vpid").agg(F.count("*").alias("ingredient_count"))


def _with_label(df: DataFrame, code: str, lookup: DataFrame, label: str) -> DataFrame:
    """`df` with the lookup's text for `code`, NULL where it has none."""
    texts = lookup.select(F.col("cd").alias(code), F.col("desc").alias(label))
    return df.join(texts, code, "left")


def product_details(
    product: DataFrame,
    vmp: DataFrame,
    vpi: DataFrame,
    dform: DataFrame,
    lookup_form: DataFrame,
    lookup_indicator: DataFrame,
    lookup_unit: DataFrame,
) -> DataFrame:
    """One row per product, form and ingredient strength, with all codes as text.

    Products without a code, without a medicinal product or without a known form
    are left out; products without ingredients are kept. Licensed routes play no
    part, as none of their columns is wanted and the rows are distinct anyway.

    Equal strengths of a medicinal product are merged, with their number, before
    anything is joined, so that counting them needs no second pass. Every
    medicinal product also gets a blank strength of number 0, which stands for it
    if it has no other; that way the join to the strengths can be an inner one,
    in which a hot key may be split on either side.
    """
    blank = vmp.select(
        "vpid",
        *[F.lit(None).cast(vpi.schema[c].dataType).alias(c) for c in STRENGTH],
        F.lit(0).cast("bigint").alias("n"),
    )
    listed = vpi.select("vpid", *STRENGTH, F.lit(1).cast("bigint").alias("n"))
    strengths = (
        listed.unionByName(blank).groupBy("vpid", *STRENGTH).agg(F.sum("n").alias("n"))
    )
    counts = strengths.groupBy("vpid").agg(F.sum("n").alias("n_ingredients"))
    strengths = _with_label(
        strengths, "strnt_nmrtr_uomcd", lookup_unit, "numerator_unit_of_measure"
    )
    strengths = _with_label(
        strengths, "strnt_dnmtr_uomcd", lookup_unit, "denominator_unit_of_measure"
    )

    forms = lookup_form.select(F.col("cd").alias("formcd"), F.col("desc").alias("form"))
    medicines = (
        vmp.join(dform.select("vpid", "formcd").distinct(), "vpid")
        .join(forms, "formcd")
        .join(counts, "vpid")
    )
    medicines = _with_label(medicines, "df_indcd", lookup_indicator, "form_indicator")
    medicines = _with_label(medicines, "udfs_uomcd", lookup_unit, "form_units")
    medicines = _with_label(medicines, "unit_dose_uomcd", lookup_unit, "unit_of_measure")

    coded = product.where(F.col("bnf_code").isNotNull()).select("bnf_code", "name", "vpid")
    composed = join_apart(
        join_apart(coded, medicines, "vpid", "medicine"), strengths, "vpid", "strength"
    )
    return (
        composed.where((F.col("n") > 0) | (F.col("n_ingredients") == 0))
        .select(
            "bnf_code",
            "name",
            "vpid",
            "form",
            "form_indicator",
            F.col("udfs").alias("form_size"),
            "form_units",
            "unit_of_measure",
            F.col("strnt_nmrtr_val").alias("numerator"),
            "numerator_unit_of_measure",
            F.col("strnt_dnmtr_val").alias("denominator"),
            "denominator_unit_of_measure",
            F.nullif("n_ingredients", F.lit(0)).alias("ingredient_count"),
        )
        .distinct()
    )
