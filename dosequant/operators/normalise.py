"""Unit normalisation of whole tables."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from dosequant.functions.doses import dose_from_name
from dosequant.functions.text import (
    null_if_token,
    number_sql,
    real_sql,
    sql_text,
)
from dosequant.functions.units import clean_unit_sql, normal_unit, scaled_number
from dosequant.schemas import ADQ_SHEET


def normalise_units(
    df: DataFrame, *measures: tuple[str, str], null_unit: str | None = None
) -> DataFrame:
    """Replace each (number, unit) pair of columns by the measure in grammes, ml,
    units or doses.

    A number column of text may hold comma-grouped numbers. A missing unit stays
    missing unless `null_unit` names what to read instead.
    """
    plain, normal = {}, {}
    for number, unit in measures:
        is_text = isinstance(df.schema[number].dataType, StringType)
        value = number_sql(f"`{number}`") if is_text else real_sql(f"`{number}`")
        label = f"`{unit}`"
        if null_unit is not None:
            label = f"coalesce({label}, {sql_text(null_unit)})"
        plain |= {number: value, unit: clean_unit_sql(label)}
        normal |= {
            number: scaled_number(f"`{number}`", f"`{unit}`"),
            unit: normal_unit(f"`{unit}`"),
        }
    # Read the cells first, so that the rules see plain columns.
    cells = [f"{plain.get(c, f'`{c}`')} AS `{c}`" for c in df.columns]
    return df.selectExpr(*cells).withColumns(normal)


def normalised_products(products: DataFrame, null_unit: str | None = None) -> DataFrame:
    """The product table with strengths in normal units.

    A missing unit stays missing unless `null_unit` names what to read instead. A
    form size that is not a number is missing, as other numbers are.
    """
    if "form_size" in products.columns:
        products = products.withColumn("form_size", F.expr(real_sql("form_size")))
    return normalise_units(
        products,
        ("numerator", "numerator_unit_of_measure"),
        ("denominator", "denominator_unit_of_measure"),
        null_unit=null_unit,
    )


def normalised_adqs(sheet: DataFrame, null_unit: str | None = "") -> DataFrame:
    """The ADQ sheet with doses per pack, in normal units, without unset values.

    The sheet's four columns are taken by position, as its headings vary. A
    missing unit reads as blank, which the ADQ rules take as "unit".
    """
    adqs = sheet.toDF(*ADQ_SHEET.names)
    present = null_if_token("cast(adq_value AS string)").isNotNull()
    return normalise_units(
        adqs.where(present).withColumn("dose_multiplier", dose_from_name("bnf_name")),
        ("adq_value", "adq_denominator"),
        null_unit=null_unit,
    )
