"""From products, SQUs and the ADQ sheet to ADQs per presentation."""

from pyspark.sql import DataFrame

from dosequant.fixed_values import PRESENTATION_COLUMNS
from dosequant.functions.quantity import adq_per_quantity, quantity_unit
from dosequant.operators.collapse import first_non_null
from dosequant.operators.normalise import normalised_adqs, normalised_products
from dosequant.operators.skew import join_apart

# Tells all input rows of one presentation apart.
ROW_ORDER = (
    "vpid", "form", "numerator", "numerator_unit_of_measure", "denominator",
    "denominator_unit_of_measure", "name", "form_indicator", "form_size",
    "form_units", "unit_of_measure", "ingredient_count", "squ", "bnf_name",
    "adq_value", "adq_denominator",
)


def adq_inputs(
    products: DataFrame,
    squs: DataFrame,
    adq_sheet: DataFrame,
    squ_join: str = "left",
    null_unit: str | None = "",
) -> DataFrame:
    """Products in normal units with their SQU and ADQ.

    Products without an ADQ are dropped. With `squ_join="inner"` so are those
    without an SQU; by default their quantity unit is inferred from the form.
    A missing ADQ unit is read as `null_unit`; if that is a text other than blank,
    so are missing units of products, and two missing units are the same then.

    The two tables with few rows per code are joined first, so that the product
    table, with its many, takes part in one join only.
    """
    adqs = normalised_adqs(adq_sheet, null_unit)
    per_code = adqs.join(squs.select("bnf_code", "squ"), "bnf_code", squ_join)
    return join_apart(normalised_products(products, null_unit or None), per_code, "bnf_code")


def computed_adqs(inputs: DataFrame) -> DataFrame:
    """The unit of each product's quantity, and the ADQs one such unit holds."""
    return inputs.withColumn("quantity_denominator", quantity_unit()).withColumn(
        "adq_per_quantity", adq_per_quantity()
    )


def adq_by_presentation(computed: DataFrame, order_by=ROW_ORDER) -> DataFrame:
    """One row per presentation: the first known value of each column."""
    columns = [c for c in PRESENTATION_COLUMNS if c != "bnf_code"]
    return first_non_null(computed, "bnf_code", columns, order_by)
