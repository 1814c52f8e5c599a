"""Column rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from dosequant.functions import (
    adq_per_quantity,
    dose_from_name,
    file_name_of_url,
    quantity_in_adq_units,
    quantity_unit,
    rounded_to_tenth,
    strength_from_name,
)
from dosequant.operators import normalise_units, normalised_adqs

from tests import golden


def test_published_rows(spark):
    rows = spark.createDataFrame(golden.ROWS, golden.COLUMNS)
    for row in rows.withColumn("found", adq_per_quantity()).collect():
        assert round(row.found, 3) == row.expected, row.label


def test_rows_beyond_the_rules_keep_their_figure(spark):
    rows = spark.createDataFrame(golden.PINNED, golden.COLUMNS)
    for row in rows.withColumn("found", adq_per_quantity()).collect():
        found = None if row.found is None else round(row.found, 3)
        assert found == row.expected, row.label


def test_doses_in_names(spark):
    rows = spark.createDataFrame(golden.DOSES, "name string, expected double")
    for row in rows.withColumn("found", dose_from_name("name")).collect():
        assert row.found == row.expected, row.name


UNITS = [
    ("mega u", "2000", "unit dose", 2.0),
    ("u", "500", "unit dose", 0.5),
    ("mcg", "250", "g", 250 / 1000.0 / 1000),
    ("microgram", "7", "g", 7 / 1000.0 / 1000),
    ("mg", "20", "g", 0.02),
    ("gramme", "3", "g", 3.0),
    ("gram", "3", "g", 3.0),
    ("te", "10", "unit dose", 10000.0),
    ("puffs", "8", "dose", 8.0),
    ("microlitre", "5", "ml", 0.005),
    ("litre", "1.5", "ml", 1500.0),
    ("ml", "4", "ml", 4.0),
    ("mmol", "5.4", "mmol", 5.4),
    ("unit", "1", "unit", 1.0),
    ("hour", "1", "hour", 1.0),
    (" MG ", "1,000", "g", 1.0),
    (" Gramme ", "1,234,567", "g", 1234567.0),
    ("   ", "1", "", 1.0),
    ("", "1", "", 1.0),
    (None, "1", None, 1.0),
    ("ml", None, "ml", None),
    ("mg", "not known", "g", None),
    ("mg", "10D", "g", None),
    ("mg", "nan", "g", None),
]


def test_unit_table(spark):
    rows = spark.createDataFrame(
        UNITS, "unit string, number string, to_unit string, to_number double"
    )
    for row in normalise_units(rows, ("number", "unit")).collect():
        assert (row.unit, row.number) == (row.to_unit, row.to_number)


def test_units_of_numeric_columns(spark):
    rows = spark.createDataFrame(
        [(2.0, "mg"), (float("nan"), "mg"), (None, "mg")], "number double, unit string"
    )
    found = [row.number for row in normalise_units(rows, ("number", "unit")).collect()]
    assert found == [0.002, None, None]


def test_normalising_twice_changes_nothing(spark):
    rows = spark.createDataFrame(
        UNITS, "unit string, number string, to_unit string, to_number double"
    )
    once = normalise_units(rows, ("number", "unit"))
    assert normalise_units(once, ("number", "unit")).collect() == once.collect()


def test_any_column_name_and_text(spark):
    rows = spark.createDataFrame([("5", "mg"), ("6", None)], "`the number` string, `a unit` string")
    found = normalise_units(rows, ("the number", "a unit"), null_unit="o'clock\\").collect()
    assert [tuple(r) for r in found] == [(0.005, "g"), (6.0, "o'clock\\")]


def test_missing_unit_option(spark):
    rows = spark.createDataFrame([("1", None)], "number string, unit string")
    found = normalise_units(rows, ("number", "unit"), null_unit="nan").first()
    assert found.unit == "nan"


def test_adq_sheet(spark):
    sheet = spark.createDataFrame(
        [
            ("A", "Seretide(60D)", "1,000", "mcg"),
            ("B", "Plain", None, "mg"),
            ("C", "Plain", "N/A", "mg"),
            ("D", "Plain", "10.5", None),
            ("E", None, "see note", " "),
        ],
        "code string, drug string, value string, unit string",
    )
    found = {r.bnf_code: r for r in normalised_adqs(sheet).collect()}
    assert sorted(found) == ["A", "D", "E"]
    assert (found["A"].adq_value, found["A"].adq_denominator) == (0.001, "g")
    assert found["A"].dose_multiplier == 60.0
    assert (found["D"].adq_value, found["D"].adq_denominator) == (10.5, "")
    assert (found["E"].adq_value, found["E"].adq_denominator) == (None, "")
    as_text = normalised_adqs(sheet, null_unit="nan").where("bnf_code = 'D'").first()
    assert as_text.adq_denominator == "nan"


# squ, form, form_indicator, form_units, unit_of_measure, expected
QUANTITY_UNITS = [
    ("ml", "Not applicable", "Discrete", None, "capsule", "ml"),
    ("individual", None, None, None, None, "individual"),
    ("", "Not applicable", "Discrete", None, "capsule", None),
    (None, "Capsule", "Not applicable", "litre", "capsule", None),
    (None, "Not applicable", None, "litre", "capsule", None),
    (None, "Cream", "Discrete", "litre", "tube", "g"),
    (None, "Foam", None, None, None, "g"),
    (None, "Bath additive", "Discrete", "litre", "bottle", "ml"),
    (None, "Capsule", "Discrete", "capsule", "capsule", "capsule"),
    (None, "Capsule", "Discrete", None, None, None),
    (None, "Oral suspension", "Discrete", "ml", "spoonful", "ml"),
    (None, "Oral suspension", "Continuous", "ml", "ml", "ml"),
    (None, None, None, None, None, "ml"),
]


def test_quantity_units(spark):
    rows = spark.createDataFrame(
        QUANTITY_UNITS,
        "squ string, form string, form_indicator string, form_units string, "
        "unit_of_measure string, expected string",
    )
    for row in rows.withColumn("found", quantity_unit()).collect():
        assert row.found == row.expected, row


BASE = {
    "bnf_name": "Thing_Tab 1.5g",
    "form_size": 2.0,
    "unit_of_measure": "tablet",
    "numerator": 0.5,
    "numerator_unit_of_measure": "g",
    "denominator_unit_of_measure": None,
    "ingredient_count": 1,
    "quantity_denominator": "unit",
    "adq_value": 1.0,
    "adq_denominator": "g",
    "dose_multiplier": "1",
}
# changes to BASE, amount in ADQ units, ADQs per quantity
BRANCHES = [
    ({"denominator_unit_of_measure": "hour"}, None, None),
    ({"denominator_unit_of_measure": "hour", "adq_denominator": "ml"}, 0.5, 0.5),
    ({"adq_denominator": "", "unit_of_measure": "unit dose"}, 2.0, 2.0),
    ({"adq_denominator": "dose", "unit_of_measure": "unit dose", "form_size": None}, None, None),
    ({"adq_denominator": "dose", "unit_of_measure": None}, 1.0, 1.0),
    ({"adq_denominator": None, "quantity_denominator": None}, 1.0, 1.0),
    ({}, 1.0, 1.0),
    ({"form_size": None}, 0.5, 0.5),
    ({"adq_denominator": "ml"}, 0.5, 0.5),
    ({"adq_denominator": "unit dose"}, 0.5, 0.5),
    ({"ingredient_count": 2}, 5.0, 5.0),
    ({"ingredient_count": None}, 5.0, 5.0),
    ({"ingredient_count": 2, "adq_denominator": "ml"}, None, None),
    ({"ingredient_count": 2, "adq_denominator": "mmol", "bnf_name": "X 7mmol 9mmol"}, 9.0, 9.0),
    ({"quantity_denominator": None}, 0.5, 0.5),
    ({"quantity_denominator": "ml", "ingredient_count": 3}, 0.5, 0.5),
    ({"numerator": 0.0}, 0.0, None),
    ({"numerator": None}, None, None),
    ({"adq_value": 0.0}, 1.0, None),
    ({"adq_value": None}, 1.0, None),
    ({"dose_multiplier": "60"}, 1.0, 60.0),
]


def test_every_branch_of_the_adq_rules(spark):
    schema = (
        "bnf_name string, form_size double, unit_of_measure string, numerator double, "
        "numerator_unit_of_measure string, denominator_unit_of_measure string, "
        "ingredient_count long, quantity_denominator string, adq_value double, "
        "adq_denominator string, dose_multiplier string, i int"
    )
    rows = [
        tuple({**BASE, **changes}.values()) + (i,)
        for i, (changes, _, _) in enumerate(BRANCHES)
    ]
    found = (
        spark.createDataFrame(rows, schema)
        .withColumn("amount", quantity_in_adq_units())
        .withColumn("adqs", adq_per_quantity())
        .collect()
    )
    for row in found:
        changes, amount, adqs = BRANCHES[row.i]
        assert (row.amount, row.adqs) == (amount, adqs), changes


@pytest.mark.parametrize(
    "name, unit, expected",
    [
        ("Maxepa_Cap 1g", "g", 1.0),
        ("Thing 1.5g", "g", 5.0),
        ("Thing 5g 20g", "g", 20.0),
        ("Thing 5mg", "g", None),
        ("Thing 30unit dose", "unit dose", 30.0),
        ("Thing 12mmol", "mmol", 12.0),
        ("Thing 12x(", "x(", None),
        (None, "g", None),
    ],
)
def test_strength_in_name(spark, name, unit, expected):
    row = spark.createDataFrame([(name, unit)], "name string, unit string")
    assert row.select(strength_from_name("name", "unit")).first()[0] == expected


def test_rounding_ties_to_even(spark):
    rows = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (None,)], "x double")
    found = [r[0] for r in rows.select(rounded_to_tenth("x")).collect()]
    assert found == [0.2, round(0.35 * 10) / 10, 2.5, None]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://host/a/b/PCA%20Jan%202018.xls", "PCA_Jan_2018.xls"),
        ("https://host/a/PCA.xls?x=/y#/z", "PCA.xls"),
        ("https://host/a/P CA[1].xls;v=1", "P CA[1].xls"),
        ("/relative/file.xlsx", "file.xlsx"),
        ("https://host", ""),
    ],
)
def test_file_names(spark, url, expected):
    row = spark.createDataFrame([(url,)], "url string")
    assert row.select(file_name_of_url("url")).first()[0] == expected


def test_rules_need_no_python_workers(spark):
    rows = spark.createDataFrame(golden.ROWS, golden.COLUMNS)
    plan = rows.select(adq_per_quantity(), F.col("label"))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan
