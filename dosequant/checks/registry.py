"""One query per operator over the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosequant import operators as ops, plans
from dosequant.checks.testmap import relation
from dosequant.functions import dose_from_name, run_date_label, strength_from_name
from dosequant.sources.shared import written

LINK_HOST = "https://example.org"
LINK_PREFIXES = ("The", "the")
LINK_PART = "he"
LOOKUP_CODE = "B7"
CODE_PATTERN = "B1.*7"


class Inputs:
    """The relations and intermediate tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables: dict[str, DataFrame] = {}
        self.relations: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A test table; its files are listed once, however often it is used."""
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.tables[name]

    def relation(self, name: str) -> DataFrame:
        if name not in self.relations:
            self.relations[name] = relation(self.spark, self.table, name)
        return self.relations[name]

    def products(self) -> DataFrame:
        return ops.product_details(
            product=self.relation("dmd_product"),
            vmp=self.relation("dmd_vmp"),
            vpi=self.relation("dmd_vpi"),
            dform=self.relation("dmd_dform"),
            lookup_form=self.relation("lookup_form"),
            lookup_indicator=self.relation("lookup_indicator"),
            lookup_unit=self.relation("lookup_unit"),
        )

    def adqs(self) -> DataFrame:
        return ops.normalised_adqs(self.relation("adq_sheet"))

    def squs(self) -> DataFrame:
        return ops.squ_latest(self.relation("dispensing"))

    def adq_inputs(self) -> DataFrame:
        return plans.adq_inputs(self.products(), self.squs(), self.relation("adq_sheet"))

    def computed(self) -> DataFrame:
        return plans.computed_adqs(self.adq_inputs())

    def presentations(self) -> DataFrame:
        return plans.adq_by_presentation(self.computed())

    def comparison(self) -> DataFrame:
        provided = ops.representative_presentation(self.relation("prescribing"))
        return ops.usage_comparison(provided, self.presentations())


def normalised_units(i: Inputs) -> DataFrame:
    return ops.normalise_units(i.relation("unit_samples"), ("number", "unit"))


def normalised_products(i: Inputs) -> DataFrame:
    return ops.normalised_products(i.products())


def normalised_adqs(i: Inputs) -> DataFrame:
    return i.adqs()


def doses(i: Inputs) -> DataFrame:
    return i.relation("adq_sheet").select(
        "bnf_code", "bnf_name", dose_from_name("bnf_name").alias("doses")
    )


def strengths(i: Inputs) -> DataFrame:
    """Of every name in the sheet, also those without a value."""
    units = ops.normalise_units(
        i.relation("adq_sheet"), ("adq_value", "adq_denominator"), null_unit=""
    )
    return units.select(
        "bnf_code",
        "bnf_name",
        "adq_denominator",
        strength_from_name("bnf_name", "adq_denominator").alias("strength"),
    )


def quantity_units(i: Inputs) -> DataFrame:
    return i.computed().select(
        "bnf_code", "vpid", "form", "form_indicator", "form_units", "unit_of_measure",
        "squ", "quantity_denominator",
    )


def adq_per_quantity(i: Inputs) -> DataFrame:
    return i.computed().select(
        "bnf_code", "vpid", "form", "numerator", "numerator_unit_of_measure",
        "denominator_unit_of_measure", "adq_value", "adq_denominator",
        "quantity_denominator", "adq_per_quantity",
    )


def computed_as_coded(i: Inputs) -> DataFrame:
    """Every SQU pair, products without one dropped, missing ADQ units as text."""
    return plans.computed_adqs(
        plans.adq_inputs(
            i.products(),
            ops.squ_pairs(i.relation("dispensing")),
            i.relation("adq_sheet"),
            squ_join="inner",
            null_unit="nan",
        )
    )


def first_non_null(i: Inputs) -> DataFrame:
    products = ops.normalised_products(i.products())
    columns = [c for c in products.columns if c != "bnf_code"]
    return ops.first_non_null(products, "bnf_code", columns, columns)


def practice_usage(i: Inputs) -> DataFrame:
    # with its size known, the small table is broadcast from the start
    figures = written(i.presentations().select("bnf_code", "adq_per_quantity"), "figures")
    return ops.practice_usage(i.relation("prescribing"), figures)


def links(i: Inputs) -> DataFrame:
    return ops.page_links(i.table("pages"), LINK_HOST, LINK_PREFIXES, LINK_PART)


def date_labels(i: Inputs) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return (
        i.table("lineitem")
        .select(day.alias("run_date"))
        .distinct()
        .withColumn("label", run_date_label("run_date"))
    )


OPERATORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "normalised_units": normalised_units,
    "normalised_products": normalised_products,
    "normalised_adqs": normalised_adqs,
    "dose_from_name": doses,
    "strength_from_name": strengths,
    "quantity_units": quantity_units,
    "adq_inputs": Inputs.adq_inputs,
    "adq_per_quantity": adq_per_quantity,
    "computed_adqs": Inputs.computed,
    "computed_adqs_as_coded": computed_as_coded,
    "first_non_null": first_non_null,
    "adq_by_presentation": Inputs.presentations,
    "ingredient_counts": lambda i: ops.ingredient_counts(i.relation("dmd_vpi")),
    "product_details": Inputs.products,
    "squ_pairs": lambda i: ops.squ_pairs(i.relation("dispensing")),
    "squ_latest": Inputs.squs,
    "squ_lookup_key": lambda i: ops.squ_of(i.squs(), LOOKUP_CODE),
    "representative_presentation": lambda i: ops.representative_presentation(
        i.relation("prescribing")
    ),
    "usage_comparison": Inputs.comparison,
    "usage_delta": lambda i: ops.usage_delta(i.comparison()),
    "high_usage": lambda i: ops.high_usage(ops.usage_delta(i.comparison())),
    "qa_summary": lambda i: ops.qa_summary(i.comparison(), CODE_PATTERN),
    "reject_report": lambda i: ops.reject_report(
        i.relation("adq_sheet"), i.relation("dispensing")
    ),
    "practice_usage": practice_usage,
    "back_computed": lambda i: ops.back_computed(i.relation("prescribing")),
    "field_values": lambda i: ops.field_values(i.products()),
    "preview": lambda i: ops.preview(i.presentations(), "bnf_code"),
    "page_links": links,
    "link_file_names": lambda i: ops.link_file_names(links(i)),
    "run_date_label": date_labels,
}


def as_query(operator: Callable[[Inputs], DataFrame]):
    return lambda spark, sf_dir: operator(Inputs(spark, sf_dir))


QUERIES = {name: as_query(operator) for name, operator in OPERATORS.items()}
