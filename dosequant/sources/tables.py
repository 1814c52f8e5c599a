"""Readers of CSV tables with missing-value texts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from dosequant.functions.text import null_if_token, number_sql

WHOLE_NUMBER = r"^\s*[+-]?[0-9]+([.]0*)?\s*$"


def csv_reader(spark: SparkSession, multi_line: bool = False):
    # Quotes inside quoted cells are doubled, not escaped with a backslash.
    return spark.read.option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def whole_number_sql(text: str, kind: str) -> str:
    """A whole number, also if written as 1.0; NULL for any other text."""
    return f"CASE WHEN rlike({text}, r'{WHOLE_NUMBER}') THEN try_cast(try_cast({text} AS decimal(38, 6)) AS {kind}) END"


def _typed(text: str, kind: DataType) -> Column:
    """A cell as its column's type; NULL if it is missing or not of that type."""
    cell = f"nullif({text}, '')"
    if isinstance(kind, (LongType, IntegerType)):
        typed = F.expr(whole_number_sql(cell, kind.simpleString()))
    elif isinstance(kind, DoubleType):
        typed = F.expr(number_sql(cell))
    else:
        typed = F.expr(cell).try_cast(kind) if not isinstance(kind, StringType) else F.expr(text)
    return F.when(null_if_token(text).isNotNull(), typed)


def typed_cells(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema` by name, missing-value texts as NULL, as its types.

    A cell that is not of its column's type is NULL as well; `unreadable_cells`
    counts those. Whole numbers may be written as 1.0, numbers with commas.
    """
    return df.select(*[_typed(f"`{f.name}`", f.dataType).alias(f.name) for f in schema])


def unreadable_cells(df: DataFrame, schema: StructType) -> DataFrame:
    """How many cells of each column of a table of texts are not of its type."""
    counts = df.agg(
        *[
            F.count_if(null_if_token(f"`{f.name}`").isNotNull() & _typed(f"`{f.name}`", f.dataType).isNull()).alias(f.name)
            for f in schema
        ]
    )
    return counts.unpivot([], counts.columns, "column", "n")


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file or directory with headings as a table of texts.

    The headings of one file hold for all; a file with other ones, or with the same
    ones in another order, fails when it is read. Cells with line breaks need
    `multi_line`, which reads each file in one task.
    """
    names = csv_reader(spark, multi_line).option("header", True).csv(path).columns
    text = StructType([StructField(name, StringType()) for name in names])
    reader = csv_reader(spark, multi_line).schema(text).option("enforceSchema", False)
    return reader.option("header", True).csv(path)


class CsvTable:
    """A table in CSV files, with what reading it as `schema` has to leave out.

    `texts` are its cells as they are written. Kept as a table, they give both the
    typed rows and the rejects without reading the files again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, multi_line: bool = False, by_position: bool = False):
        self.spark, self.path, self.schema = spark, path, schema
        self.multi_line, self.by_position = multi_line, by_position

    def texts(self) -> DataFrame:
        found = read_csv_text(self.spark, self.path, self.multi_line)
        return found.toDF(*self.schema.names) if self.by_position else found.select(*[f"`{c}`" for c in self.schema.names])

    def table(self, texts: DataFrame | None = None) -> DataFrame:
        return typed_cells(texts or self.texts(), self.schema)

    def rejects(self, texts: DataFrame | None = None) -> DataFrame:
        """(column, n): cells that are not of their column's type."""
        return unreadable_cells(texts or self.texts(), self.schema)


def read_csv_table(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False
) -> DataFrame:
    """A CSV file or directory with headings, whose further columns are ignored.

    Columns are found by heading, so a leading row index or another order of
    columns does no harm, as long as all files have the same headings. Types are
    declared, never inferred: that would read the data twice and could differ from
    one delivery to the next.
    """
    return CsvTable(spark, path, schema, multi_line).table()


def read_adq_sheet(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False
) -> DataFrame:
    """A CSV sheet whose columns are taken by position and renamed to `schema`."""
    return CsvTable(spark, path, schema, multi_line, by_position=True).table()
