"""Monthly dispensing files: where their headings are, their rows, and what was left out."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dosequant.functions.text import null_if_token, sql_text
from dosequant.sources.tables import csv_reader, whole_number_sql

MONTHLY_GLOB = "PCA*"
MONTHLY_HEADINGS = {
    "bnf_code": "BNF Code",
    "squ_code": "Standard Quantity Unit",
    "preparation_class": "Preparation Class",
}
NEEDED = ("bnf_code", "squ_code")

# A cell after a comma: in quotes, which are doubled within, or up to the next comma.
CELL = r''',(\s*"(?:[^"]|"")*"|[^,]*)'''


def month_of_file(file_name: Column) -> Column:
    """First day of the month named in a file name, else NULL.

    Reads `PCA_Sept_2018`, `PCA Sept18`, `PCA_2018_Sept` and `PCA_201809`; a month's
    name counts only if it is a word of its own.
    """
    # File names come with spaces written as %20.
    name = F.lower(F.replace(file_name, F.lit("%20"), F.lit(" ")))
    word = (
        r"(?<![a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
        r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?(?![a-z])"
    )
    forms = [  # pattern, groups of month and year, format
        (rf"{word}[^a-z0-9]*([0-9]{{4}}|[0-9]{{2}})(?![0-9])", 1, 2, "MMM"),
        (rf"(?<![0-9])([0-9]{{4}})[^a-z0-9]*{word}", 2, 1, "MMM"),
        (r"(?<![0-9])((?:19|20)[0-9]{2})[-_. ]?(0[1-9]|1[0-2])(?![0-9])", 2, 1, "MM"),
    ]
    found = []
    for pattern, month_at, year_at, form in forms:
        month = F.initcap(F.regexp_extract(name, pattern, month_at))
        year = F.regexp_extract(name, pattern, year_at)
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        found.append(F.try_to_timestamp(F.concat_ws(" ", month, year), F.lit(f"{form} yyyy")))
    return F.coalesce(*found).cast("date")


class Layout(NamedTuple):
    """Where a file has its columns, and where the line that says so is."""

    places: dict[str, int]
    block: int | None = None
    nth: int | None = None


def _lines(spark: SparkSession, directory: str) -> DataFrame:
    """All lines, with the split of the file they are in and their number in it.

    Lines of one split are read in order by one task, so (block, nth) is the order
    of lines within a file, also where a large file is read by many tasks.
    """
    files = spark.read.option("pathGlobFilter", MONTHLY_GLOB).text(directory)
    return files.select(
        "_metadata.file_path",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
    )


def _split_by(spark: SparkSession) -> tuple:
    """What decides how files are cut into splits, and with it the numbers of lines."""
    settings = ("files.maxPartitionBytes", "files.openCostInBytes", "files.minPartitionNum", "files.maxPartitionNum", "leafNodeDefaultParallelism")
    return spark.sparkContext.defaultParallelism, *[spark.conf.get(f"spark.sql.{name}", None) for name in settings]


def _cells_of_line(line: str) -> str:
    """The cells of a line as an array, without quotes and surrounding white space."""
    cells = f"regexp_extract_all(concat(',', replace({line}, '\\uFEFF', '')), {sql_text(CELL)}, 1)"
    bare = "btrim(c, ' \\t')"
    unquoted = f"IF({bare} LIKE '\"%\"' AND length({bare}) > 1, replace(substring({bare}, 2, length({bare}) - 2), '\"\"', '\"'), {bare})"
    return f"transform({cells}, c -> btrim({unquoted}, ' \\t'))"


def _headings(spark: SparkSession, directory: str) -> DataFrame:
    """The first line of each file that has the needed headings as cells.

    Only lines that hold both texts anywhere are taken apart, and only lines with
    the headings, a few per file, go on to be compared.
    """
    names = [sql_text(MONTHLY_HEADINGS[c]) for c in NEEDED]
    holds = " AND ".join(f"contains(value, {name})" for name in names)
    cells = f"CASE WHEN {holds} THEN {_cells_of_line('value')} END"
    found = _lines(spark, directory).withColumn("cells", F.expr(cells)).where(
        " AND ".join(f"array_contains(cells, {name})" for name in names)
    )
    return found.groupBy("file_path").agg(F.min(F.struct("block", "nth", "cells")).alias("first"))


def file_paths(spark: SparkSession, directory: str) -> list[str]:
    """The monthly files of a directory, whose content is not read for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", MONTHLY_GLOB).load(directory)
    return sorted(r["file_path"] for r in files.select("_metadata.file_path").collect())


def find_layouts(spark: SparkSession, directory: str) -> dict[str, Layout | None]:
    """The layout of each CSV file of a directory, by its first line with the needed
    headings as cells of their own, wherever that is; None for a file without one.

    One row per file reaches the driver, which lists the files anyway.
    """
    layouts: dict[str, Layout | None] = dict.fromkeys(file_paths(spark, directory))
    for r in _headings(spark, directory).collect():
        first = r["first"]
        places = {c: first["cells"].index(h) for c, h in MONTHLY_HEADINGS.items() if h in first["cells"]}
        layouts[r["file_path"]] = Layout(places, first["block"], first["nth"])
    return layouts


def monthly_layouts(spark: SparkSession, directory: str) -> dict[str, dict[str, int] | None]:
    """Where each CSV file of a directory has its columns; None for a file that does
    not say."""
    return {path: layout and layout.places for path, layout in find_layouts(spark, directory).items()}


class MonthlyFiles:
    """All monthly dispensing files of a directory, and what reading them leaves out.

    Parquet files have their columns by heading. CSV files start with a banner and
    may order their columns differently; each file's first line with the needed
    headings as cells tells where its cells are, and what stands above it is no row.
    A file without one fails, or is left out with `without_headings="skip"`. Finding
    the headings reads all lines once; a `layout` of column positions (from 0) that
    holds for all files saves that. `multi_line` allows line breaks in cells, with a
    task per file; what stands above the headings then is told by its cells only.

    `cells` are the needed cells as texts. `counted` has each combination of them
    once per file, with the number of rows `n`; kept as a table it gives the rows
    and the rejects, both by one scan of the files, and counts stay right when a
    lost task runs again.
    """

    def __init__(
        self, spark: SparkSession, directory: str, file_format: str = "csv",
        layout: dict[str, int] | None = None, without_headings: str = "fail", multi_line: bool = False,
    ):
        self.spark, self.directory, self.file_format = spark, directory, file_format
        self.multi_line = multi_line
        self._split_by = _split_by(spark)
        self.layouts: dict[str, Layout | None] | None = None
        if file_format != "parquet":
            self.layouts = find_layouts(spark, directory) if layout is None else {"": Layout(layout)}
            without = sorted(path for path, found in self.layouts.items() if found is None)
            if without and without_headings == "fail":
                raise ValueError(f"no headings {list(MONTHLY_HEADINGS.values())} in {without}")

    def cells(self) -> DataFrame:
        """The needed cells of all files as texts, with their file."""
        if self.layouts is None:
            files = self.spark.read.option("pathGlobFilter", MONTHLY_GLOB).parquet(self.directory)
            return files.select(
                F.col("_metadata.file_path").alias("file_path"),
                *[F.col(h).cast("string").alias(c) for c, h in MONTHLY_HEADINGS.items()],
            )
        if "" not in self.layouts and self._split_by != _split_by(self.spark):  # lines have other numbers now
            self.layouts, self._split_by = find_layouts(self.spark, self.directory), _split_by(self.spark)
        known = {path: found for path, found in self.layouts.items() if found}
        width = 1 + max((at for found in known.values() for at in found.places.values()), default=0)
        columns = [f"_c{i}" for i in range(width)]
        schema = StructType([StructField(c, StringType()) for c in columns])
        places = [(path, found.block, found.nth, *[found.places.get(c) for c in MONTHLY_HEADINGS]) for path, found in known.items()]
        kinds = "file_path string, head_block long, head_nth long, " + ", ".join(f"at_{c} int" for c in MONTHLY_HEADINGS)
        if "" in known:  # one layout for all
            rows = self._records(schema, columns)
            rows = rows.withColumns({f"at_{c}": F.lit(known[""].places.get(c)).cast("int") for c in MONTHLY_HEADINGS})
        else:
            layouts = self.spark.createDataFrame(places, kinds)
            if self.multi_line:
                rows = self._records(schema, columns).join(layouts, "file_path")
            else:
                below = "block > head_block OR (block = head_block AND nth > head_nth)"
                record = F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"quote": '"', "escape": '"'})
                rows = _lines(self.spark, self.directory).join(layouts, "file_path").where(below)
                rows = rows.withColumn("record", record).withColumn("cells", F.array(*[f"record.{c}" for c in columns]))
        return rows.select(
            "file_path", *[F.get("cells", F.col(f"at_{c}")).alias(c) for c in MONTHLY_HEADINGS]
        ).where(f"NOT trim(bnf_code) <=> {sql_text(MONTHLY_HEADINGS['bnf_code'])}")

    def _records(self, schema: StructType, columns: list[str]) -> DataFrame:
        reader = csv_reader(self.spark, self.multi_line).schema(schema).option("pathGlobFilter", MONTHLY_GLOB)
        return reader.csv(self.directory).select("_metadata.file_path", F.array(*columns).alias("cells"))

    def counted(self) -> DataFrame:
        cells = self.cells()
        return cells.groupBy(*cells.columns).agg(F.count("*").alias("n"))

    def dispensing(self, cells: DataFrame | None = None) -> DataFrame:
        """The dispensing rows of `cells`, with their `n` if that has it.

        Rows without a code or a unit code, banners and headings among them, are
        dropped. A row whose unit code is no whole number stays, without one, and is
        counted by `reject_report`; so does one without preparation class or month.
        """
        cells = self.cells() if cells is None else cells
        return (
            cells.where(null_if_token("squ_code").isNotNull())
            .select(
                null_if_token("bnf_code").alias("bnf_code"),
                F.expr(whole_number_sql("squ_code", "int")).alias("squ_code"),
                F.expr(whole_number_sql("preparation_class", "int")).alias("preparation_class"),
                month_of_file(F.element_at(F.split("file_path", "/"), -1)).alias("month"),
                *["n"] * ("n" in cells.columns),
            )
            .where("bnf_code IS NOT NULL")
        )

    def rejects(self, counted: DataFrame | None = None) -> DataFrame:
        """What `dispensing` leaves out or reads as missing, as rows (reject, n): cells
        that are no whole numbers, rows without a unit code, undated files with any
        row, and files without headings."""
        counted = self.counted() if counted is None else counted
        rows = counted.where(null_if_token("bnf_code").isNotNull())
        wrong = lambda c: null_if_token(c).isNotNull() & F.expr(whole_number_sql(c, "int")).isNull()
        month = month_of_file(F.element_at(F.split("file_path", "/"), -1))
        of_files = rows.groupBy("file_path").agg(
            *[
                F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
                for name, condition in {
                    "squ_code_unreadable": wrong("squ_code"),
                    "squ_code_missing": null_if_token("squ_code").isNull(),
                    "preparation_class_unreadable": wrong("preparation_class"),
                }.items()
            ]
        )
        bare = sum(found is None for found in (self.layouts or {}).values())
        names = ("squ_code_unreadable", "squ_code_missing", "preparation_class_unreadable")
        counts = of_files.agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
            F.count_if(month.isNull()).alias("file_undated"),
            F.lit(bare).cast("long").alias("file_without_headings"),
        )
        return counts.unpivot([], counts.columns, "reject", "n")


def read_monthly(
    spark: SparkSession, directory: str, file_format: str = "csv",
    layout: dict[str, int] | None = None, without_headings: str = "fail", multi_line: bool = False,
) -> DataFrame:
    """All monthly dispensing files of a directory as one table, with their month; see
    `MonthlyFiles`."""
    return MonthlyFiles(spark, directory, file_format, layout, without_headings, multi_line).dispensing()


def monthly_rejects(
    spark: SparkSession, directory: str, file_format: str = "csv",
    layout: dict[str, int] | None = None, multi_line: bool = False,
) -> DataFrame:
    """What `read_monthly` leaves out or reads as missing, as rows (reject, n)."""
    return MonthlyFiles(spark, directory, file_format, layout, "skip", multi_line).rejects()
