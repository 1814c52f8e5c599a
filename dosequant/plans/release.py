"""A whole run: every table of one release, written and read back in turn."""

import time
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosequant.operators.dispensing import squ_latest
from dosequant.operators.prescribing import practice_usage, representative_presentation
from dosequant.operators.products import product_details
from dosequant.operators.quality import (
    high_usage,
    qa_summary,
    reject_report,
    usage_comparison,
    usage_delta,
)
from dosequant.plans.presentations import adq_by_presentation, adq_inputs, computed_adqs
from dosequant.sources.monthly import MonthlyFiles
from dosequant.sources.sinks import dated_path
from dosequant.sources.tables import CsvTable


class Release:
    """The tables of one run date below a shared folder.

    Each table is written once and later steps read it from there, so that no step
    computes another's work again and a lost executor costs no more than the tasks
    it was running.

    A run writes below a folder of its own. Its last step adds one row to the list
    of published runs, and readers take the last run published for the date, so they
    see all tables of one run or of the one before, also if a run stops half-way.
    With `csv=True` every table is written as CSV with headings as well.

    Inputs are DataFrames, or `MonthlyFiles` and `CsvTable`. The cells of those are
    read once and kept as a table of texts, and what they hold that cannot be read
    is reported beside what the rules cannot use.
    """

    def __init__(self, spark: SparkSession, folder: str, run_date: date, csv: bool = False):
        self.spark, self.folder, self.run_date, self.csv = spark, folder, run_date, csv
        self.run_id: str | None = None

    @property
    def _published(self) -> str:
        return dated_path(f"{self.folder}/published", self.run_date)

    def path(self, name: str, file_format: str = "parquet") -> str:
        """Where a table of the run under way is, or else of the last one published."""
        run_id = self.run_id
        if run_id is None:
            runs = self.spark.read.schema("run_id string, published_at long").parquet(self._published)
            run_id = runs.orderBy(F.desc("published_at"), "run_id").first()["run_id"]
        return f"{dated_path(f'{self.folder}/runs', self.run_date)}/{run_id}/{file_format}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(name))
        kept = self.read(name)
        if self.csv:
            kept.write.option("header", True).option("escape", '"').csv(self.path(name, "csv"))
        return kept

    def publish(self) -> None:
        row = [(self.run_id, time.time_ns())]
        rows = self.spark.createDataFrame(row, "run_id string, published_at long")
        rows.coalesce(1).write.mode("append").parquet(self._published)

    def run(
        self,
        dictionary: dict[str, DataFrame | CsvTable],
        dispensing: DataFrame | MonthlyFiles,
        prescribing: DataFrame | CsvTable,
        adq_sheet: DataFrame | CsvTable,
        squ_join: str = "left",
        null_unit: str | None = "",
        squs: Callable[[DataFrame], DataFrame] = squ_latest,
    ) -> DataFrame:
        """Write and publish all tables; the outcome is the one-row quality report.

        `dictionary` holds the arguments of `product_details`. `squs` makes the SQU
        table of the dispensing rows: `squ_latest`, or `squ_pairs` for every pair.
        The table `rejects` counts, for each kind, what could not be read or used; of
        the cells of a `CsvTable` as `<input>.<column>_unreadable`.
        """
        self.run_id = uuid.uuid4().hex
        try:
            summary = self._tables(dictionary, dispensing, prescribing, adq_sheet, squ_join, null_unit, squs)
            self.publish()
            return summary
        finally:
            self.run_id = None

    def _input(self, name: str, source: DataFrame | CsvTable | MonthlyFiles, rejects: list[DataFrame]) -> DataFrame:
        """The rows of an input; what its cells cannot tell is added to `rejects`."""
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, MonthlyFiles):
            cells = self.keep(f"texts_{name}", source.counted())
            rejects.append(source.rejects(cells))
            return source.dispensing(cells)
        texts = self.keep(f"texts_{name}", source.texts())
        reject = F.concat(F.lit(f"{name}."), F.col("column"), F.lit("_unreadable"))
        rejects.append(source.rejects(texts).select(reject.alias("reject"), "n"))
        return source.table(texts)

    def _tables(self, dictionary, dispensing, prescribing, adq_sheet, squ_join, null_unit, squs):
        rejects: list[DataFrame] = []
        dictionary = {name: self._input(name, source, rejects) for name, source in dictionary.items()}
        dispensing = self._input("dispensing", dispensing, rejects)
        prescribing = self._input("prescribing", prescribing, rejects)
        adq_sheet = self._input("adq_sheet", adq_sheet, rejects)
        products = self.keep("products", product_details(**dictionary))
        squs = self.keep("squs", squs(dispensing))
        provided = self.keep("provided_adqs", representative_presentation(prescribing))
        inputs = adq_inputs(products, squs, adq_sheet, squ_join, null_unit)
        computed = self.keep("computed_adqs", computed_adqs(inputs))
        presentations = self.keep("presentations", adq_by_presentation(computed))
        comparison = self.keep("comparison", usage_comparison(provided, presentations))
        delta = self.keep("delta", usage_delta(comparison))
        self.keep("high", high_usage(delta))
        self.keep("practice_usage", practice_usage(prescribing, presentations))
        found = reject_report(adq_sheet, dispensing)
        for more in rejects:
            # what a row cannot tell may be counted with the row as well
            found = found.unionByName(more.join(found, "reject", "left_anti"))
        self.keep("rejects", found)
        return self.keep("qa_summary", qa_summary(comparison))
