"""Date-stamped output."""

from datetime import date

from pyspark.sql import DataFrame


def dated_path(path: str, run_date: date) -> str:
    """The folder of one run date, which readers of `path` see as a partition."""
    return f"{path}/run_date={run_date.isoformat()}"


def write_dated(
    df: DataFrame, path: str, run_date: date, file_format: str = "parquet"
) -> None:
    """Write `df` as the `run_date` partition of the table at `path`.

    Running a day again replaces that day only, also if nothing is left to write.
    CSV files get headings; no row index is written, as rows of a distributed
    table have no position.
    """
    writer = df.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(dated_path(path, run_date))
