"""Month-by-month accumulation of standard quantity units."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dosequant.operators.dispensing import squ_latest, squ_pairs
from dosequant.schemas import DISPENSING, SQUS


def accumulate_squ_pairs(
    spark: SparkSession, directory: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Append the (bnf_code, squ) pairs not seen before from new dispensing files.

    Reads Parquet files with the columns of `DISPENSING`, handles what has arrived
    since the last run and ends. The pairs seen are kept as state: a few per code,
    whatever the number of months. `checkpoint` keeps the progress of this directory
    and output: a folder of its own that all executors share.
    """
    files = spark.readStream.schema(DISPENSING).parquet(directory)
    return (
        squ_pairs(files)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def accumulate_latest_squs(
    spark: SparkSession, directory: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Bring the table of the latest SQU per code up to date with new dispensing files.

    Reads Parquet files with the columns of `DISPENSING`, handles what has arrived
    since the last run and ends. Kept as state is one number per code, the greatest
    month with its unit code, so a file of an earlier month that comes late changes
    nothing, and of two units in one month the larger code counts, in whatever order
    files come.

    Each batch writes the whole table, a row per code, as a version of its own named
    by the batch, and then the version's number to the list that `latest_squs` reads.
    A batch that runs again after a failure writes the same rows to the same places,
    and a version that was not completed is not on the list. `checkpoint` is as in
    `accumulate_squ_pairs`.
    """

    def keep(squs: DataFrame, batch: int) -> None:
        squs.write.mode("overwrite").parquet(f"{output}/versions/{batch}")
        number = squs.sparkSession.range(batch, batch + 1).coalesce(1)
        number.write.mode("overwrite").parquet(f"{output}/published/batch={batch}")

    files = spark.readStream.schema(DISPENSING).parquet(directory)
    return (
        squ_latest(files)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )


def latest_squs(spark: SparkSession, output: str) -> DataFrame:
    """The last version that `accumulate_latest_squs` completed."""
    batch = spark.read.schema("id long").parquet(f"{output}/published").agg(F.max("id")).first()[0]
    return spark.read.schema(SQUS).parquet(f"{output}/versions/{batch}")
