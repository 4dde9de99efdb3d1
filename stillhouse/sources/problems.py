"""Problem sets: question, answer and the row index everything else refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROBLEM_SCHEMA = "idx bigint, split string, question string, answer string"


def read_problems(
    spark: SparkSession, path: str, split: str | None = None, file_format: str = "parquet"
) -> DataFrame:
    """Scan a problem set that carries its index; the split filter reaches the scan."""
    problems = spark.read.schema(PROBLEM_SCHEMA).format(file_format).load(path)
    return problems if split is None else problems.where(F.col("split") == split)


def read_raw_problems(
    spark: SparkSession, path: str, split: str, file_format: str = "json"
) -> DataFrame:
    """Scan a set of plain ``question, answer`` rows and number them in file order."""
    raw = spark.read.schema("question string, answer string").format(file_format).load(path)
    return index_rows(raw).select("idx", F.lit(split).alias("split"), "question", "answer")


def index_rows(scan: DataFrame, name: str = "idx") -> DataFrame:
    """Dense 0-based row numbers in the order of files by path and of rows in each file.

    Rows are numbered within their stretch of a file and shifted by the counts of the stretches
    before it, in the order of path and start: Spark deals stretches to tasks by size, so the
    number of a task says nothing. The shift table has one row per stretch and is broadcast: few
    stretches would send all rows to few tasks. Use it straight on a scan, and write the result
    before building on it.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_place")
    # The id grows along a task, which reads a stretch from its beginning to its end.
    own = scan.select(place, F.monotonically_increasing_id().alias("_row"), *scan.columns)
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        own.groupBy("_place")
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        .select("_place", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    return own.join(F.broadcast(shifts), "_place").select(
        (F.col("_row") - F.col("_first") + F.col("_shift")).alias(name), *scan.columns
    )


def write_problems(problems: DataFrame, path: str) -> None:
    problems.write.mode("overwrite").partitionBy("split").parquet(path)
