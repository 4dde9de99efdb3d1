"""Generation statistics as ``Key: value`` text, one directory per teacher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.functions.metrics import fixed_text

# The keys of a statistics text, in file order.
STATS_KEYS = (
    "Teacher",
    "Total examples",
    "Successful",
    "Errors",
    "Success rate",
    "Total time",
    "Output file",
)


def stats_lines(stats: DataFrame, output_path: str) -> DataFrame:
    """``teacher, line_no, value`` with seven lines per teacher."""
    values = (
        F.upper("teacher"),
        F.col("total").cast("string"),
        F.col("successful").cast("string"),
        F.col("errors").cast("string"),
        F.concat(fixed_text(F.col("success_rate"), 2), F.lit("%")),
        F.concat(fixed_text(F.col("minutes"), 1), F.lit(" minutes")),
        F.concat(F.lit(output_path + "/teacher="), "teacher"),
    )
    lines = [F.concat(F.lit(k + ": "), v) for k, v in zip(STATS_KEYS, values)]
    return stats.select("teacher", F.posexplode(F.array(*lines)).alias("line_no", "value"))


def write_stats(lines: DataFrame, path: str) -> None:
    """One text per teacher; those of other teachers stay.

    The lines of a teacher come from one row, so they stay in order.
    """
    (
        lines.select("teacher", "value")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("teacher")
        .text(path)
    )


def scan_stats(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all statistics texts under ``path`` with the file they stand in."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )


def parse_stats(lines: DataFrame, by: str = "file") -> DataFrame:
    """Typed rows from ``Key: value`` lines, one per text."""
    parts = lines.select(
        by,
        F.regexp_extract("value", r"^([^:]+): (.*)$", 1).alias("key"),
        F.regexp_extract("value", r"^([^:]+): (.*)$", 2).alias("v"),
    )
    wide = parts.groupBy(by).pivot("key", list(STATS_KEYS)).agg(F.first("v"))

    def number(key: str, unit: str, kind: str):
        return F.replace(F.col(key), F.lit(unit), F.lit("")).try_cast(kind)

    return wide.select(
        F.lower("Teacher").alias("teacher"),
        F.col("Total examples").try_cast("bigint").alias("total"),
        F.col("Successful").try_cast("bigint").alias("successful"),
        F.col("Errors").try_cast("bigint").alias("errors"),
        number("Success rate", "%", "double").alias("success_rate"),
        number("Total time", " minutes", "double").alias("minutes"),
        F.col("Output file").alias("output_file"),
    )
