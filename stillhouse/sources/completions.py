"""Completions, one partition directory per teacher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.sources.problems import index_rows

COMPLETION_SCHEMA = (
    "idx bigint, question string, answer string, synthetic_answer string, teacher string"
)


def write_completions(completions: DataFrame, path: str) -> None:
    """Replace the written teachers, keep the directories of the others.

    Every task writes what it holds; nothing is shuffled to get one file per teacher, because
    one teacher may hold a third of the rows.
    """
    (
        completions.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("teacher")
        .parquet(path)
    )


def read_teacher_file(spark: SparkSession, path: str) -> DataFrame:
    """Scan completions kept as plain rows in problem order and number them by that order."""
    schema = "question string, answer string, synthetic_answer string, teacher string"
    return index_rows(spark.read.schema(schema).parquet(path))


def read_completions(
    spark: SparkSession, path: str, teachers: list[str] | None = None
) -> DataFrame:
    """Scan the completions of some teachers; other directories are not listed as input."""
    completions = spark.read.schema(COMPLETION_SCHEMA).parquet(path)
    return completions if teachers is None else completions.where(F.col("teacher").isin(teachers))
