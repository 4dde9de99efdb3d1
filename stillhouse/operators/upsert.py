"""Keyed replacement and concatenation of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the one with the highest ``seq``."""
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "teacher", seq: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` added, replacing those of equal key.

    With several new rows per key name the column ``seq`` that tells which is last. Both sides
    are read once: an anti join would compute ``new``, often a long job, a second time.
    """
    turn = F.struct(F.lit(1).alias("new"), (F.col(seq) if seq else F.lit(0)).alias("seq"))
    before = F.struct(F.lit(0).alias("new"), F.lit(None).cast(_type(new, seq)).alias("seq"))
    both = old.withColumn("_turn", before).unionByName(new.select(*old.columns, turn.alias("_turn")))
    return latest(both, key, "_turn").drop("_turn")


def _type(df: DataFrame, column: str | None):
    return df.schema[column].dataType if column else "int"


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
