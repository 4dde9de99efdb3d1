"""Column expressions the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of these characters separate words (fixed value of the contracts).
SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def keyed_text(frame: DataFrame, id_col: str, text_col: str, more: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, more``: NULL texts are empty; the columns in ``more`` are one struct.

    Columns not named are left behind, so none clashes with those that an operator makes.
    """
    carried = F.struct(*more) if more else F.lit(None).cast("string")
    return frame.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        carried.alias("more"),
    )
