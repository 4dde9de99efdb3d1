"""How texts look: length, lines and markup, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse.functions.answers import annotation_count
from stillhouse.functions.metrics import rounded

#: Markup counted by the profile, as regexes Java and RE2 read the same way.
LATEX = r"\\\(|\\\[|\$\$|\\frac"
HEADING = r"(?m)^#{1,6} "
BOLD = r"\*\*[^*\n]+\*\*"


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def style_profile(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Averages per group over whole texts; sums are integers, so they are exact in any order."""
    t = F.col(text)
    measured = df.select(
        *by,
        F.length(t).cast("bigint").alias("chars"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)
        .cast("bigint")
        .alias("lines"),
        _hits(t, LATEX).alias("latex"),
        _hits(t, HEADING).alias("headings"),
        _hits(t, BOLD).alias("bold"),
        annotation_count(t).alias("annotations"),
    )
    parts = ["latex", "headings", "bold", "annotations"]
    return measured.groupBy(*by).agg(
        F.count("*").alias("texts"),
        rounded(F.sum("chars") / F.count("*"), 2).alias("avg_chars"),
        F.max("chars").alias("max_chars"),
        rounded(F.sum("lines") / F.count("*"), 2).alias("avg_lines"),
        *[F.sum(p).alias(p) for p in parts],
    )
