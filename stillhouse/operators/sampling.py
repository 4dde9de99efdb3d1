"""Row subsets that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse import fixed

#: Hex digits of a rank that are compared with an estimate.
_DIGITS = 13
#: Width of the band around the estimated last rank, in square roots of the sample and rows.
_ROOTS, _ROWS = 5, 20
#: Growth of the band when the last rank was not in it.
_WIDEN = 8


def first_n(df: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """Rows whose dense 0-based index is below ``n``; a filter the scan can use, not a limit."""
    return df.where(F.col(order) < n)


def _hex(share: float) -> str:
    """Rank below which about that share of all ranks lies; above all of them from 1 on."""
    return "g" if share >= 1 else f"{int(max(share, 0.0) * 16**_DIGITS):0{_DIGITS}x}"


def seeded_sample(
    df: DataFrame, n: int, seed: int = fixed.SEED, key: str = "idx"
) -> DataFrame:
    """``n`` rows in a seeded pseudo-random choice: those with the smallest ``md5(seed:key)``.

    ``key`` is unique. Ranks are spread evenly, so the last one of the sample is about ``n`` of all
    rows up the scale. One scan of the keys counts the ranks surely below it and sorts those in a
    band around it, some square roots of ``n``; the last rank is read off there. If it isn't in the
    band, the band is widened. The rows are then a filter on their own rank with a constant: no row is
    shuffled and no task holds the sample, whatever ``n``.
    """

    def rank(column: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))

    if n <= 0:
        return df.where(F.lit(False))
    total = df.count()
    if total <= n:
        return df
    ranked = df.select(F.struct(rank(F.col(key)).alias("rank"), F.col(key).alias("key")).alias("own"))
    width = _ROOTS * n**0.5 + _ROWS
    while True:
        low, high = F.lit(_hex((n - width) / total)), F.lit(_hex((n + width) / total))
        in_band = (F.col("own.rank") >= low) & (F.col("own.rank") < high)
        seen = ranked.agg(
            F.count_if(F.col("own.rank") < low).alias("below"),
            F.sort_array(F.collect_list(F.when(in_band, F.col("own")))).alias("band"),
        )
        last = seen.select(F.when(F.col("below") < n, F.get("band", n - 1 - F.col("below"))).alias("last")).first()[0]
        if last is not None:
            break
        width *= _WIDEN
    own = rank(F.col(key))
    return df.where((own < last["rank"]) | ((own == last["rank"]) & (F.col(key) <= F.lit(last["key"]))))


def one_random_row(df: DataFrame, seed: int = fixed.SEED, key: str = "idx") -> DataFrame:
    return seeded_sample(df, 1, seed, key)
