"""Running totals and positions over long ordered groups.

A window over ``partitionBy(teacher)`` has as many tasks as there are teachers, and one of
them sorts a third of the log. Here a group is cut into blocks; windows run per block and only
one row per block is carried along the whole group. Where positions are dense, a block is a
stretch of them. Where they have gaps, the rows are dealt to ranges that hold about equally
many of them, whatever the values are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.functions.metrics import div
from stillhouse.sources.shared import new_path

#: Positions per block. A block is one window group and stays below the row count up to which
#: Spark keeps a group in memory.
BLOCK_POSITIONS = 4_000
#: Blocks of a group at most; beyond that blocks get longer. The rows carried along a group.
MOST_BLOCKS = 20_000
#: Positions per row up to which stretches of positions serve as blocks.
MOST_POSITIONS_PER_ROW = 8
#: Rows of one partition take these bits of a monotonically increasing id.
_ROW_BITS = 33


#: Buckets per row asked for in which the first rows of a group are looked for.
_BUCKETS_PER_ROW = 16


class Spread(NamedTuple):
    """How the positions of a table lie: smallest and largest first position of a group, positions
    of the longest group, and positions per row of the sparsest one."""

    lowest: int
    highest: int
    longest: int
    per_row: float

    @property
    def dense(self) -> bool:
        return self.per_row <= MOST_POSITIONS_PER_ROW

    @property
    def plain(self) -> bool:
        """Every group has all positions from the same first one on."""
        return self.per_row == 1 and self.lowest == self.highest


#: Consecutive numbers, as those of blocks.
CONSECUTIVE = Spread(0, 0, 0, 1.0)


def spread_of(df: DataFrame, keys: Sequence[str], order: str) -> Spread:
    """Looks at the keys and positions of the whole table and brings back one row."""
    span = (F.max(order) - F.min(order) + 1).alias("span")
    groups = df.groupBy(F.struct(*keys).alias("_group")).agg(
        F.min(order).alias("first"), span, F.count("*").alias("rows")
    )
    seen = groups.agg(
        F.min("first"), F.max("first"), F.max("span"), F.max(F.col("span") / F.col("rows"))
    ).first()
    return CONSECUTIVE if seen[0] is None else Spread(*seen)


def in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], partitions: int | None = None
) -> DataFrame:
    """``df`` in the order of ``keys`` and ``order``, with ``_part`` and the place ``_row`` in it.

    Spark samples the rows and cuts the order into ranges of about equal numbers of rows, so
    neither a frequent key nor a gap in the order makes a large part; only rows equal in all of
    ``keys`` and ``order`` have to stay together. The table is written once: what is computed
    from the parts and what is joined to them see the same cuts, also if executors are lost.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    path = new_path(spark, "ranges")
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ordered.select("*", F.spark_partition_id().alias("_part"), place.alias("_row")).write.parquet(path)
    return spark.read.parquet(path)


def range_shifts(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per part and group what to add to ``_row`` for the place in the group: ``_part, _group, _shift``.

    There are as many rows as parts and groups together, as a group only shares its first and its
    last part with others.
    """
    held = placed.groupBy("_part", F.struct(*keys).alias("_group")).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_rows")
    )
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    return held.select("_part", "_group", (carried - F.col("_first")).alias("_shift"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str | Column] | None = None,
    maxima: Mapping[str, str | Column] | None = None,
    block_positions: int | None = None,
    spread: Spread | None = None,
) -> DataFrame:
    """``df`` plus running sums and maxima along ``order`` within ``keys``, current row included.

    ``order`` is an integer position, unique within ``keys`` and never NULL; gaps make no
    difference. Its ``spread`` is looked up unless it is given. Pass only the keys, the order and
    the plain columns that are added up: both uses of the blocks then need the same columns, and
    Spark makes and shuffles them once.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    spread = spread or spread_of(df, keys, order)
    # The keys as one struct: it is never NULL itself, so a NULL key is a group like any other
    # and the join infers no filter that would set its two sides apart.
    group, rest = F.struct(*keys).alias("_group"), [c for c in df.columns if c not in keys]
    if spread.dense:
        width = block_positions or max(BLOCK_POSITIONS, -(-spread.longest // MOST_BLOCKS))
        blocks = df.select(group, *rest, div(F.col(order), width).alias("_block"))
    else:
        placed = in_ranges(df, keys, [order])
        blocks = placed.select(group, *rest, F.col("_part").alias("_block"))
    along = Window.partitionBy("_group", "_block").orderBy(order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = blocks.select(
        "*",
        *[F.sum(v).over(upto).alias(f"_in_{n}") for n, v in sums.items()],
        *[F.max(v).over(upto).alias(f"_in_{n}") for n, v in maxima.items()],
        F.lead(order).over(along).isNull().alias("_last"),
    )
    before = (
        Window.partitionBy("_group")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = inside.where("_last").select(
        "_group",
        "_block",
        *[F.sum(f"_in_{n}").over(before).alias(f"_carry_{n}") for n in sums],
        *[F.max(f"_in_{n}").over(before).alias(f"_carry_{n}") for n in maxima],
    )
    return inside.join(carried, ["_group", "_block"], "left").select(
        *[F.col(f"_group.{c}") if c in keys else F.col(c) for c in df.columns],
        *[
            (F.coalesce(f"_carry_{n}", F.lit(0)) + F.coalesce(f"_in_{n}", F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.greatest(f"_carry_{n}", f"_in_{n}").alias(n) for n in maxima],
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "pos",
    spread: Spread | None = None,
) -> DataFrame:
    """Dense 0-based row position within ``keys``, whatever gaps ``order`` has.

    A table whose groups have all positions needs no counting. One with few gaps is counted per
    block. Any other is dealt to ranges, where the place of a row in its part is known from the
    sort, so that only the parts' sizes are added up.
    """
    spread = spread or spread_of(df, keys, order)
    if spread.plain:
        return df.withColumn(name, F.col(order) - F.lit(spread.lowest))
    if spread.dense:
        counted = running(df, keys, order, sums={name: F.lit(1)}, spread=spread)
        return counted.withColumn(name, F.col(name) - 1)
    placed = in_ranges(df, keys, [order])
    rows = placed.withColumn("_group", F.struct(*keys))
    return rows.join(range_shifts(placed, keys), ["_part", "_group"]).select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(name)
    )


def rows_below_bound(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """At least the first ``n`` rows of each group, and few more.

    A hash aggregate finds the smallest order value of each of a group's buckets; ``n`` rows lie
    up to the ``n``-th smallest of these. The bounds are one row per group and broadcast; a group
    with fewer filled buckets than ``n`` has no bound.
    """
    group = F.struct(*keys).alias("_group")
    bucket = F.pmod(F.xxhash64(order), F.lit(n * _BUCKETS_PER_ROW)).alias("_bucket")
    least = df.groupBy(group, bucket).agg(F.min(order).alias("_least"))
    bounds = least.groupBy("_group").agg(
        F.get(F.sort_array(F.collect_list("_least")), F.lit(n - 1)).alias("_bound")
    )
    bounded = df.withColumn("_group", group).join(F.broadcast(bounds), "_group")
    return bounded.where(F.col("_bound").isNull() | (F.col(order) <= F.col("_bound"))).select(*df.columns)


def first_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows per group; only rows below a bound are put in order, not the whole table."""
    w = Window.partitionBy(F.struct(*keys)).orderBy(order)
    below = rows_below_bound(df, keys, order, n)
    return below.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
