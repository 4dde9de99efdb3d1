"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.llm.columns import SPACES
from stillhouse.operators.ordered import in_ranges, range_shifts
from stillhouse.sources.shared import new_path

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Times a document may be taken, and so times its size that a source may reach.
MOST_COPIES = 3
SEED = "mix"
#: Expected copies are counted in units of two to the minus this, in whole numbers.
FRACTION_BITS = 24
_ONE = 1 << FRACTION_BITS
#: Hexadecimal digits of a hash that make a random offset below one.
_OFFSET_DIGITS = FRACTION_BITS // 4


def _whole(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(38,0)")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES, -1)
    # Only the first and the last part can be empty.
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return (F.size(parts) - ends).cast("long")


def _ranked(sources: DataFrame, order: Sequence[Column | str], sums: Sequence[str]) -> DataFrame:
    """``sources`` with the place of each in ``order``, and sums of what comes before it.

    Parts are ranges of the order; a window runs per part, and one row per part is carried.
    """
    parts = in_ranges(sources, [], order)
    along = Window.partitionBy("_part").orderBy("_row")
    inner = along.rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_in_{s}") for s in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.groupBy("_part")
        .agg(F.count("*").alias("_rows"), *[F.sum(s).alias(f"_all_{s}") for s in sums])
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
            *[F.coalesce(F.sum(f"_all_{s}").over(before), F.lit(0)).alias(f"_all_{s}") for s in sums],
        )
    )
    return inside.join(carried, "_part").select(
        *sources.columns,
        (F.col("_rows") + F.col("_row")).alias("place"),
        *[(F.col(f"_all_{s}") + F.col(f"_in_{s}")).alias(f"{s}_before") for s in sums],
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Per source its ``source_size, target`` in words, and ``rate``, the expected copies of a document.

    ``sizes`` has ``source, size``. Sources weigh ``weights`` in the order of their names, NULL
    last, and share the size of all. A target stops at ``most`` times the source's size; what it
    leaves goes to the others by weight. In the order of size per weight the sources that stop
    come first: they are those below the level that the rest reaches without them. All of it is
    exact but the target's last rounding. ``rate`` is in units of ``2 ** -FRACTION_BITS``.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = _ranked(summed, [F.col("source").asc_nulls_last()], [])
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights)).cast("int"))
    weighed = named.select(
        "source", "source_size", weight.alias("weight"), _whole(F.col("source_size") * most).alias("stop")
    )
    # Of two with equal size per weight either may come first: both stop or neither does.
    per_weight = F.col("source_size") / F.col("weight")
    filled = _ranked(weighed, [per_weight, "source"], ["stop", "weight"])
    # One row each: what is shared in all, the weight of all, and below the level it reaches.
    all_size = filled.agg(_whole(F.sum("source_size"))).scalar()
    all_weight = filled.agg(_whole(F.sum("weight"))).scalar()
    judged = filled.select(
        "source",
        "source_size",
        _whole("weight").alias("weight"),
        "stop",
        (all_size - F.col("stop_before")).cast("decimal(38,0)").alias("left"),
        (all_weight - F.col("weight_before")).cast("decimal(38,0)").alias("rest"),
    ).withColumn("stops", F.expr("stop * rest < left * weight"))
    level = judged.where(~F.col("stops")).agg(F.max(F.struct("rest", "left"))).scalar()
    return (
        judged.withColumn("level", level)
        .withColumn("goal", F.expr("if(stops, stop, level.left * weight)").cast("double"))
        .withColumn("parts", F.expr("if(stops, 1, level.rest)").cast("double"))
        .withColumn("units", F.expr(f"if(stops, {most * _ONE}L, level.left * weight * {_ONE} div nullif(level.rest * source_size, 0))"))
        .select(
            "source",
            "source_size",
            (F.col("goal") / F.col("parts")).alias("target"),
            F.when(F.col("source_size") > 0, F.col("units")).otherwise(0).alias("rate"),
        )
    )


def systematic_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """Every document with how often the mix takes it: ``doc_id, source, size, source_size, target, copies, taken``.

    A source's documents stand in a row, the longest first, documents of one size in the order of
    a hash of the id. Each is expected ``target / source_size`` times. These expectations are added
    up along the row from one random offset per source, and a document is taken once for each whole
    number that its own expectation crosses. Sums are whole numbers of small units, so no rounding
    adds up. As sizes only fall along the row, a source misses its target by less than one document.

    Rows are put in order by ranges, never per source, so a source may hold any share of them. The
    places in the row are those of the sorted parts, which are written once.

    A NULL text has size 0. Documents of size 0 take part without adding words; if all have size 0,
    targets are 0 and nothing is taken. A NULL source is one of its own, after all others. Rows that
    repeat an id, or have none, each have a place; equal ones are interchangeable. Other columns are
    left behind; an empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
    )
    path = new_path(spark, "sizes")
    narrow.write.parquet(path)
    sizes = spark.read.parquet(path)
    targets = source_targets(sizes, weights, most)

    hashed = sizes.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = in_ranges(
        hashed, [F.col("source").asc_nulls_last()], [F.col("size").desc(), "_hash", "doc_id"]
    )
    offset = F.conv(
        F.left(F.md5(F.concat_ws(":", F.lit(seed), "source")), F.lit(_OFFSET_DIGITS)), 16, 10
    ).cast("long")
    # A part has few sources, so facts of a source go to parts; rows meet them by part and source.
    facts = targets.select(
        F.struct("source").alias("_group"), "source_size", "target", "rate", offset.alias("offset")
    )
    shifts = range_shifts(placed, ["source"]).join(facts, "_group")
    rows = placed.withColumn("_group", F.struct("source")).join(shifts, ["_part", "_group"])

    crossed = "(cast(_row + _shift + {} as decimal(38,0)) * rate + offset) div " + str(_ONE)
    copies = F.expr(crossed.format(1)) - F.expr(crossed.format(0))
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
