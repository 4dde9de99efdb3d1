"""The circuit breaker as summaries of stretches, which add up along the log and from round to round.

A stretch is a few whole blocks of consecutive rows of a teacher. What the breaker has to know of
it fits in one row: how many rows and errors, how many failures it begins with, where its last good
row is, and where it would trip by itself. Only these rows are carried along the log. The same goes
for rounds: the state after a round is one row per teacher, and the next round reads it and its own
calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse.config import BreakerConfig
from stillhouse.functions.metrics import div
from stillhouse.operators.ordered import CONSECUTIVE, running, with_position
from stillhouse.sources.shared import new_path

#: Blocks per stretch. A stretch's outcomes are one text while it is summarised.
STRETCH_BLOCKS = 40

#: What is carried from round to round, one row per teacher: rows seen; rows processed and kept and
#: errors up to the trip, if there was one; failures in a row before the open block; outcomes of the
#: open block (``1`` good, ``0`` failed); the row that tripped and whether it stays.
STATE_SCHEMA = (
    "teacher string, rows bigint, processed bigint, kept bigint, errors bigint, run_before bigint, "
    "open_block string, trip_idx bigint, keeps int"
)


#: Marks rows of one small round.
_ONE_ROUND = "_one_round"


def _failures(bits: Column) -> Column:
    return (F.length(bits) - F.length(F.translate(bits, "0", ""))).cast("bigint")


def _leading_failures(bits: Column) -> Column:
    return (F.instr(F.concat(bits, F.lit("1")), "1") - 1).cast("bigint")


_START = ["began", "run_at_start", "errors_at_start"]


def _known(state: DataFrame) -> DataFrame:
    """The state, one row per teacher, and what holds where the open block begins."""
    return state.select(
        "*",
        F.col("rows").alias("seen"),
        (F.col("rows") - F.length("open_block")).alias("began"),
        F.col("run_before").alias("run_at_start"),
        (F.col("errors") - _failures(F.col("open_block"))).alias("errors_at_start"),
        F.col("trip_idx").isNotNull().alias("tripped"),
    )


def _with_state(outcome: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their position in the whole log, those of the open block in front, and what is known.

    Rows of the open block have no ``idx``: they were judged before and none of them trips.
    """
    placed = with_position(outcome.select("teacher", "idx", "ok"), ["teacher"], "idx")
    if state is None:
        return placed, None
    open_rows = F.length("open_block")
    known = F.broadcast(_known(state).select("teacher", "seen", *_START, "open_block", "tripped"))
    moved = placed.join(known, "teacher", "left").where(~F.coalesce("tripped", F.lit(False)))
    own = moved.select("teacher", "idx", "ok", (F.col("pos") + F.coalesce("seen", F.lit(0))).alias("pos"))
    before = (
        known.where(~F.col("tripped") & (open_rows > 0))
        .select("teacher", "began", F.posexplode(F.split("open_block", "")))
        .where("col != ''")
        .select(
            "teacher",
            F.lit(None).cast("bigint").alias("idx"),
            (F.col("col") == "1").alias("ok"),
            (F.col("began") + F.col("pos")).alias("pos"),
        )
    )
    return own.unionByName(before), known


def _stretches(rows: DataFrame, config: BreakerConfig) -> DataFrame:
    """One row per stretch of ``teacher, idx, ok, pos`` rows, which begin with a block."""
    block = config.block_rows
    row = F.struct("pos", "idx", F.when(F.col("ok"), "1").otherwise("0").alias("bit"))
    whole = (
        rows.groupBy("teacher", div(F.col("pos"), block * STRETCH_BLOCKS).alias("stretch"))
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select(
            "teacher",
            "stretch",
            F.get("rows.pos", F.lit(0)).alias("first_pos"),
            F.array_join("rows.bit", "").alias("bits"),
            F.col("rows.idx").alias("idxs"),
        )
    )
    return _summaries(whole, config)


def _summaries(whole: DataFrame, config: BreakerConfig, *more: str) -> DataFrame:
    """What has to be known of stretches ``teacher, stretch, first_pos, bits, idxs``.

    ``own`` is the first trip that needs no rows before the stretch. ``head`` holds the ``idx`` of
    the first rows, as far as a run that began earlier may trip there.
    """
    block, reach = config.block_rows, config.max_consecutive
    bits, size = F.col("bits"), F.length("bits")
    failed = f"({block} - length(translate(b, '0', '')))"
    # Numbers of whole blocks count from 1.
    bad = F.expr(
        f"array_position(transform(regexp_extract_all(bits, '.{{{block}}}', 0),"
        f" b -> {failed} / {block}D > {config.block_error_rate!r}D), true)"
    )

    def trip(offset: Column, keeps: int) -> Column:
        return F.struct(
            offset.cast("bigint").alias("offset"),
            F.lit(keeps).alias("keeps"),
            F.get("idxs", offset.cast("int")).alias("idx"),
            _failures(F.substring(bits, F.lit(1), (offset + 1).cast("int"))).alias("errors"),
        )

    in_a_row = F.instr(bits, "0" * reach)
    by_run = F.when(in_a_row > 0, trip(in_a_row + reach - 2, 0))
    by_rate = F.when(F.col("bad") > 0, trip(F.col("bad") * block - 1, 1))
    last_ok = F.when(F.instr(bits, "1") > 0, F.col("first_pos") + size - F.instr(F.reverse(bits), "1"))
    return whole.withColumn("bad", bad).select(
        "teacher",
        "stretch",
        "first_pos",
        size.cast("bigint").alias("rows"),
        _failures(bits).alias("errors"),
        _leading_failures(bits).alias("head_run"),
        F.slice("idxs", 1, max(reach - 1, 1)).alias("head"),
        last_ok.alias("last_ok"),
        F.least(by_run, by_rate).alias("own"),
        F.right(bits, F.lit(block + reach)).alias("end_bits"),
        *more,
    )


def _carried(stretches: DataFrame) -> DataFrame:
    """Errors and last good row before each stretch but the first; one row per stretch is carried."""
    upto = running(
        stretches.select("teacher", "stretch", "last_ok", "errors"),
        ["teacher"],
        "stretch",
        sums={"errors_before": "errors"},
        maxima={"ok_before": "last_ok"},
        spread=CONSECUTIVE,
    )
    return upto.select("teacher", (F.col("stretch") + 1).alias("stretch"), "errors_before", "ok_before")


def in_one_round(outcome: DataFrame) -> DataFrame:
    """``outcome`` as rows of one round, of which one task can hold what a teacher has there."""
    return outcome.select("teacher", "idx", "ok", F.lit(True).alias(_ONE_ROUND))


def _judged(seen: DataFrame, config: BreakerConfig) -> DataFrame:
    """Stretches with the failures in a row that end where each begins, and with its first trip.

    They have what holds where the log begins and what comes before the stretch.
    """
    reach = config.max_consecutive
    # Failures in a row that end where the stretch begins.
    run_in = F.coalesce(
        F.col("first_pos") - 1 - F.col("ok_before"),
        F.col("first_pos") - F.col("began") + F.col("run_at_start"),
    )
    at = F.lit(reach - 1) - F.col("run_in")
    crossing = F.when(
        (F.col("run_in") > 0) & (at >= 0) & (at < F.col("head_run")),
        F.struct(
            at.cast("bigint").alias("offset"),
            F.lit(0).alias("keeps"),
            F.get("head", at.cast("int")).alias("idx"),
            (at + 1).cast("bigint").alias("errors"),
        ),
    )
    judged = (
        seen.withColumn("run_in", run_in)
        .withColumn("first", F.least(crossing, F.col("own")))
        .withColumn("errors_before", F.col("errors_at_start") + F.coalesce("errors_before", F.lit(0)))
    )
    trip = F.struct(
        (F.col("first_pos") + F.col("first.offset")).alias("pos"),
        F.col("first.keeps").alias("keeps"),
        F.col("first.idx").alias("idx"),
        (F.col("errors_before") + F.col("first.errors")).alias("errors"),
    )
    return judged.select(
        "*",
        (F.col("first_pos") + F.col("rows")).alias("upto"),
        (F.col("errors_before") + F.col("errors")).alias("errors_upto"),
        F.when(F.col("first").isNotNull(), trip).alias("trip"),
        F.struct("stretch", "end_bits", F.col("rows").alias("size"), "run_in").alias("end"),
    )


def _new_state(config: BreakerConfig) -> list[Column]:
    """The state but for the teacher, of the last ``upto, errors_upto, end`` and the first ``trip``."""
    block, reach = config.block_rows, config.max_consecutive
    rows, errors = F.col("upto"), F.col("errors_upto")
    bits, open_rows = F.col("end.end_bits"), (rows % block).cast("int")
    closed = F.reverse(F.substring(bits, F.lit(1), F.length(bits) - open_rows))
    # If nothing but failures is left of the stretch, what ran into it goes on.
    whole = (_leading_failures(closed) == F.length(closed)) & (F.length(bits) == F.col("end.size"))
    run_before = _leading_failures(closed) + F.when(whole, F.col("end.run_in")).otherwise(0)
    tripped = F.col("trip").isNotNull()
    return [
        rows.alias("rows"),
        F.when(tripped, F.col("trip.pos") + 1).otherwise(rows).alias("processed"),
        F.when(tripped, F.col("trip.pos") + F.col("trip.keeps")).otherwise(rows).alias("kept"),
        F.when(tripped, F.col("trip.errors")).otherwise(errors).alias("errors"),
        F.least(F.lit(reach - 1).cast("bigint"), run_before).alias("run_before"),
        F.right(bits, open_rows).alias("open_block"),
        F.col("trip.idx").alias("trip_idx"),
        F.col("trip.keeps").alias("keeps"),
    ]


def _advance_one_round(outcome: DataFrame, state: DataFrame | None, config: BreakerConfig) -> DataFrame:
    """State after a round that is one stretch of each teacher; its calls are shuffled once."""
    row = F.struct("idx", F.when(F.col("ok"), "1").otherwise("0").alias("bit"))
    calls = outcome.groupBy("teacher").agg(F.sort_array(F.collect_list(row)).alias("calls"))
    old, zero = [c.split()[0] for c in STATE_SCHEMA.split(", ")][1:], F.lit(0).cast("bigint")
    if state is None:
        given = calls.select("*", *[zero.alias(c) for c in _START], F.lit("").alias("open_block"))
    else:
        before = _known(state).withColumn("before", F.struct(*old)).drop("seen", *(set(old) - {"open_block"}))
        given = calls.join(before, "teacher", "full").na.fill(0, _START).na.fill("", ["open_block"])
    whole = given.select(
        "*",
        zero.alias("stretch"),
        F.col("began").alias("first_pos"),
        F.concat("open_block", F.coalesce(F.array_join("calls.bit", ""), F.lit(""))).alias("bits"),
        # Rows of the open block were judged before and none of them trips.
        F.concat(
            F.array_repeat(F.lit(None).cast("bigint"), F.length("open_block")), F.col("calls.idx")
        ).alias("idxs"),
        F.lit(None).cast("bigint").alias("ok_before"),
        zero.alias("errors_before"),
        *([] if state is not None else [F.lit(False).alias("tripped")]),
    ).withColumn("touched", F.col("calls").isNotNull() & ~F.coalesce("tripped", F.lit(False)))
    more = ["ok_before", "errors_before", *_START, "touched", *(["before"] if state is not None else [])]
    judged = _judged(_summaries(whole, config, *more), config)
    if state is None:
        return judged.select("teacher", *_new_state(config))
    fresh = judged.select("teacher", "touched", "before", F.struct(*_new_state(config)).alias("after"))
    return fresh.select("teacher", F.when(F.col("touched"), F.col("after")).otherwise(F.col("before")).alias("now")).select(
        "teacher", "now.*"
    )


def advance(
    outcome: DataFrame, state: DataFrame | None = None, config: BreakerConfig = BreakerConfig()
) -> DataFrame:
    """State after the rows of ``outcome``, which come after all rows that ``state`` has seen.

    Rows are ``teacher, idx, ok``, taken in the order of ``idx``, whatever gaps it has. Rows of
    a teacher that has tripped are not looked at. Of the state only a row per teacher is read, so
    a round costs what its own rows cost. A run of failures drops the row that completes it, a bad
    block keeps its last row; at the same row the run is judged first. The result has
    ``STATE_SCHEMA``; write it before the next round reads it. Rows of :func:`in_one_round` are
    taken as one stretch per teacher, so that a small round is few and short stages.
    """
    if _ONE_ROUND in outcome.columns:
        return _advance_one_round(outcome, state, config)
    rows, known = _with_state(outcome, state)
    # Small and used three times: written once, so that the rows are summarised once.
    path = new_path(outcome.sparkSession, "stretches")
    _stretches(rows, config).write.parquet(path)
    stretches = outcome.sparkSession.read.parquet(path)
    seen = stretches.join(_carried(stretches), ["teacher", "stretch"], "left")
    if known is None:
        seen = seen.select("*", *[F.lit(0).cast("bigint").alias(c) for c in _START])
    else:
        seen = seen.join(known.select("teacher", *_START), "teacher", "left").na.fill(0, _START)
    folded = _judged(seen, config).groupBy("teacher").agg(
        F.max("upto").alias("upto"), F.max("errors_upto").alias("errors_upto"), F.min("trip").alias("trip"), F.max("end").alias("end")
    )
    new = folded.select("teacher", *_new_state(config))
    if state is None:
        return new
    untouched = state.join(F.broadcast(new.select("teacher")), "teacher", "left_anti")
    return new.unionByName(untouched.select(*new.columns))


def cuts(state: DataFrame) -> DataFrame:
    """Stopped teachers: ``teacher, trip_idx, cut_idx, keeps``; rows below ``cut_idx`` are kept."""
    return state.where(F.col("trip_idx").isNotNull()).select(
        "teacher", "trip_idx", (F.col("trip_idx") + F.col("keeps")).alias("cut_idx"), "keeps"
    )


def kept_rows(outcome: DataFrame, state: DataFrame) -> DataFrame:
    """The rows below the cuts; the cuts are one row per teacher and broadcast."""
    below = cuts(state).select("teacher", "cut_idx")
    return (
        outcome.join(F.broadcast(below), "teacher", "left")
        .where(F.col("cut_idx").isNull() | (F.col("idx") < F.col("cut_idx")))
        .drop("cut_idx")
    )


def report(state: DataFrame, totals: DataFrame) -> DataFrame:
    """Per teacher what the breaker kept, counted and reported, read off the state.

    ``successful`` counts processed rows only; ``reported_successful`` is total minus errors,
    which after an early stop also counts rows never asked for.
    """
    reason = F.when(F.col("keeps") == 0, "consecutive").when(F.col("keeps") == 1, "error_rate")
    return totals.join(F.broadcast(state), "teacher").select(
        "teacher",
        "total",
        "processed",
        "kept",
        "errors",
        (F.col("processed") - F.col("errors")).alias("successful"),
        (F.col("total") - F.col("errors")).alias("reported_successful"),
        (F.col("trip_idx") + F.col("keeps")).alias("cut_idx"),
        reason.otherwise("finished").alias("stop_reason"),
    )
