"""The log of teacher calls: outcomes, failure accounting, progress, circuit breaker.

Rows are ``teacher, idx, attempt, ok, error, completion, at_s``: one per call, ``idx`` the dense
0-based index of the problem, ``attempt`` counting from 0, ``at_s`` seconds on the teacher's
clock. All but the completions themselves is computed from the narrow columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse import fixed
from stillhouse.config import BreakerConfig, RetryConfig, TeacherConfig
from stillhouse.functions import metrics as M
from stillhouse.functions.retry import backoff_seconds, is_final, is_rate_limit
from stillhouse.functions.text import error_text, is_error
from stillhouse.operators import breaker
from stillhouse.operators.ordered import CONSECUTIVE, running, with_position


def outcomes(attempts: DataFrame, retry: RetryConfig = RetryConfig()) -> DataFrame:
    """The attempt that settled each request.

    A request ends with its first success or its last allowed failure, so this is a filter;
    requests still being retried have no outcome yet.
    """
    return attempts.where(is_final(F.col("ok"), F.col("attempt"), retry))


def settled(attempts: DataFrame, retry: RetryConfig = RetryConfig()) -> DataFrame:
    """Outcomes of a log of several runs: a success, or the failure of the last run that tried.

    ``attempts`` has a column ``run``. Later runs skip what succeeded, so successes need no
    comparing; only failures are grouped, and only keys are compared with the successes.
    """
    final = outcomes(attempts, retry)
    good, failed = final.where(F.col("ok")), final.where(~F.col("ok"))
    order = ["run", "attempt", "error", "at_s"]
    last = failed.groupBy("teacher", "idx").agg(F.max(F.struct(*order)).alias("last"))
    still_failed = last.join(good.select("teacher", "idx"), ["teacher", "idx"], "left_anti")
    restored = still_failed.select(
        "teacher",
        "idx",
        "last.*",
        F.lit(False).alias("ok"),
        F.lit(None).cast("string").alias("completion"),
    )
    return good.unionByName(restored.select(*good.columns))


def synthetic_answers(outcome: DataFrame) -> DataFrame:
    """``teacher, idx, synthetic_answer``: the completion, or the error text in its place."""
    return outcome.select(
        "teacher",
        "idx",
        error_text(F.col("completion"), F.col("error"), fixed.ERROR_MARK).alias("synthetic_answer"),
    )


def outcomes_of_completions(completions: DataFrame) -> DataFrame:
    """``teacher, idx, ok`` read off stored completions, where an error text stands for a failure.

    Error blocks, runs and the breaker work on it as on a log.
    """
    failed = is_error(F.col("synthetic_answer"), fixed.ERROR_MARK)
    return completions.select("teacher", "idx", (~failed).alias("ok"))


def completion_errors(completions: DataFrame) -> DataFrame:
    """Rows, errors and success rate in percent per teacher, from the completions alone."""
    counted = (
        outcomes_of_completions(completions)
        .groupBy("teacher")
        .agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"))
    )
    good = F.col("total") - F.col("errors")
    return counted.select(
        "*",
        good.alias("successful"),
        M.rounded(100 * M.ratio(good, F.col("total")), 2).alias("success_rate"),
    )


def answers_with_fallback(outcome: DataFrame, problems: DataFrame) -> DataFrame:
    """The completion, or the problem's own answer where the call failed."""
    return outcome.join(problems.select("idx", "answer"), "idx").select(
        "teacher",
        "idx",
        F.coalesce("completion", "answer", F.lit("")).alias("synthetic_answer"),
        F.col("completion").isNull().alias("fell_back"),
    )


def totals_by_teacher(problems: DataFrame, teachers: list[str]) -> DataFrame:
    """Requests each teacher has to serve: the row count of the set."""
    return problems.agg(F.count("*").alias("total")).select(
        F.explode(F.array(*[F.lit(t) for t in teachers])).alias("teacher"), "total"
    )


def _model_name(config: TeacherConfig):
    pairs = [F.lit(x) for pair in config.model_names().items() for x in pair]
    return F.create_map(*pairs)[F.col("teacher")]


def generation_stats(
    attempts: DataFrame,
    totals: DataFrame,
    config: TeacherConfig = TeacherConfig(),
    retry: RetryConfig = RetryConfig(),
) -> DataFrame:
    """Per teacher: requests, errors, success rate, minutes and rows per minute, in one pass.

    A log of several runs has a column ``run``; the time between runs doesn't count.
    """
    settled = is_final(F.col("ok"), F.col("attempt"), retry)
    run = F.col("run") if "run" in attempts.columns else F.lit(0)
    seen = (
        attempts.groupBy("teacher", run.alias("run"))
        .agg(
            F.count_if(settled).alias("processed"),
            F.count_if(settled & ~F.col("ok")).alias("errors"),
            ((F.max("at_s") - F.min("at_s")) / F.lit(60.0)).alias("minutes"),
        )
        .groupBy("teacher")
        .agg(*[F.sum(c).alias(c) for c in ("processed", "errors", "minutes")])
    )
    good = F.col("processed") - F.col("errors")
    return totals.join(seen, "teacher").select(
        "teacher",
        _model_name(config).alias("model"),
        "total",
        "processed",
        "errors",
        good.alias("successful"),
        (100 * M.ratio(good, F.col("total"))).alias("success_rate"),
        "minutes",
        F.try_divide(F.col("processed"), F.col("minutes")).alias("rows_per_min"),
    )


def stats_total(stats: DataFrame) -> DataFrame:
    """The statistics summed over all teachers, as one row."""
    return stats.agg(
        F.lit("all").alias("teacher"),
        F.sum("total").alias("total"),
        F.sum("errors").alias("errors"),
        F.sum("minutes").alias("minutes"),
    )


def positioned(outcome: DataFrame, *more: str) -> DataFrame:
    """``teacher, idx, ok`` and each row's place ``pos`` in its teacher's order, whatever gaps ``idx`` has."""
    return with_position(outcome.select("teacher", "idx", "ok", *more), ["teacher"], "idx")


def _judged_blocks(outcome: DataFrame, config: BreakerConfig) -> DataFrame:
    block = M.div(F.col("pos"), config.block_rows).alias("block")
    return (
        positioned(outcome)
        .groupBy("teacher", block)
        .agg(
            F.count("*").alias("rows"),
            F.count_if(~F.col("ok")).alias("errors"),
            F.max("idx").alias("last_idx"),
        )
        .where(F.col("rows") == config.block_rows)
        .withColumn("error_rate", F.col("errors") / F.lit(float(config.block_rows)))
        .withColumn("trips", F.col("error_rate") > config.block_error_rate)
    )


def error_rate_blocks(outcome: DataFrame, config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """Error rate of each full block of rows in their order; a last partial block is never judged."""
    return _judged_blocks(outcome, config).drop("last_idx")


def error_runs(outcome: DataFrame, config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """Maximal runs of consecutive failures: first and last row, length, whether they trip.

    Rows of a run share the last good row before them. It is a running maximum, computed per
    block of positions; the runs are then counted with partial sums, so one endless run is
    spread over the tasks as well.
    """
    marked = running(
        outcome.select("teacher", "idx", F.when(F.col("ok"), F.col("idx")).alias("ok_idx")),
        ["teacher"],
        "idx",
        maxima={"last_ok": "ok_idx"},
    )
    after = F.coalesce(F.col("last_ok"), F.lit(-1)).alias("after")
    return (
        marked.where(F.col("ok_idx").isNull())
        .groupBy("teacher", after)
        .agg(
            F.min("idx").alias("first_idx"),
            F.max("idx").alias("last_idx"),
            F.count("*").alias("run_rows"),
        )
        .withColumn("trips", F.col("run_rows") >= config.max_consecutive)
        .drop("after")
    )


def progress(
    outcome: DataFrame,
    start: DataFrame,
    totals: DataFrame,
    every: int = fixed.BLOCK_ROWS,
) -> DataFrame:
    """State after each full block of ``every`` rows: done, errors, rate, time left.

    Sums per block first, so the running totals go over one row per block. ``start`` holds the
    first ``at_s`` of each teacher.
    """
    blocks = (
        positioned(outcome, "at_s")
        .groupBy("teacher", M.div(F.col("pos"), every).alias("block"))
        .agg(
            F.count("*").alias("rows"),
            F.count_if(~F.col("ok")).alias("block_errors"),
            F.max("at_s").alias("block_at_s"),
        )
    )
    upto = running(
        blocks,
        ["teacher"],
        "block",
        sums={"done": "rows", "errors": "block_errors"},
        maxima={"at_s": "block_at_s"},
        spread=CONSECUTIVE,
    ).where(F.col("rows") == every)
    rate = F.try_divide(F.col("done"), F.col("at_s") - F.col("start_s"))
    return (
        upto.join(F.broadcast(start), "teacher")
        .join(F.broadcast(totals), "teacher")
        .select(
            "teacher",
            "done",
            "total",
            M.rounded(100 * F.col("done") / F.col("total"), 1).alias("done_pct"),
            "errors",
            M.rounded(F.col("errors") / F.col("done"), 4).alias("error_rate"),
            M.rounded(rate * 60, 2).alias("rows_per_min"),
            M.rounded(
                F.coalesce(F.try_divide(F.col("total") - F.col("done"), rate), F.lit(0.0)) / 60, 1
            ).alias("eta_min"),
        )
    )


def start_times(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("teacher").agg(F.min("at_s").alias("start_s"))


def breaker_cuts(outcome: DataFrame, config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """Where the breaker stops each teacher: one row per stopped teacher."""
    return breaker.cuts(breaker.advance(outcome, config=config))


def apply_breaker(outcome: DataFrame, config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """The rows that would have been kept had the stream been stopped at the first trip.

    The cuts come from the narrow columns; the rows themselves are filtered and not shuffled.
    """
    return breaker.kept_rows(outcome, breaker.advance(outcome, config=config))


def breaker_report(
    outcome: DataFrame, totals: DataFrame, config: BreakerConfig = BreakerConfig()
) -> DataFrame:
    """Per teacher what the breaker kept, counted and reported, from one pass over the log."""
    return breaker.report(breaker.advance(outcome, config=config), totals)


def backoff_totals(attempts: DataFrame, retry: RetryConfig = RetryConfig()) -> DataFrame:
    """Failed calls and seconds spent waiting, per teacher and kind of failure."""
    kind = F.when(is_rate_limit(F.col("error")), "rate_limit").otherwise("other")
    wait = backoff_seconds(F.col("error"), F.col("attempt"), retry)
    return (
        attempts.where(~F.col("ok"))
        .select("teacher", kind.alias("kind"), wait.alias("wait"))
        .groupBy("teacher", "kind")
        .agg(
            F.count("*").alias("failed_calls"),
            F.count("wait").alias("retries"),
            F.sum(F.coalesce("wait", F.lit(0.0))).alias("wait_s"),
        )
    )


def work_list(problems: DataFrame, teachers: list[str]) -> DataFrame:
    """Every problem once per teacher. The teachers are settings, so no join is involved."""
    return problems.select("*", F.explode(F.array(*[F.lit(t) for t in teachers])).alias("teacher"))


def pending(work: DataFrame, attempts: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Work that has no outcome yet; with ``retry_errors`` also what ended in an error."""
    done = attempts.where(F.col("ok")) if retry_errors else outcomes(attempts)
    return work.join(done.select("teacher", "idx"), ["teacher", "idx"], "left_anti")


def missing_teachers(
    problems: DataFrame, teachers: list[str], attempts: DataFrame, retry_errors: bool = True
) -> DataFrame:
    """Problems that some teacher has not answered yet, with those teachers as ``missing``.

    The teachers that are done with a problem are a small set beside it, so each problem's text is
    shuffled once at most.
    """
    done = attempts.where(F.col("ok")) if retry_errors else outcomes(attempts)
    by_problem = done.groupBy("idx").agg(F.collect_set("teacher").alias("_done"))
    missing = F.array_except(F.array(*map(F.lit, teachers)), F.coalesce("_done", F.array().cast("array<string>")))
    beside = problems.join(by_problem, "idx", "left").select(*problems.columns, missing.alias("missing"))
    return beside.where(F.size("missing") > 0)


def pending_for(
    problems: DataFrame, teachers: list[str], attempts: DataFrame, retry_errors: bool = True
) -> DataFrame:
    """Every problem and teacher that has no outcome yet; only what is missing is spread out."""
    beside = missing_teachers(problems, teachers, attempts, retry_errors)
    return beside.select(*problems.columns, F.explode("missing").alias("teacher"))
