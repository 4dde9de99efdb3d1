"""The jobs end to end. Each stage is written before the next one reads it."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.config import BreakerConfig, EvalConfig, RetryConfig, TeacherConfig, TrainingConfig
from stillhouse.functions.metrics import div
from stillhouse.functions.prompts import CHAT, CHATML, GENERATION, ChatMarkup, PromptTemplate
from stillhouse.operators import attempts as L
from stillhouse.operators import breaker as stretches
from stillhouse.operators import chat, grading, sampling
from stillhouse.operators.completion import ATTEMPT_SCHEMA, ProviderFactory, complete
from stillhouse.operators.ordered import with_position
from stillhouse.sources.completions import COMPLETION_SCHEMA, read_completions, write_completions
from stillhouse.sources.results import (
    EVALUATION_RESULT,
    TRAINING_RECORD,
    ResultsDocument,
    training_records,
)
from stillhouse.sources.shared import new_path, remove
from stillhouse.sources.stats import stats_lines, write_stats


#: Problems asked before the breaker looks at the calls: in the first round, so that a teacher that
#: is down is noticed early, and at most. Each round is ten times the one before until then.
FIRST_ROWS, ROUND_ROWS = 20, 1_000
_GROWTH = 10
#: Problems of a file of the queue, so that several tasks ask those of a large round.
_QUEUE_FILE_ROWS = 10_000
#: Problems of a round up to which one task judges a teacher's calls.
_ONE_TASK_ROWS = 100_000
_QUEUE_SCHEMA = "idx bigint, question string, missing array<string>"


def generate(
    spark: SparkSession,
    problems: DataFrame,
    providers: Mapping[str, ProviderFactory],
    root: str,
    config: TeacherConfig = TeacherConfig(),
    retry: RetryConfig = RetryConfig(),
    breaker: BreakerConfig = BreakerConfig(),
    template: PromptTemplate = GENERATION,
    tasks: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    round_rows: int = ROUND_ROWS,
    first_rows: int = FIRST_ROWS,
    clock: Callable[[], float] = time.time,
) -> DataFrame:
    """Ask the teachers, keep completions and statistics, return the breaker's report.

    Problems are asked in rounds in the order of ``idx``. What has to be asked is worked out once
    and dealt to rounds. The calls of a round are appended to ``root/attempts`` when it ends, so a
    failed job loses one round at most. The breaker's state after a round, a row per teacher, is
    kept in ``root/breaker``; the next round adds its own calls to it and reads no others. A teacher
    that the breaker stops is asked no more. A job that is started again asks only for what has no
    answer in the log yet.
    """
    root = root.rstrip("/")
    log_path, out_path = f"{root}/attempts", f"{root}/completions"
    teachers = list(config.teachers)
    log = _read_log(spark, log_path)
    run = 0 if log is None else log.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1
    queue = new_path(spark, "queue")
    rounds = _deal_rounds(spark, problems, teachers, log, queue, first_rows, round_rows)
    active, state, kept = teachers, None, []
    with ThreadPoolExecutor(1) as keeping:
        for number in range(rounds):
            asked = spark.read.schema(_QUEUE_SCHEMA).parquet(f"{queue}/round={number}")
            work = asked.select(
                "idx", "question", F.explode(F.array_intersect("missing", F.array(*map(F.lit, active)))).alias("teacher")
            )
            # Without a log every teacher lacks every problem.
            if log is not None and work.isEmpty():
                continue
            prompts = work.select("teacher", "idx", template.render(F.col("question")).alias("prompt"))
            called = complete(prompts, providers, teachers, retry, tasks, sleep, clock)
            own_path = f"{log_path}/run={run}"
            called.write.mode("append").parquet(own_path)
            own = L.outcomes(spark.read.schema(ATTEMPT_SCHEMA).parquet(own_path), retry)
            if round_rows <= _ONE_TASK_ROWS:
                own = stretches.in_one_round(own)
            # One row per teacher at most: the next round takes it from here while it is written.
            seen = stretches.advance(own, state, breaker).toArrow()
            state = spark.createDataFrame(seen, stretches.STATE_SCHEMA)
            for write in kept:
                write.result()
            kept = [keeping.submit(_keep_state, state, f"{root}/breaker/run={run}")]
            run += 1
            tripped = {r["teacher"] for r in seen.to_pylist() if r["trip_idx"] is not None}
            active = [t for t in active if t not in tripped]
            if not active:
                break
        for write in kept:
            write.result()
    remove(spark, queue)

    log = _read_log(spark, log_path)
    if log is None:
        log = spark.createDataFrame([], f"{ATTEMPT_SCHEMA}, run int")
    outcome = L.settled(log, retry)
    final_path = f"{root}/breaker/all"
    stretches.advance(outcome, config=breaker).write.mode("overwrite").parquet(final_path)
    final = spark.read.schema(stretches.STATE_SCHEMA).parquet(final_path)
    kept = L.synthetic_answers(stretches.kept_rows(outcome, final))
    answered = kept.join(problems.select("idx", "question", "answer"), "idx")
    columns = [c.split()[0] for c in COMPLETION_SCHEMA.split(", ")]
    write_completions(answered.select(*columns), out_path)

    totals = L.totals_by_teacher(problems, teachers)
    report = stretches.report(final, totals)
    minutes = L.generation_stats(log, totals, config, retry).select("teacher", "minutes")
    shown = report.join(minutes, "teacher").withColumn(
        "success_rate", 100 * F.col("successful") / F.col("total")
    )
    write_stats(stats_lines(shown, out_path), f"{root}/stats")
    # A teacher that keeps no row has none written, so what an earlier job kept has to go.
    with_rows = {r["teacher"] for r in final.where("kept > 0").select("teacher").collect()}
    for teacher in teachers:
        if teacher not in with_rows:
            remove(spark, f"{out_path}/teacher={teacher}")
    return report


def _keep_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").parquet(path)


def _round_starts(rows: int, first_rows: int, round_rows: int) -> tuple[list[int], int]:
    """Where the rounds that still grow begin, and the number of rounds for so many rows."""
    starts, size = [0], min(first_rows, round_rows)
    while size < round_rows:
        starts.append(starts[-1] + size)
        size = min(size * _GROWTH, round_rows)
    growing = [s for s in starts if s < rows]
    if len(growing) < len(starts):
        return growing, len(growing)
    return starts, len(starts) - 1 + -(-(rows - starts[-1]) // round_rows)


def _deal_rounds(
    spark: SparkSession,
    problems: DataFrame,
    teachers: list[str],
    log: DataFrame | None,
    path: str,
    first_rows: int,
    round_rows: int,
) -> int:
    """Write the problems that some teacher has to answer, one folder per round; returns their number.

    Problem texts and the log are read here once, not per round.
    """
    asked = problems.select("idx", "question")
    if log is None:
        pending = asked.withColumn("missing", F.array(*map(F.lit, teachers)))
    else:
        pending = L.missing_teachers(asked, teachers, log)
    placed = with_position(pending.withColumn("_all", F.lit(0)), ["_all"], "idx").drop("_all")
    rows = placed.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    starts, rounds = _round_starts(rows, first_rows, round_rows)
    if not rounds:
        return 0
    pos = F.col("pos")
    number = F.lit(len(starts) - 1) + div(pos - starts[-1], round_rows)
    for n in range(len(starts) - 2, -1, -1):
        number = F.when(pos < starts[n + 1], n).otherwise(number)
    dealt = placed.select("idx", "question", "missing", number.cast("int").alias("round"))
    # Rows of a round come from few tasks as they lie next to each other; a round is a few files.
    files = -(-rows // _QUEUE_FILE_ROWS)
    dealt.repartitionByRange(files, "round", "idx").write.partitionBy("round").parquet(path)
    return rounds


def _read_log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{ATTEMPT_SCHEMA}, run int").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def training_text(
    spark: SparkSession,
    problems: DataFrame,
    completions_path: str,
    out_path: str,
    choice: str = "all",
    config: TeacherConfig = TeacherConfig(),
    template: PromptTemplate = CHAT,
    markup: ChatMarkup = CHATML,
    drop_errors: bool = True,
) -> None:
    """Write the chat text of the chosen variants, one directory per variant; nothing shuffles.

    Directories of other variants stay; a chosen one that has no rows any more is removed.
    """
    labels = config.for_training(choice)
    taught = [t for t in labels if t != config.original]
    pairs = chat.training_pairs(
        problems,
        read_completions(spark, completions_path, taught),
        labels,
        config.original,
        drop_errors,
    )
    texts = chat.training_text(pairs, template, markup)
    (
        texts.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("teacher")
        .parquet(out_path)
    )
    for label in labels:
        if pairs.where(F.col("teacher") == label).isEmpty():
            remove(spark, f"{out_path}/teacher={label}")


def evaluate(
    spark: SparkSession,
    predictions: DataFrame,
    problems: DataFrame,
    results_root: str,
    choice: str = "all",
    config: TeacherConfig = TeacherConfig(),
    evaluation: EvalConfig = EvalConfig(),
    grade: Callable[[DataFrame, DataFrame], DataFrame] = grading.grade,
) -> DataFrame:
    """Grade the chosen models on the whole test set, or its first rows if the settings say so,
    in one job, replace their results, return the leaderboard.

    The leaderboard covers every model in the results document, also those of earlier calls; it
    is empty as long as the base model has no result. ``grade`` is the rule for answers; with
    ``grading.grade_short`` and a seeded sample for ``generate`` this is the short form of the jobs.
    """
    asked = problems
    chosen = grading.select_models(predictions, config.for_evaluation(choice))
    if evaluation.test_size is not None:
        asked, chosen = (sampling.first_n(df, evaluation.test_size) for df in (asked, chosen))
    samples = grading.sample_rows(
        chosen, asked, evaluation.sample_rows, evaluation.sample_chars
    )
    document = ResultsDocument(spark, results_root, EVALUATION_RESULT)
    document.upsert(grading.evaluation_results(grade(chosen, asked), samples))
    stored = document.read().select(F.lit("test").alias("split"), "teacher", "correct", "total", "accuracy")
    return grading.leaderboard(stored, config.base)


def log_training(
    spark: SparkSession,
    runs: DataFrame,
    log_root: str,
    data_root: str,
    model_root: str,
    training: TrainingConfig = TrainingConfig(),
    config: TeacherConfig = TeacherConfig(),
) -> DataFrame:
    """Keep one record per finished training run, replacing a variant's last one; returns all."""
    document = ResultsDocument(spark, log_root, TRAINING_RECORD)
    document.upsert(training_records(runs, data_root, model_root, training, config))
    return document.read()
