"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillhouse import fixed
from stillhouse.config import TeacherConfig, TrainingConfig
from stillhouse.functions import answers as A
from stillhouse.functions import metrics as M
from stillhouse.functions import prompts as P
from stillhouse.functions import text as X
from stillhouse.operators import attempts as L
from stillhouse.operators import chat, grading, sampling
from stillhouse.operators import breaker
from stillhouse.operators.completion import Provider, Request, complete
from stillhouse.operators.ordered import spread_of
from stillhouse.operators.profile import style_profile as profile_of
from stillhouse.operators.upsert import concat, upsert
from stillhouse.plans import jobs
from stillhouse.sources import completions as store
from stillhouse.sources import keyed
from stillhouse.sources import problems as sets
from stillhouse.sources import stats as texts
from stillhouse.sources import tables as t
from stillhouse.sources.bucketed import BucketedStore
from stillhouse.sources.results import (
    EVALUATION_RESULT,
    ResultsDocument,
    flat_training_records,
)
from stillhouse.sources.shared import new_path
from stillhouse.streaming.live import keep_results, live_accuracy, live_errors
from stillhouse.streaming.stateful import keep_corrected, live_breaker, own_state, verdict_changes

Query = Callable[[SparkSession, str], DataFrame]

TEACHERS = TeacherConfig()
ASKED = list(TEACHERS.teachers)
MODELS = TEACHERS.for_evaluation("all")
VARIANTS = TEACHERS.for_training("all")
OUTPUT = "completions"
SMALL_ROWS = 100
ROUND_ROWS = 50_000
#: Files at least, and rows of a file at most.
FILES, ROWS_PER_FILE = 5, 250_000

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Size estimates take an exploded table to be as large as the one it was exploded from. Left to
# them, Spark would broadcast the five times larger predictions, so these joins ask for the one
# that spills. The operators carry no such hint: tables read from storage have true sizes.
BOTH_LARGE = "merge"


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return t.problems_of(spark, sf, "train").hint(BOTH_LARGE)


def _test(spark: SparkSession, sf: str) -> DataFrame:
    return t.problems_of(spark, sf, "test").hint(BOTH_LARGE)


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return grading.grade(t.predictions(spark, sf), _test(spark, sf))


def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return grading.accuracy_by_teacher(_graded(spark, sf))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return L.outcomes(t.attempts(spark, sf))


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return L.totals_by_teacher(_train(spark, sf), ASKED)


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return L.generation_stats(t.attempts(spark, sf), _totals(spark, sf))


# --- evaluation ----------------------------------------------------------------------------


@query
def leaderboard_lift(spark: SparkSession, sf: str) -> DataFrame:
    return grading.leaderboard(_accuracy(spark, sf))


@query
def graded_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf).withColumn("normalized", A.normalize_answer(F.col("predicted")))


@query
def extract_answer_documents(spark: SparkSession, sf: str) -> DataFrame:
    hits = t.load(spark, sf, "documents").select("doc_id", A.answer_hit(F.col("text")).alias("hit"))
    return hits.select(
        "doc_id", A.hit_rule(F.col("hit")).alias("rule"), A.hit_answer(F.col("hit")).alias("answer")
    )


@query
def extract_notebook_variant(spark: SparkSession, sf: str) -> DataFrame:
    ended = F.concat("response", F.lit(fixed.END_OF_TURN))
    return t.predictions(spark, sf).select(
        "teacher", "idx", A.extract_answer_short(ended).alias("answer")
    )


@query
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    return t.problems(spark, sf).select(
        "split", "idx", A.ground_truth(F.col("answer")).alias("ground_truth")
    )


@query
def normalize_answers(spark: SparkSession, sf: str) -> DataFrame:
    given = t.predictions(spark, sf).select(
        "teacher", "idx", A.extract_answer(F.col("response")).alias("answer")
    )
    return given.withColumn("normalized", A.normalize_answer(F.col("answer")))


@query
def accuracy_by_teacher(spark: SparkSession, sf: str) -> DataFrame:
    predictions = grading.select_models(t.predictions(spark, sf), VARIANTS)
    return grading.accuracy_by_teacher(grading.grade(predictions, _test(spark, sf)))


@query
def accuracy_notebook_variant(spark: SparkSession, sf: str) -> DataFrame:
    graded = grading.grade_short(t.predictions(spark, sf), _test(spark, sf))
    return grading.accuracy_by_teacher(graded)


@query
def running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    predictions = t.predictions(spark, sf)
    spread = spread_of(predictions, ["teacher"], "idx")
    return grading.running_accuracy(grading.grade(predictions, _test(spark, sf)), spread)


#: Distance of neighbouring test problems, and how far they are off it at most, for ``idx`` with gaps.
GAP, SHIFT = 10_007, 5_003


@query
def running_accuracy_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Running accuracy over an ``idx`` with large, uneven gaps."""
    apart = (F.col("idx") * GAP + F.col("idx") * F.col("idx") % SHIFT).alias("idx")
    graded = _graded(spark, sf).select("teacher", apart, "correct")
    return grading.running_accuracy(graded)


@query
def sample_first5(spark: SparkSession, sf: str) -> DataFrame:
    return grading.sample_rows(t.predictions(spark, sf), _test(spark, sf))


@query
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    return grading.best_model(_accuracy(spark, sf), MODELS)


@query
def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    return grading.summary_table(_accuracy(spark, sf))


@query
def upsert_results(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the prototype's rules, replaced by the later rules for the teachers asked."""
    test = _test(spark, sf)
    predictions = t.predictions(spark, sf)
    old = grading.accuracy_by_teacher(grading.grade_short(predictions, test))
    asked = grading.select_models(predictions, ASKED)
    new = grading.accuracy_by_teacher(grading.grade(asked, test))
    return upsert(old, new)


@query
def combined_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two runs under one heading, row by row."""
    test, predictions = _test(spark, sf), t.predictions(spark, sf)
    short = grading.accuracy_by_teacher(grading.grade_short(predictions, test))
    return concat(
        _accuracy(spark, sf).withColumn("rules", F.lit("full")),
        short.withColumn("rules", F.lit("short")),
    )


@query
def small_vs_full(spark: SparkSession, sf: str) -> DataFrame:
    test, predictions = _test(spark, sf), t.predictions(spark, sf)
    few = sampling.seeded_sample(test, SMALL_ROWS)
    small = grading.accuracy_by_teacher(grading.grade(predictions, few))
    return grading.small_beside_full(small, _accuracy(spark, sf))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of one training run per variant, from the rows it would train on."""
    c = TrainingConfig()
    pairs = chat.training_pairs(
        _train(spark, sf), t.completions(spark, sf), VARIANTS, TEACHERS.original
    )
    batch = M.effective_batch(F.lit(c.batch_size), F.lit(c.gradient_accumulation_steps))
    return (
        pairs.groupBy("teacher")
        .agg(F.count("*").alias("train_size"))
        .withColumn("effective_batch_size", batch.cast("bigint"))
        .withColumn(
            "total_steps",
            M.training_steps(
                F.col("train_size"), F.col("effective_batch_size"), F.lit(c.num_epochs)
            ),
        )
    )


@query
def eval_join_training(spark: SparkSession, sf: str) -> DataFrame:
    return grading.beside_training(_accuracy(spark, sf), _runs(spark, sf))


# --- prompts and chat ----------------------------------------------------------------------


@query
def gen_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return chat.generation_prompts(_train(spark, sf), ASKED)


@query
def eval_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return chat.evaluation_prompts(_test(spark, sf))


@query
def prompt_presets(spark: SparkSession, sf: str) -> DataFrame:
    presets = {
        "generation": P.GENERATION,
        "chat": P.CHAT,
        "short_train": P.SHORT_TRAIN,
        "short_eval": P.SHORT_EVAL,
    }
    return t.problems(spark, sf).select(
        "split", "idx", *[p.render(F.col("question")).alias(n) for n, p in presets.items()]
    )


@query
def train_text_by_teacher(spark: SparkSession, sf: str) -> DataFrame:
    pairs = chat.training_pairs(
        _train(spark, sf), t.completions(spark, sf), VARIANTS, TEACHERS.original
    )
    return chat.training_text(pairs)


@query
def train_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The original variant as message arrays, rendered from the array column."""
    messages = P.training_messages(P.SHORT_TRAIN.render(F.col("question")), F.col("answer"))
    arrays = _train(spark, sf).select("idx", messages.alias("messages"))
    return arrays.select(
        "idx",
        F.size("messages").cast("bigint").alias("turns"),
        P.CHATML.messages_text(F.col("messages")).alias("text"),
    )


@query
def strip_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded text starts with the prompt; what is left is the response."""
    prompts = chat.evaluation_prompts(_test(spark, sf)).select("idx", "chat")
    decoded = t.predictions(spark, sf).join(prompts, "idx")
    raw = F.concat("chat", "response")
    return decoded.select("teacher", "idx", X.strip_prompt(raw, F.col("chat")).alias("response"))


@query
def chat_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations_text(t.load(spark, sf, "conversations"))


@query
def teachers_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return chat.side_by_side(t.completions(spark, sf), ASKED)


# --- the log of calls ----------------------------------------------------------------------


@query
def error_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    answers = L.synthetic_answers(_outcomes(spark, sf))
    asked = _train(spark, sf).select("idx", "question", "answer")
    return answers.join(asked, "idx").select(
        "idx",
        "question",
        "answer",
        "synthetic_answer",
        "teacher",
        X.is_error(F.col("synthetic_answer"), fixed.ERROR_MARK).alias("failed"),
    )


@query
def error_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return L.answers_with_fallback(_outcomes(spark, sf), _train(spark, sf))


@query
def gen_stats(spark: SparkSession, sf: str) -> DataFrame:
    shown = ["success_rate", "minutes", "rows_per_min"]
    return _stats(spark, sf).withColumns({c: M.rounded(F.col(c), 2) for c in shown})


@query
def gen_stats_total(spark: SparkSession, sf: str) -> DataFrame:
    total = L.stats_total(_stats(spark, sf))
    return total.withColumn("minutes", M.rounded(F.col("minutes"), 2))


@query
def stats_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = texts.stats_lines(_stats(spark, sf), OUTPUT)
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query
def stats_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics texts written and read back as typed rows."""
    path = new_path(spark, "stats")
    texts.write_stats(texts.stats_lines(_stats(spark, sf), OUTPUT), path)
    return texts.parse_stats(texts.scan_stats(spark, path))


@query
def completion_errors(spark: SparkSession, sf: str) -> DataFrame:
    return L.completion_errors(t.completions(spark, sf))


@query
def completion_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """The breaker's report from stored completions, without the log."""
    outcome = L.outcomes_of_completions(t.completions(spark, sf))
    return L.breaker_report(outcome, _totals(spark, sf))


@query
def gen_progress(spark: SparkSession, sf: str) -> DataFrame:
    log = t.attempts(spark, sf)
    return L.progress(L.outcomes(log), L.start_times(log), _totals(spark, sf))


@query
def error_rate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return L.error_rate_blocks(_outcomes(spark, sf))


@query
def error_runs(spark: SparkSession, sf: str) -> DataFrame:
    return L.error_runs(_outcomes(spark, sf))


@query
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return L.breaker_report(_outcomes(spark, sf), _totals(spark, sf))


def _sparse(outcome: DataFrame) -> DataFrame:
    """The same rows in the same order, with large, uneven gaps in ``idx``."""
    apart = F.col("idx") * GAP + F.col("idx") * F.col("idx") % SHIFT
    return outcome.withColumn("idx", apart)


@query
def error_rate_blocks_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return L.error_rate_blocks(_sparse(_outcomes(spark, sf)))


@query
def gen_progress_sparse(spark: SparkSession, sf: str) -> DataFrame:
    log = t.attempts(spark, sf)
    return L.progress(_sparse(L.outcomes(log)), L.start_times(log), _totals(spark, sf))


@query
def circuit_breaker_sparse(spark: SparkSession, sf: str) -> DataFrame:
    report = L.breaker_report(_sparse(_outcomes(spark, sf)), _totals(spark, sf))
    return report.drop("cut_idx")


#: Rounds over which the query deals the log.
BREAKER_ROUNDS = 4


@query
def breaker_by_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The breaker's report with its state carried through rounds that see only their own calls."""
    outcome = _outcomes(spark, sf)
    folder, state = new_path(spark, "breaker"), None
    last = _train(spark, sf).agg(F.max("idx")).first()[0] or 0
    for n in range(BREAKER_ROUNDS):
        low, high = (last + 1) * n // BREAKER_ROUNDS, (last + 1) * (n + 1) // BREAKER_ROUNDS
        own = outcome.where((F.col("idx") >= low) & (F.col("idx") < high))
        breaker.advance(own, state).write.parquet(f"{folder}/round={n}")
        state = spark.read.schema(breaker.STATE_SCHEMA).parquet(f"{folder}/round={n}")
    return breaker.report(state, _totals(spark, sf))


@query
def circuit_breaker_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept = L.apply_breaker(_outcomes(spark, sf))
    return L.synthetic_answers(kept)


@query
def backoff_totals(spark: SparkSession, sf: str) -> DataFrame:
    return L.backoff_totals(t.attempts(spark, sf))


@query
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    return L.pending_for(_train(spark, sf).select("idx", "question"), ASKED, t.attempts(spark, sf))


def _stubs() -> dict[str, _Drill]:
    """A stub per teacher, sent along with the tasks that call it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return {
        name: _Drill(factor, modulus, residues, t.OUTAGE[1:] if name == t.OUTAGE[0] else None)
        for name, factor, modulus, residues, _ in t.CALLS
    }


class _Drill:
    """A teacher that fails as often as the derived call log says it does."""

    def __init__(self, factor: int, modulus: int, residues: int, outage: tuple[int, int] | None):
        self.factor, self.modulus, self.residues, self.outage = factor, modulus, residues, outage

    def __call__(self) -> Provider:
        return self._answer

    def _answer(self, request: Request) -> str:
        idx = request.idx
        down = self.outage is not None and self.outage[0] <= idx <= self.outage[1]
        if down or idx * self.factor % self.modulus < self.residues:
            fails = 5
        else:
            fails = 2 if idx * self.factor % 11 == 0 else 0
        if request.attempt < fails:
            raise RuntimeError(
                ("HTTP 429 Too Many Requests", "Quota exceeded", "connection reset")[idx % 3]
            )
        return f"{len(request.prompt)} characters read by {request.teacher}"


@query
def complete_with_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Every training problem asked of three stub teachers, with retries."""
    prompts = chat.generation_prompts(_train(spark, sf), ASKED)
    log = complete(prompts, _stubs(), ASKED, sleep=lambda _seconds: None)
    return log.drop("at_s")


@query
def generate_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The breaker's report of a whole generation job that asks in rounds."""
    root = new_path(spark, "generate")
    quiet = lambda _seconds: None
    return jobs.generate(spark, _train(spark, sf), _stubs(), root, sleep=quiet, round_rows=ROUND_ROWS)


# --- sampling ------------------------------------------------------------------------------


@query
def sample_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.seeded_sample(_train(spark, sf), SMALL_ROWS)


@query
def sample_one(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.one_random_row(_train(spark, sf))


@query
def first_n(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.first_n(_test(spark, sf), fixed.TEST_ROWS)


# --- stores --------------------------------------------------------------------------------


@query
def problem_store(spark: SparkSession, sf: str) -> DataFrame:
    """Both splits written and one picked by the scan."""
    path = new_path(spark, "problems")
    sets.write_problems(t.problems(spark, sf), path)
    return sets.read_problems(spark, path, "test")


@query
def completion_store(spark: SparkSession, sf: str) -> DataFrame:
    """Completions written per teacher and two teachers scanned."""
    path = new_path(spark, "completions")
    store.write_completions(t.completions(spark, sf), path)
    return store.read_completions(spark, path, ["gpt", "gemini"])


@query
def raw_problem_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Training problems written in order as plain rows in uneven files, and numbered again."""
    path = new_path(spark, "raw-problems")
    _in_files(_train(spark, sf)).select("question", "answer").write.json(path)
    return sets.read_raw_problems(spark, path, "train")


@query
def teacher_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One teacher's completions written in order as plain rows, and numbered again."""
    path = new_path(spark, "teacher-file")
    own = t.completions(spark, sf).where("teacher = 'gpt'")
    _in_files(own).select("question", "answer", "synthetic_answer", "teacher").write.parquet(path)
    return store.read_teacher_file(spark, path)


def _in_files(rows: DataFrame) -> DataFrame:
    """Rows in the order of ``idx`` in uneven files, more of them the more rows there are."""
    part = F.floor(F.log2(1 + F.col("idx"))).alias("part")
    files = max(FILES, -(-rows.count() // ROWS_PER_FILE))
    return rows.repartitionByRange(files, part, "idx").sortWithinPartitions("idx")


@query
def results_document(spark: SparkSession, sf: str) -> DataFrame:
    """Nested results stored in two steps, base first, and read back with their samples."""
    test, predictions = _test(spark, sf), t.predictions(spark, sf)
    document = ResultsDocument(spark, new_path(spark, "results"), EVALUATION_RESULT)
    for labels in (TEACHERS.for_evaluation("base"), MODELS):
        chosen = grading.select_models(predictions, labels)
        graded = grading.grade(chosen, test)
        document.upsert(grading.evaluation_results(graded, grading.sample_rows(chosen, test)))
    return _flat_results(document.read())


@query
def results_format(spark: SparkSession, sf: str) -> DataFrame:
    """Nested results written through the format in two steps, base first, and read back by it."""
    test, predictions = _test(spark, sf), t.predictions(spark, sf)
    path = new_path(spark, "keyed")
    for labels in (TEACHERS.for_evaluation("base"), MODELS):
        chosen = grading.select_models(predictions, labels)
        samples = grading.sample_rows(chosen, test)
        keyed.upsert_results(grading.evaluation_results(grading.grade(chosen, test), samples), path)
    return _flat_results(keyed.read_results(spark, path))


def _flat_results(results: DataFrame) -> DataFrame:
    return results.select(
        "teacher", "accuracy", "correct", "total", F.posexplode("sample_predictions")
    ).select(
        "teacher",
        "accuracy",
        F.col("correct").alias("n_correct"),
        "total",
        F.col("pos").cast("bigint").alias("sample_no"),
        "col.*",
    )


@query
def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """One nested record per training run stored and read back flat.

    A run here starts and ends with the first and last order; the share of wrong answers stands
    in for the loss.
    """
    dates = t.load(spark, sf, "orders").agg(
        F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("ended_at")
    )
    accuracy = _accuracy(spark, sf).select("teacher", (1 - F.col("accuracy")).alias("final_loss"))
    runs = (
        _runs(spark, sf)
        .join(accuracy, "teacher")
        .withColumn("started_at", dates.select("started_at").scalar())
        .withColumn("ended_at", dates.select("ended_at").scalar())
        .withColumn("trainable_params", F.lit(fixed.TRAINABLE_PARAMS).cast("bigint"))
        .withColumn("total_params", F.lit(fixed.TOTAL_PARAMS).cast("bigint"))
    )
    records = jobs.log_training(spark, runs, new_path(spark, "training"), OUTPUT, "models")
    started = F.date_format("started_at", "yyyy-MM-dd").alias("started_on")
    flat = flat_training_records(records)
    return flat.select(*[started if c == "started_at" else c for c in flat.columns])


# --- streams -------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    # as a glob the path may be one file as well as a directory of files
    return spark.readStream.schema(t.SCHEMAS[table]).parquet(f"{sf}/{table}[.]parquet")


#: Buckets of the stores that the queries write.
BUCKETS = 8


def _store(spark: SparkSession, name: str) -> BucketedStore:
    return BucketedStore(spark, new_path(spark, name), BUCKETS)


def _stored_truth(spark: SparkSession, sf: str) -> DataFrame:
    """True answers written once; micro-batches read them in buckets."""
    store = _store(spark, "truth")
    store.write("truth", grading.true_answers(t.problems_of(spark, sf, "test")))
    return store.read("truth").hint(BOTH_LARGE)


@query
def bucketed_grading(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy from responses and true answers that were stored in buckets."""
    store = _store(spark, "graded")
    store.write("truth", grading.true_answers(t.problems_of(spark, sf, "test")))
    store.write("responses", t.predictions(spark, sf))
    truth = store.read("truth").hint(BOTH_LARGE)
    return grading.accuracy_by_teacher(grading.grade_against(store.read("responses"), truth))


@query
def bucketed_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Work still to do from problems and a log stored in buckets, the log in two appends."""
    store, log = _store(spark, "resumed"), t.attempts(spark, sf)
    store.write("problems", t.problems_of(spark, sf, "train").select("idx", "question"))
    for early in (True, False):
        store.write("log", log.where((F.col("attempt") == 0) == early), "append")
    return L.pending_for(store.read("problems").hint(BOTH_LARGE), ASKED, store.read("log"))


@query
def stream_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions as a stream, each model's figures replaced in the document as they grow."""
    truth = _stored_truth(spark, sf)
    live = live_accuracy(t.predictions_of(_stream(spark, sf, "events")), truth)
    document = ResultsDocument(spark, new_path(spark, "live"), live.schema)
    keep_results(live, document, new_path(spark, "live-state")).awaitTermination()
    return document.read()


@query
def stream_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Calls as a stream, errors per teacher counted as they arrive."""
    calls = t.attempts_of(t.train_problems(_stream(spark, sf, "orders")))
    live = live_errors(calls)
    document = ResultsDocument(spark, new_path(spark, "errors"), live.schema)
    keep_results(live, document, new_path(spark, "errors-state")).awaitTermination()
    return document.read()


@query
def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """The breaker's report kept while calls arrive, rows of each teacher judged in their order."""
    calls = t.attempts_of(t.train_problems(_stream(spark, sf, "orders")))
    live = live_breaker(L.outcomes(calls))
    document = ResultsDocument(spark, new_path(spark, "live-breaker"), live.schema)
    with own_state(spark):
        query = keep_results(live, document, new_path(spark, "live-breaker-state"))
    query.awaitTermination()
    return breaker.report(document.read(), _totals(spark, sf))


@query
def stream_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy over the last answer to each problem, while answers and corrections arrive."""
    given = t.predictions_of(_stream(spark, sf, "events"), corrected=True)
    graded = grading.grade_against(given, _stored_truth(spark, sf), keep=["seq"])
    schema = "teacher string, correct bigint, total bigint, accuracy double"
    document = ResultsDocument(spark, new_path(spark, "corrected"), T.StructType.fromDDL(schema))
    folder = new_path(spark, "corrections")
    with own_state(spark):
        query = keep_corrected(verdict_changes(graded), folder, document, new_path(spark, "corrections-state"))
    query.awaitTermination()
    return document.read()


# --- texts ---------------------------------------------------------------------------------


@query
def annotations(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.col("answer")
    return t.problems(spark, sf).select(
        "split",
        "idx",
        A.annotation_count(answer).alias("annotations"),
        F.array_join(A.annotation_expressions(answer), ";").alias("expressions"),
        F.array_join(A.annotation_results(answer), ";").alias("results"),
        A.without_annotations(answer).alias("plain"),
    )


@query
def style_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile_of(t.load(spark, sf, "documents"), "text", ["lang", "source"])


@query
def style_profile_teachers(spark: SparkSession, sf: str) -> DataFrame:
    return profile_of(t.completions(spark, sf), "synthetic_answer", ["teacher"])
