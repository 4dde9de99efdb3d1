"""From model responses to graded rows, accuracy, samples and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillhouse import fixed
from stillhouse.functions import answers as A
from stillhouse.functions import metrics as M
from stillhouse.functions.text import head_chars
from stillhouse.operators.ordered import Spread, first_rows, running


def select_models(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.where(F.col("teacher").isin(labels))


def predicted_answers(
    predictions: DataFrame, text: str = "response", keep: Sequence[Column | str] = ()
) -> DataFrame:
    """``teacher, idx, predicted, rule`` with the comparison forms beside them.

    Responses end here: what goes on to the join is a few short columns, not the texts.
    """
    hit = predictions.select("teacher", "idx", *keep, A.answer_hit(F.col(text)).alias("hit"))
    found = hit.select(
        *hit.columns[:-1],
        A.hit_answer(F.col("hit")).alias("predicted"),
        A.hit_rule(F.col("hit")).alias("rule"),
    )
    return _comparable(found, "predicted")


def true_answers(problems: DataFrame) -> DataFrame:
    truth = problems.select("idx", A.ground_truth(F.col("answer")).alias("ground_truth"))
    return _comparable(truth, "ground_truth")


def _comparable(df: DataFrame, column: str) -> DataFrame:
    bare = df.withColumn(f"_{column}_bare", A.bare(F.col(column)))
    return bare.withColumn(f"_{column}_value", A.numeric_value(F.col(f"_{column}_bare")))


def _verdict(df: DataFrame) -> DataFrame:
    same = A.same_answer(
        F.col("_predicted_bare"),
        F.col("_predicted_value"),
        F.col("_ground_truth_bare"),
        F.col("_ground_truth_value"),
    )
    return df.withColumn("correct", same)


def grade(predictions: DataFrame, problems: DataFrame) -> DataFrame:
    """One row per prediction: ``teacher, idx, ground_truth, predicted, rule, correct``.

    An equi-join on ``idx``, unique on the problem side, so a hot ``idx`` on the prediction side
    can be split by the skew join without copying more than one row.
    """
    return grade_against(predictions, true_answers(problems))


def grade_against(
    predictions: DataFrame, truth: DataFrame, keep: Sequence[Column | str] = ()
) -> DataFrame:
    """:func:`grade` against :func:`true_answers` made before, say once for all batches of a stream.

    The columns in ``keep`` are carried along.
    """
    joined = predicted_answers(predictions, keep=keep).join(truth, "idx")
    kept = [c for c in joined.columns if not c.startswith("_")]
    shown = ["teacher", "idx", "ground_truth", "predicted", "rule", "correct"]
    return _verdict(joined).select(*shown, *[c for c in kept if c not in shown])


def grade_short(predictions: DataFrame, problems: DataFrame) -> DataFrame:
    """:func:`grade` with the prototype's extractor on both sides; answers come normalized."""
    found = predictions.select(
        "teacher", "idx", A.extract_answer_short(F.col("response")).alias("predicted")
    )
    truth = problems.select(
        "idx", A.extract_answer_short(F.col("answer")).alias("ground_truth")
    )
    joined = _comparable(found, "predicted").join(_comparable(truth, "ground_truth"), "idx")
    return _verdict(joined).select(
        "teacher",
        "idx",
        A.normalize_answer(F.col("ground_truth")).alias("ground_truth"),
        A.normalize_answer(F.col("predicted")).alias("predicted"),
        "correct",
    )


def accuracy_by_teacher(graded: DataFrame, split: str = "test") -> DataFrame:
    """``split, teacher, correct, total, accuracy``; partial sums leave one row per task and model.

    ``split`` names the graded problem set. It is added to the few summary rows, so that the rows
    themselves need not carry it.
    """
    counts = graded.groupBy("teacher").agg(
        F.count_if("correct").alias("correct"), F.count("*").alias("total")
    )
    return counts.select(
        F.lit(split).alias("split"),
        "*",
        M.accuracy(F.col("correct"), F.col("total")).alias("accuracy"),
    )


def running_accuracy(graded: DataFrame, spread: Spread | None = None) -> DataFrame:
    """Accuracy in percent over the rows up to each one, in ``idx`` order, whatever gaps it has.

    ``spread`` tells how ``idx`` lies if that is known, say from the predictions before grading.
    """
    counted = running(
        graded.select("teacher", "idx", F.col("correct").cast("bigint").alias("correct")),
        ["teacher"],
        "idx",
        sums={"correct_so_far": "correct", "total_so_far": F.lit(1)},
        spread=spread,
    )
    share = M.ratio(F.col("correct_so_far"), F.col("total_so_far"))
    return counted.withColumns(
        {"correct": F.col("correct") == 1, "accuracy_pct": share * 100}
    )


def sample_rows(
    predictions: DataFrame,
    problems: DataFrame,
    rows: int = fixed.SAMPLE_ROWS,
    chars: int = fixed.SAMPLE_CHARS,
) -> DataFrame:
    """First predictions per model, graded, with question and shortened response.

    The rows are chosen by their keys alone. Their highest ``idx`` then bounds both scans, so of
    tables written in ``idx`` order only the first row groups have their texts read.
    """
    keys = first_rows(predictions.select("teacher", "idx"), ["teacher"], "idx", rows)
    near = F.col("idx") <= keys.agg(F.max("idx")).scalar()
    first = predictions.where(near).join(keys, ["teacher", "idx"], "left_semi")
    head = head_chars(F.col("response"), chars).alias("full_response")
    found = predicted_answers(first, keep=[head])
    return _verdict(_truth_with_question(problems.where(near)).join(found, "idx")).select(
        "teacher", "idx", "question", "ground_truth", "predicted", "full_response", "correct"
    )


def _truth_with_question(problems: DataFrame) -> DataFrame:
    truth = problems.select(
        "idx", "question", A.ground_truth(F.col("answer")).alias("ground_truth")
    )
    return _comparable(truth, "ground_truth")


def evaluation_results(graded: DataFrame, samples: DataFrame) -> DataFrame:
    """One nested result per model, in the layout of the results document."""
    item = F.struct(
        "idx",
        "question",
        "ground_truth",
        F.col("predicted").alias("predicted_answer"),
        "full_response",
        "correct",
    )
    lists = samples.groupBy("teacher").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sample_predictions = F.transform("items", lambda s: s.dropFields("idx"))
    return (
        accuracy_by_teacher(graded)
        .join(lists, "teacher", "left")
        .select(
            "teacher",
            "accuracy",
            "correct",
            "total",
            sample_predictions.alias("sample_predictions"),
        )
    )


def with_lift(accuracy: DataFrame, base: str = fixed.BASE, keep_base: bool = False) -> DataFrame:
    """Each model beside the base model of its problem set; none when there is no base.

    The base figure comes from a window over the few summary rows, not from a second pass over
    the predictions and not from a cross join.
    """
    per_set = Window.partitionBy("split")

    def of_base(column: str):
        return F.max(F.when(F.col("teacher") == base, F.col(column))).over(per_set)

    exact = M.ratio(F.col("correct"), F.col("total"))
    lifted = (
        accuracy.withColumn("_exact", exact)
        .withColumn("base_accuracy", of_base("accuracy"))
        .withColumn("_base_exact", of_base("_exact"))
        .where(F.col("base_accuracy").isNotNull())
    )
    if not keep_base:
        lifted = lifted.where(F.col("teacher") != base)
    points = F.col("accuracy") - F.col("base_accuracy")
    return lifted.select(
        *accuracy.columns,
        "base_accuracy",
        M.rounded(points, fixed.ACCURACY_DIGITS).alias("lift"),
        M.rounded(points * 100, 2).alias("lift_points"),
        M.percent_text(points, signed=True).alias("lift_text"),
        M.rounded(F.col("_exact") - F.col("_base_exact"), 6).alias("lift_exact"),
        M.direction(points).alias("direction"),
        M.rounded(M.relative_gain(F.col("accuracy"), F.col("base_accuracy")), 4).alias(
            "relative_gain"
        ),
    )


def leaderboard(accuracy: DataFrame, base: str = fixed.BASE) -> DataFrame:
    """All models best first, with lift over base."""
    by_accuracy = Window.partitionBy("split").orderBy(F.col("accuracy").desc())
    return (
        with_lift(accuracy, base, keep_base=True)
        .withColumn("place", F.rank().over(by_accuracy).cast("bigint"))
        .withColumn("label", M.model_label(F.col("teacher"), base))
        .orderBy("split", F.col("accuracy").desc(), "teacher")
    )


def best_model(accuracy: DataFrame, order: list[str]) -> DataFrame:
    """The model with the highest accuracy; the earlier one in ``order`` wins a tie."""
    position = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("teacher"))
    unlisted = F.when(position == 0, F.lit(len(order) + 1)).otherwise(position)
    return (
        accuracy.withColumn("_position", unlisted)
        .orderBy(F.col("accuracy").desc(), "_position", "teacher")
        .limit(1)
        .drop("_position")
    )


def summary_table(accuracy: DataFrame, base: str = fixed.BASE) -> DataFrame:
    return accuracy.select(
        M.model_label(F.col("teacher"), base).alias("model"),
        M.percent_text(F.col("accuracy")).alias("accuracy_pct"),
        "correct",
        "total",
    )


def beside_training(accuracy: DataFrame, runs: DataFrame) -> DataFrame:
    """Accuracy next to the facts of the training run; the base model has none."""
    return accuracy.join(runs, "teacher", "left")


def small_beside_full(small: DataFrame, full: DataFrame) -> DataFrame:
    """Two evaluations of the same models side by side; a model missing in one stays."""
    left = small.select(
        "teacher", F.col("accuracy").alias("small_accuracy"), F.col("total").alias("small_total")
    )
    right = full.select(
        "teacher", F.col("accuracy").alias("full_accuracy"), F.col("total").alias("full_total")
    )
    return left.join(right, "teacher", "full_outer")
