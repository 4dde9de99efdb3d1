"""Published figures, lift, ties and samples."""

import pytest
from pyspark.sql import functions as F

from stillhouse.config import TeacherConfig
from stillhouse.functions import metrics as M
from stillhouse.operators import grading as G

PUBLISHED = {"base": 804, "gpt": 886, "gemini": 822, "deepseek": 852, "original": 624}


@pytest.fixture(scope="module")
def accuracy(spark):
    rows = [(t, i < right) for t, right in PUBLISHED.items() for i in range(1319)]
    return G.accuracy_by_teacher(spark.createDataFrame(rows, "teacher string, correct boolean"))


def test_published_accuracy(accuracy):
    got = {r["teacher"]: (r["accuracy"], r["correct"], r["total"]) for r in accuracy.collect()}
    assert got == {
        "base": (0.6096, 804, 1319),
        "gpt": (0.6717, 886, 1319),
        "gemini": (0.6232, 822, 1319),
        "deepseek": (0.6459, 852, 1319),
        "original": (0.4731, 624, 1319),
    }


def test_published_lift(accuracy):
    rows = G.leaderboard(accuracy).collect()
    assert [(r["teacher"], r["lift_text"]) for r in rows] == [
        ("gpt", "+6.21%"),
        ("deepseek", "+3.63%"),
        ("gemini", "+1.36%"),
        ("base", "+0.00%"),
        ("original", "-13.65%"),
    ]
    assert rows[0]["relative_gain"] == 0.1019
    assert rows[4]["direction"] == "degradation"
    assert {r["teacher"] for r in G.with_lift(accuracy).collect()} == set(PUBLISHED) - {"base"}


def test_no_lift_without_base(accuracy):
    assert G.with_lift(accuracy.where("teacher <> 'base'")).count() == 0


def test_first_listed_model_wins_a_tie(spark):
    tied = spark.createDataFrame(
        [("a", 0.5), ("b", 0.7), ("c", 0.7)], "teacher string, accuracy double"
    )
    assert G.best_model(tied, ["a", "c", "b"]).first()["teacher"] == "c"
    assert G.best_model(tied, ["a"]).first()["teacher"] == "b"


def test_beside_training_and_small_run(spark, accuracy):
    runs = spark.createDataFrame(
        [
            ("gpt", 65.31, 0.2339),
            ("deepseek", 54.0, 0.3778),
            ("gemini", 45.95, 0.3434),
            ("original", 37.7, 0.3952),
        ],
        "teacher string, time_minutes double, final_loss double",
    )
    loss = {r["teacher"]: r["final_loss"] for r in G.beside_training(accuracy, runs).collect()}
    known = {r["teacher"]: r["final_loss"] for r in runs.collect()}
    assert loss == {"base": None, **known}
    small = spark.createDataFrame(
        [("gpt", 0.67, 100), ("new", 0.5, 100)], "teacher string, accuracy double, total bigint"
    )
    both = {
        r["teacher"]: (r["small_accuracy"], r["full_accuracy"])
        for r in G.small_beside_full(small, accuracy).collect()
    }
    assert both["gpt"] == (0.67, 0.6717)
    assert both["new"] == (0.5, None) and both["base"] == (None, 0.6096)


def test_samples_are_first_rows_with_short_text(spark):
    predictions = spark.createDataFrame(
        [("m", i, "y" * 600 + f" #### {i}") for i in range(20)], "teacher string, idx bigint, response string"
    )
    problems = spark.createDataFrame(
        [(i, f"q{i}", f"r #### {i % 2}") for i in range(20)], "idx bigint, question string, answer string"
    )
    rows = G.sample_rows(predictions, problems).orderBy("idx").collect()
    assert [(r["idx"], r["predicted"], r["correct"], len(r["full_response"])) for r in rows] == [
        (0, "0", True, 500), (1, "1", True, 500), (2, "2", False, 500), (3, "3", False, 500), (4, "4", False, 500),
    ]


def test_rounding_is_that_of_the_double(spark):
    values = [224.85, 0.125, 0.375, 2.675, 1027.6]
    frame = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for digits in (1, 2):
        got = frame.select(M.fixed_text(F.col("v"), digits), M.rounded(F.col("v"), digits)).collect()
        assert [tuple(r) for r in got] == [(f"{v:.{digits}f}", round(v, digits)) for v in values]


def test_training_steps(spark):
    steps = M.training_steps(F.lit(7473), M.effective_batch(F.lit(4), F.lit(4)), F.lit(2))
    assert spark.range(1).select(steps).first()[0] == 936


def test_choices():
    config = TeacherConfig()
    assert config.for_evaluation("all") == ["base", "gpt", "deepseek", "gemini", "original"]
    assert config.for_evaluation("base") == ["base"]
    assert config.for_training("all") == ["gpt", "deepseek", "gemini", "original"]
    with pytest.raises(ValueError):
        config.for_training("base")
