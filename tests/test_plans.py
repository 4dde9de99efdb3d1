"""Shapes of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from stillhouse.operators import grading
from stillhouse.plans import queries
from stillhouse.plans.queries import QUERIES
from stillhouse.sources import completions as store
from stillhouse.sources import tables

#: these act while they are built (they write, or run a stream), their frame is only the reading
_ACTING = {
    "stats_scan",
    "breaker_by_rounds",
    "bucketed_grading",
    "bucketed_pending",
    "stream_breaker",
    "stream_corrections",
    "generate_rounds",
    "problem_store",
    "completion_store",
    "results_document",
    "results_format",
    "training_log",
    "stream_accuracy",
    "stream_errors",
}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - _ACTING))
def test_no_pairing_of_everything_with_everything(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["gen_prompts", "eval_prompts", "train_text_by_teacher", "annotations"])
def test_text_jobs_do_not_shuffle(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    kinds = set(re.findall(r"Exchange (\w+)", plan))
    assert kinds <= {"RoundRobinPartitioning"}  # spreading a small file over the cores


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = _plan(QUERIES["leaderboard_lift"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {
        "event_id:bigint,user_id:bigint"
    }
    for name in ("error_rate_blocks", "circuit_breaker", "circuit_breaker_sparse"):
        scans = [line for line in _plan(QUERIES[name](spark, sf_dir)).split("\n") if "orders.parquet" in line]
        read = {columns for line in scans for columns in re.findall(r"ReadSchema: struct<([^>]*)>", line)}
        assert scans and read <= {"", "o_orderkey:bigint"}


def test_split_filter_leaves_one_scan(spark, sf_dir):
    plan = _plan(tables.problems(spark, sf_dir).where("split = 'test'"))
    assert "events.parquet" in plan and "orders.parquet" not in plan


def test_first_n_reaches_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["first_n"](spark, sf_dir))
    assert "LessThan(event_id,1319)" in plan


def test_responses_are_not_shuffled_for_grading(spark, tmp_path):
    spark.createDataFrame(
        [("m", 1, "#### 2")], "teacher string, idx bigint, response string"
    ).write.parquet(str(tmp_path / "p"))
    predictions = spark.read.parquet(str(tmp_path / "p"))
    problems = spark.createDataFrame([(1, "#### 2")], "idx bigint, answer string").hint("merge")
    graded = grading.accuracy_by_teacher(grading.grade(predictions, problems))
    formatted = spark._jvm.PythonSQLUtils.explainString(
        graded._jdf.queryExecution(), "formatted"
    )
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    assert exchanges and not any("response" in columns for columns in exchanges)


def test_sample_texts_are_bounded_by_index(spark, tmp_path):
    rows = spark.range(1000).select(
        F.lit("m").alias("teacher"), F.col("id").alias("idx"), F.lit("#### 1").alias("response")
    )
    rows.write.parquet(str(tmp_path / "p"))
    predictions = spark.read.parquet(str(tmp_path / "p"))
    problems = spark.range(1000).selectExpr("id as idx", "'q' as question", "'#### 1' as answer")
    samples = grading.sample_rows(predictions, problems)
    assert samples.count() == 5
    scans = re.findall(r"DataFilters: \[([^\]]*)\]", _plan(samples))
    assert any("subquery" in s for s in scans)


def test_numbering_a_teacher_file_does_not_shuffle_texts(spark, tmp_path, monkeypatch):
    """Files hold a bounded number of rows; few files or stretches don't send all rows to few tasks."""
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 100, raising=False)
    rows = spark.range(2_000).selectExpr(
        "id as idx", "cast(id as string) as question", "'a' as answer", "'s' as synthetic_answer", "'gpt' as teacher"
    )
    files = queries._in_files(rows)
    assert files.rdd.getNumPartitions() == 20
    files.drop("idx").write.parquet(str(tmp_path / "t"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        numbered = store.read_teacher_file(spark, str(tmp_path / "t"))
        plan = _plan(numbered)
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert all(str(r["idx"]) == r["question"] for r in numbered.collect())
        assert numbered.agg(F.count_distinct("idx")).first()[0] == 2_000
    finally:
        spark.conf.set(threshold, before)
