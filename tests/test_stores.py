"""Round trips of the stores, replacement by key, streams against batches."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillhouse.operators.attempts import missing_teachers
from stillhouse.operators.grading import accuracy_by_teacher, grade, grade_against, true_answers
from stillhouse.operators.upsert import upsert
from stillhouse.sources import completions as store
from stillhouse.sources import keyed
from stillhouse.sources import problems as sets
from stillhouse.sources.bucketed import BucketedStore
from stillhouse.sources.results import (
    EVALUATION_RESULT,
    ConflictError,
    ResultsDocument,
    read_document,
)
from stillhouse.streaming.live import keep_results, live_accuracy

SMALL = T.StructType([T.StructField("teacher", T.StringType()), T.StructField("n", T.LongType())])


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], SMALL)
    new = spark.createDataFrame([("b", 3), ("c", 4)], SMALL)
    assert _rows(upsert(old, new)) == [("a", 1), ("b", 3), ("c", 4)]
    again = spark.createDataFrame([("b", 5, 1), ("b", 6, 2)], "teacher string, n bigint, seq int")
    assert _rows(upsert(old, again, seq="seq")) == [("a", 1), ("b", 6)]


def test_document(spark, tmp_path):
    root = str(tmp_path / "doc")
    document = ResultsDocument(spark, root, SMALL)
    assert document.version() == 0 and document.read().count() == 0
    document.upsert(spark.createDataFrame([("b", 1), ("a", 1)], SMALL))
    document.upsert(spark.createDataFrame([("b", 2)], SMALL))
    assert document.version() == 2 and _rows(document.read()) == [("a", 1), ("b", 2)]
    parts = [f for f in os.listdir(f"{root}/version=2") if f.startswith("part")]
    records = [json.loads(line) for f in parts for line in open(f"{root}/version=2/{f}")]
    assert sorted(r["teacher"] for r in records) == ["a", "b"]
    for n in range(6):
        document.upsert(spark.createDataFrame([("b", n)], SMALL))
    assert document.version() == 8 and not os.path.exists(f"{root}/version=3")


def test_document_collision_fails(spark, tmp_path, monkeypatch):
    document = ResultsDocument(spark, str(tmp_path / "doc"), SMALL)
    document.upsert(spark.createDataFrame([("a", 1)], SMALL))
    monkeypatch.setattr(document, "version", lambda: 0)
    with pytest.raises(ConflictError):
        document.upsert(spark.createDataFrame([("b", 1)], SMALL))
    monkeypatch.undo()
    assert _rows(document.read()) == [("a", 1)]


def test_document_after_a_failed_and_a_killed_write(spark, tmp_path):
    root = tmp_path / "doc"
    document = ResultsDocument(spark, str(root), SMALL)
    document.upsert(spark.createDataFrame([("a", 1)], SMALL))
    broken = spark.range(4).selectExpr("string(id) as teacher", "assert_true(id < 2) is null as x", "id as n")
    with pytest.raises(Exception):
        document.upsert(broken.selectExpr("teacher", "if(x, n, n + 1) as n"))
    (root / "version=7" / "_temporary").mkdir(parents=True)
    assert document.version() == 1 and _rows(document.read()) == [("a", 1)]
    document.upsert(spark.createDataFrame([("b", 2)], SMALL))
    assert document.version() == 8 and _rows(document.read()) == [("a", 1), ("b", 2)]


def test_document_of_many_keys(spark, tmp_path):
    document = ResultsDocument(spark, str(tmp_path / "doc"), SMALL)
    document.upsert(spark.range(20_000).selectExpr("string(id) as teacher", "id as n"))
    document.upsert(spark.createDataFrame([("7", -1)], SMALL))
    assert document.read().count() == 20_000
    assert document.read().where("teacher = '7'").first()["n"] == -1


def test_scan_of_an_indented_document(spark, tmp_path):
    sample = {
        "question": "q", "ground_truth": "1", "predicted_answer": "1", "full_response": "#### 1",
        "correct": True,
    }
    record = {"accuracy": 0.5, "correct": 1, "total": 2, "sample_predictions": [sample]}
    document = {t: {"teacher": t, **record} for t in ("base", "gpt")}
    path = tmp_path / "results.json"
    path.write_text(json.dumps(document, indent=2))
    rows = read_document(spark, str(path), EVALUATION_RESULT).collect()
    assert {r["teacher"]: r["sample_predictions"][0]["full_response"] for r in rows} == {
        "base": "#### 1", "gpt": "#### 1",
    }


def test_completions_prune_and_replace(spark, tmp_path):
    path = str(tmp_path / "completions")

    def frame(*rows):
        return spark.createDataFrame(list(rows), store.COMPLETION_SCHEMA)

    store.write_completions(frame((0, "q", "a", "g", "gpt"), (0, "q", "a", "d", "deepseek")), path)
    store.write_completions(frame((0, "q", "a", "new", "gpt")), path)
    assert _rows(store.read_completions(spark, path).select("teacher", "synthetic_answer")) == [
        ("deepseek", "d"),
        ("gpt", "new"),
    ]
    one = store.read_completions(spark, path, ["gpt"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "teacher" in plan.split("PartitionFilters")[1]
    assert one.count() == 1


def test_teacher_file_is_numbered(spark, tmp_path):
    rows = [(f"q{i}", "a", f"s{i}", "gpt") for i in range(30)]
    schema = "question string, answer string, synthetic_answer string, teacher string"
    path = str(tmp_path / "gpt.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    got = store.read_teacher_file(spark, path).collect()
    assert sorted((r["idx"], r["question"]) for r in got) == [(i, f"q{i}") for i in range(30)]


def test_raw_problems_are_numbered_in_file_order(spark, tmp_path):
    sizes = [2, 400, 3, 0, 150]
    want = []
    for part, size in enumerate(sizes):
        questions = [f"q{part:02}{i:04}" for i in range(size)]
        want += questions
        lines = [json.dumps({"question": q, "answer": "a" * 50}) for q in questions]
        (tmp_path / f"part-{part}.json").write_text("".join(line + "\n" for line in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # the large file in several stretches
    try:
        rows = sets.read_raw_problems(spark, str(tmp_path), "train").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["question"] for r in sorted(rows, key=lambda r: r["idx"])] == want
    assert sorted(r["idx"] for r in rows) == list(range(len(want)))


def test_stream_over_many_files_equals_batch(spark, tmp_path):
    problems = spark.createDataFrame(
        [(i, f"#### {i}") for i in range(40)], "idx bigint, answer string"
    )
    schema = "teacher string, idx bigint, response string"
    source = str(tmp_path / "in")
    rows = [(m, i, f"#### {i + (i % k == 0)}") for m, k in (("a", 3), ("b", 5)) for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live = live_accuracy(stream, true_answers(problems))
    document = ResultsDocument(spark, str(tmp_path / "out"), live.schema)
    keep_results(live, document, str(tmp_path / "state")).awaitTermination()
    assert document.version() == 4
    batch = accuracy_by_teacher(grade(spark.createDataFrame(rows, schema), problems))
    assert _rows(document.read()) == _rows(batch)


# --- results as a format -----------------------------------------------------------------------

RESULT = "teacher string, accuracy double, correct bigint, notes array<struct<text:string,ok:boolean>>"


def _results(spark, *rows):
    return spark.createDataFrame([(t, c / 10, c, [(f"{t} {c}", c > 3)]) for t, c in rows], RESULT)


def test_keyed_results_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "results")
    keyed.upsert_results(_results(spark, ("a", 1), ("b", 2), ("c", 3)).repartition(3), path)
    keyed.upsert_results(_results(spark, ("b", 5), ("ü", 6)), path)
    want = _results(spark, ("a", 1), ("b", 5), ("c", 3), ("ü", 6))
    assert _rows(keyed.read_results(spark, path)) == _rows(want)
    assert keyed.read_results(spark, path).schema == want.schema
    keyed.compact(spark, path)
    assert _rows(keyed.read_results(spark, path)) == _rows(want)
    keyed.upsert_results(_results(spark, ("a", 9)), path)
    assert {r["teacher"]: r["correct"] for r in keyed.read_results(spark, path).collect()} == {"a": 9, "b": 5, "c": 3, "ü": 6}
    _results(spark, ("z", 1)).write.format(keyed.FORMAT).mode("overwrite").save(path)
    assert {r["teacher"] for r in keyed.read_results(spark, path).collect()} == {"z"}


def test_failed_write_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "results")
    keyed.upsert_results(_results(spark, ("a", 1), ("b", 2)), path)
    # one task writes its records, another one fails
    broken = (
        _results(spark, *((f"t{i}", i) for i in range(8)))
        .repartitionByRange(4, "teacher")
        .withColumn("accuracy", F.when(F.col("teacher") == "t7", F.raise_error(F.lit("broken"))).otherwise(0.5))
    )
    with pytest.raises(Exception, match="broken"):
        keyed.upsert_results(broken, path)
    assert {r["teacher"] for r in keyed.read_results(spark, path).collect()} == {"a", "b"}
    commits = list((tmp_path / "results" / "commits").iterdir())
    assert len(commits) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both start from the same layers; the keys of both are there afterwards."""
    path = str(tmp_path / "results")
    keyed.upsert_results(_results(spark, ("a", 1)), path)
    one = keyed._Writer(path, "teacher", 16, T.StructType.fromDDL(RESULT), False)
    two = keyed._Writer(path, "teacher", 16, T.StructType.fromDDL(RESULT), False)
    messages = [w.write(iter(_results(spark, (name, 4), ("a", n)).collect())) for w, name, n in ((one, "x", 7), (two, "y", 8))]
    two.commit([messages[1], None])
    one.commit([messages[0]])
    got = {r["teacher"]: r["correct"] for r in keyed.read_results(spark, path).collect()}
    assert got == {"a": 7, "x": 4, "y": 4}


def test_results_that_are_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="no results at"):
        keyed.read_results(spark, str(tmp_path / "nothing"))
    empty = _results(spark, ("a", 1)).where("false")
    keyed.upsert_results(empty, str(tmp_path / "empty"))
    assert keyed.read_results(spark, str(tmp_path / "empty")).collect() == []


# --- tables in buckets -------------------------------------------------------------------------


def _moved(frame):
    """Columns by which an executed plan deals rows out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_bucketed_grading_and_resume_move_nothing_by_idx(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "store"), 8)
    problems = spark.range(500).selectExpr("id as idx", "concat('q', id) as question", "concat('#### ', id) as answer")
    answers = spark.range(500).selectExpr("explode(array('a', 'b')) as teacher", "id as idx", "concat('#### ', id + id % 2) as response")
    store.write("truth", true_answers(problems))
    store.write("responses", answers)
    graded = accuracy_by_teacher(grade_against(store.read("responses"), store.read("truth").hint("merge")))
    assert {r["teacher"]: r["correct"] for r in graded.collect()} == {"a": 250, "b": 250}
    assert all("teacher" in c for c in _moved(graded))

    log = answers.where("idx % 3 = 0 or teacher = 'a'").selectExpr("teacher", "idx", "true as ok")
    store.write("problems", problems.select("idx", "question"))
    for part in (0, 1):
        store.write("log", log.where(f"idx % 2 = {part}"), "append")
    left = missing_teachers(store.read("problems").hint("merge"), ["a", "b"], store.read("log"))
    assert {r["idx"] for r in left.collect()} == {i for i in range(500) if i % 3}
    assert _moved(left) == []


def test_a_stream_meets_stored_truth_without_moving_it(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "store"), 8)
    problems = spark.range(300).selectExpr("id as idx", "concat('#### ', id) as answer")
    store.write("truth", true_answers(problems))
    truth = store.read("truth").hint("merge")
    batch = spark.range(40).selectExpr("'a' as teacher", "id as idx", "'#### 1' as response")
    joined = grade_against(batch, truth)
    # one exchange: that of the batch
    assert len(_moved(joined)) == 1


def test_a_store_of_another_session(spark, tmp_path):
    path = str(tmp_path / "store")
    store = BucketedStore(spark, path, 4)
    store.write("log", spark.range(50).selectExpr("id as idx", "id * 2 as v"))
    store.forget()
    again = BucketedStore(spark.newSession(), path, 4)
    assert again.exists("log") and not again.exists("other")
    by_idx = again.read("log").groupBy("idx").count()
    assert by_idx.count() == 50 and _moved(by_idx) == []
