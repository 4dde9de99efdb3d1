"""The attempt log: circuit breaker against a row loop, runs, blocks, retries."""

import random

import pytest
from pyspark.sql import functions as F

from stillhouse.config import BreakerConfig, RetryConfig
from stillhouse.functions.retry import backoff_seconds, is_rate_limit
from stillhouse.operators import attempts as L
from stillhouse.operators import breaker


def _sequence(rng):
    """350 outcomes with bursts, so that both rules trip now and then."""
    good, rate = [], rng.choice([0.02, 0.2, 0.45, 0.55])
    while len(good) < 350:
        if rng.random() < 0.01:
            good += [False] * rng.randint(5, 14)
        good.append(rng.random() >= rate)
    return good[:350]


def _stop(good):
    """Rows kept, rows processed, errors and reason of one sequence, row by row."""
    errors = run = 0
    for i, ok in enumerate(good):
        run = 0 if ok else run + 1
        errors += not ok
        if run == 10:
            return i, i + 1, errors, "consecutive"
        if i % 100 == 99 and good[i - 99 : i + 1].count(False) > 50:
            return i + 1, i + 1, errors, "error_rate"
    return len(good), len(good), errors, "finished"


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(7)
    return {f"t{n:02}": _sequence(rng) for n in range(60)}


@pytest.fixture(scope="module")
def outcome(spark, sequences):
    rows = [(t, i, ok) for t, good in sequences.items() for i, ok in enumerate(good)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "teacher string, idx bigint, ok boolean").cache()


@pytest.mark.parametrize("blocks", [40, 1, 2])
def test_breaker_like_row_loop(spark, outcome, sequences, monkeypatch, blocks):
    monkeypatch.setattr(breaker, "STRETCH_BLOCKS", blocks)
    totals = spark.createDataFrame([(t, 350) for t in sequences], "teacher string, total bigint")
    got = {
        r["teacher"]: (r["kept"], r["processed"], r["errors"], r["stop_reason"])
        for r in L.breaker_report(outcome, totals).collect()
    }
    want = {t: _stop(good) for t, good in sequences.items()}
    assert got == want
    assert {reason for *_, reason in want.values()} == {"consecutive", "error_rate", "finished"}

    kept = {r["teacher"]: r["n"] for r in _counts(L.apply_breaker(outcome))}
    assert kept == {t: n for t, (n, *_) in want.items() if n}


def test_gaps_in_idx_make_no_difference(spark, outcome, sequences):
    sparse = outcome.withColumn("idx", F.col("idx") * 7 + F.when(F.col("idx") % 3 == 0, 5).otherwise(0))
    totals = spark.createDataFrame([(t, 350) for t in sequences], "teacher string, total bigint")
    got = {
        r["teacher"]: (r["kept"], r["processed"], r["errors"], r["stop_reason"])
        for r in L.breaker_report(sparse, totals).collect()
    }
    assert got == {t: _stop(good) for t, good in sequences.items()}
    tripping = {r["teacher"] for r in L.error_runs(sparse).where("trips").collect()}
    stopped = {t for t, (*_, reason) in got.items() if reason == "consecutive"}
    assert stopped <= tripping
    blocks = {tuple(r) for r in L.error_rate_blocks(outcome).collect()}
    assert {tuple(r) for r in L.error_rate_blocks(sparse).collect()} == blocks


@pytest.mark.parametrize("cuts", [(5, 9, 14, 100), (95, 103, 104, 207, 350), (1, 2, 349)])
def test_breaker_carried_through_rounds(spark, outcome, sequences, tmp_path, cuts):
    """Rounds that end anywhere, each with its own rows and the state of the one before."""
    low, state = 0, None
    for n, high in enumerate((*cuts, 400)):
        path = str(tmp_path / f"{n}")
        own = outcome.where((F.col("idx") >= low) & (F.col("idx") < high))
        breaker.advance(own, state).write.parquet(path)
        state, low = spark.read.schema(breaker.STATE_SCHEMA).parquet(path), high
        assert state.count() == len(sequences)
    totals = spark.createDataFrame([(t, 350) for t in sequences], "teacher string, total bigint")
    got = {
        r["teacher"]: (r["kept"], r["processed"], r["errors"], r["stop_reason"])
        for r in breaker.report(state, totals).collect()
    }
    assert got == {t: _stop(good) for t, good in sequences.items()}


@pytest.mark.parametrize("reach, block, cuts", [(10, 100, (5, 103, 207)), (25, 10, (1, 2, 349)), (130, 100, (95, 200))])
def test_a_small_round_is_judged_as_any_other(spark, outcome, reach, block, cuts):
    """Also where a teacher has tripped, has no rows in a round, or comes in later."""
    config = BreakerConfig(max_consecutive=reach, block_rows=block, block_error_rate=0.5)
    missing = (F.col("teacher") == "t00") & (F.col("idx") < cuts[0]) | (F.col("teacher") == "t01") & (F.col("idx") >= cuts[0])
    low, states = 0, [None, None]
    for high in (*cuts, 400):
        own = outcome.where((F.col("idx") >= low) & (F.col("idx") < high) & ~missing)
        new = [breaker.advance(f, s, config).toArrow() for f, s in zip((own, breaker.in_one_round(own)), states)]
        by_teacher = [sorted(map(str, t.to_pylist())) for t in new]
        assert by_teacher[0] == by_teacher[1]
        states, low = [spark.createDataFrame(t, breaker.STATE_SCHEMA) for t in new], high


@pytest.mark.parametrize("reach, block", [(1, 10), (3, 7), (25, 10), (130, 100)])
def test_breaker_settings(spark, outcome, sequences, monkeypatch, reach, block):
    """Runs longer than a block and than a stretch, and runs of one."""
    monkeypatch.setattr(breaker, "STRETCH_BLOCKS", 2)
    config = BreakerConfig(max_consecutive=reach, block_rows=block, block_error_rate=0.9)
    dead = [("dead", i, i < 40) for i in range(350)]
    frame = outcome.unionByName(spark.createDataFrame(dead, outcome.schema))
    want = {}
    for teacher, good in {**sequences, "dead": [ok for *_, ok in dead]}.items():
        run, want[teacher] = 0, None
        for i, ok in enumerate(good):
            run = 0 if ok else run + 1
            if run == reach:
                want[teacher] = (i, 0)
            elif i % block == block - 1 and good[i - block + 1 : i + 1].count(False) / block > 0.9:
                want[teacher] = (i, 1)
            if want[teacher]:
                break
    got = {r["teacher"]: (r["trip_idx"], r["keeps"]) for r in L.breaker_cuts(frame, config).collect()}
    assert got == {t: w for t, w in want.items() if w}


def _counts(frame):
    return frame.groupBy("teacher").agg(F.count("*").alias("n")).collect()


def test_error_runs(spark, outcome, sequences):
    want = set()
    for teacher, good in sequences.items():
        start = None
        for i, ok in enumerate([*good, True]):
            if not ok and start is None:
                start = i
            if ok and start is not None:
                want.add((teacher, start, i - 1, i - start, i - start >= 10))
                start = None
    assert {tuple(r) for r in L.error_runs(outcome).collect()} == want


def test_last_partial_block_is_not_judged(spark):
    rows = [("a", i, False) for i in range(99)] + [("b", i, i >= 51) for i in range(100)]
    frame = spark.createDataFrame(rows, "teacher string, idx bigint, ok boolean")
    blocks = L.error_rate_blocks(frame).collect()
    assert [(r["teacher"], r["errors"], r["trips"]) for r in blocks] == [("b", 51, True)]


def test_half_of_a_block_is_not_over_the_threshold(spark):
    rows = [("b", i, i % 2 == 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "teacher string, idx bigint, ok boolean")
    assert [r["trips"] for r in L.error_rate_blocks(frame).collect()] == [False]


def test_backoff(spark):
    rows = [("HTTP 429", a) for a in range(5)] + [("Quota exceeded", 1), ("reset", 3), (None, 0)]
    frame = spark.createDataFrame(rows, "error string, attempt int").coalesce(1)
    waits = frame.select(backoff_seconds(F.col("error"), F.col("attempt"))).collect()
    assert [r[0] for r in waits] == [2.0, 6.0, 18.0, 54.0, None, 6.0, 16.0, None]
    limits = frame.select(is_rate_limit(F.col("error"))).collect()
    assert [r[0] for r in limits] == [True] * 6 + [False, None]


def test_outcome_is_the_settling_attempt(spark):
    rows = [
        ("a", 0, 0, True),
        ("a", 1, 0, False),
        ("a", 1, 1, True),
        *[("a", 2, n, False) for n in range(5)],
        ("a", 3, 0, False),
    ]
    log = spark.createDataFrame(rows, "teacher string, idx bigint, attempt bigint, ok boolean")
    settled = {(r["idx"], r["attempt"], r["ok"]) for r in L.outcomes(log).collect()}
    assert settled == {(0, 0, True), (1, 1, True), (2, 4, False)}
    two = L.outcomes(log, RetryConfig(max_tries=2))
    assert {r["idx"] for r in two.collect()} == {0, 1, 2}

    work = spark.createDataFrame([("a", i) for i in range(5)], "teacher string, idx bigint")
    assert {r["idx"] for r in L.pending(work, log).collect()} == {2, 3, 4}
    assert {r["idx"] for r in L.pending(work, log, retry_errors=False).collect()} == {3, 4}
