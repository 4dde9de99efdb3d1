"""Streams with state of their own: equal to the batch whatever the order of arrival, and after a restart."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from stillhouse.config import BreakerConfig
from stillhouse.operators import breaker
from stillhouse.sources.results import ResultsDocument
from stillhouse.streaming import stateful
from stillhouse.streaming.live import keep_results
from stillhouse.streaming.stateful import keep_corrected, live_breaker, own_state, verdict_changes

OUTCOME = "teacher string, idx bigint, ok boolean"


def _files(spark, rows, schema, path, n):
    """Rows in the order given, dealt to files that are read one by one."""
    size = -(-len(rows) // n)
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _outcomes(seed):
    rng, rows = random.Random(seed), []
    for teacher, rate in (("quiet", 0.02), ("poor", 0.55), ("runs", 0.2), ("dead", 1.0)):
        good = []
        while len(good) < 350:
            good += [False] * (rng.randint(5, 14) if teacher == "runs" and rng.random() < 0.01 else 0)
            good.append(rng.random() >= rate)
        rows += [(teacher, i, ok) for i, ok in enumerate(good[:350])]
    return rows


def _state(frame):
    columns = ("teacher", "processed", "kept", "errors", "trip_idx", "keeps")
    return {tuple(r[c] for c in columns) for r in frame.collect()}


@pytest.mark.parametrize("seed, far", [(1, 0), (2, 40), (3, 10**6)])
def test_live_breaker_equals_batch(spark, tmp_path, seed, far):
    """In order, nearly in order, and shuffled; some rows arrive twice."""
    rows = _outcomes(seed)
    rng = random.Random(seed)
    rows += rng.sample(rows, 30)
    arrived = sorted(rows, key=lambda r: r[1] + rng.random() * far)
    _files(spark, arrived, OUTCOME, str(tmp_path / "in"), 5)
    live = live_breaker(_stream(spark, OUTCOME, str(tmp_path / "in")))
    document = ResultsDocument(spark, str(tmp_path / "out"), live.schema)
    with own_state(spark):
        query = keep_results(live, document, str(tmp_path / "state"))
    query.awaitTermination()
    batch = breaker.advance(spark.createDataFrame(sorted(set(rows)), OUTCOME))
    assert _state(document.read()) == _state(batch)
    assert {r["waiting"] for r in document.read().collect()} == {0}
    assert len(query.recentProgress) >= 5


def test_live_breaker_goes_on_after_a_restart(spark, tmp_path):
    rows = _outcomes(5)
    random.Random(5).shuffle(rows)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        _files(spark, half, OUTCOME, source, 2)
        live = live_breaker(_stream(spark, OUTCOME, source))
        document = ResultsDocument(spark, out, live.schema)
        with own_state(spark):
            query = keep_results(live, document, state)
        query.awaitTermination()
    batch = breaker.advance(spark.createDataFrame(rows, OUTCOME))
    assert _state(document.read()) == _state(batch)


def test_waiting_rows_are_bounded(spark, tmp_path):
    _files(spark, [("a", i, True) for i in range(1, 60)], OUTCOME, str(tmp_path / "in"), 1)
    live = live_breaker(_stream(spark, OUTCOME, str(tmp_path / "in")), BreakerConfig(), most_ahead=50)
    document = ResultsDocument(spark, str(tmp_path / "out"), live.schema)
    with own_state(spark):
        query = keep_results(live, document, str(tmp_path / "state"))
    with pytest.raises(Exception, match="59 rows of a wait for row 0"):
        query.awaitTermination()


def _held(frames):
    return stateful._Runs(
        [f["start"].to_numpy(np.int64) for f in frames],
        [np.array([len(o) for o in f["oks"]], dtype=np.int64) for f in frames],
        [b"".join(f["oks"]) for f in frames],
    )


def test_rows_of_a_stream_are_handed_on_as_runs():
    """The one task of a teacher gets a row per run of consecutive rows, not a row per row."""
    rows = [(t, i, i % 7 > 0) for i in range(3_000) for t in "ab"]
    frames = list(stateful._in_runs(iter([pd.DataFrame(rows, columns=["teacher", "idx", "ok"])])))
    assert [(f["teacher"][0], len(f), f["start"][0], len(f["oks"][0])) for f in frames] == [
        ("a", 1, 0, 3_000), ("b", 1, 0, 3_000),
    ]


@pytest.mark.parametrize("seed", range(30))
def test_runs_that_overlap_hold_each_row_once(seed):
    """Gaps, repeats that disagree, rows without idx and below zero: the row that came first counts."""
    rng, size = random.Random(seed), 1 + seed % 9
    rows = [(rng.choice([None, -1.0, *map(float, range(40))]), rng.random() < 0.5) for _ in range(rng.randint(1, 60))]
    frames = [pd.DataFrame([("a", *r) for r in rows[n : n + size]], columns=["teacher", "idx", "ok"]) for n in range(0, len(rows), size)]
    held, seen, want = _held(list(stateful._in_runs(iter(frames)))), rng.randint(0, 3), {}
    for idx, ok in rows:
        if idx is not None and idx >= seen:
            want.setdefault(int(idx), ok)
    ready = next(i for i in range(seen, 50) if i not in want)
    late = sorted((i, ok) for i, ok in want.items() if i >= ready)
    assert (held.ready(seen), held.count(ready)) == (ready, len(late))
    got = [list(zip(*(part.tolist() for part in held.cut(*cut)))) for cut in [(seen, ready), *([(ready, None)] if late else [])]]
    assert got == [sorted((i, ok) for i, ok in want.items() if i < ready), *([late] if late else [])]


@pytest.mark.parametrize("at_once", [1, 7, 130])
def test_rows_judged_in_parts_equal_batch(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(stateful, "ROWS_AT_ONCE", at_once, raising=False)
    rows = _outcomes(9)
    _files(spark, rows, OUTCOME, str(tmp_path / "in"), 2)
    live = live_breaker(_stream(spark, OUTCOME, str(tmp_path / "in")))
    document = ResultsDocument(spark, str(tmp_path / "out"), live.schema)
    with own_state(spark):
        query = keep_results(live, document, str(tmp_path / "state"))
    query.awaitTermination()
    assert _state(document.read()) == _state(breaker.advance(spark.createDataFrame(rows, OUTCOME)))


GRADED = "teacher string, idx bigint, seq bigint, correct boolean"
FIGURES = (
    T.StructType().add("teacher", "string").add("correct", "long").add("total", "long").add("accuracy", "double")
)


@pytest.mark.parametrize("per_entry", [7, 4096])
def test_corrections_replace_what_was_counted(spark, tmp_path, per_entry):
    rng = random.Random(per_entry)
    rows = [(m, i, s, rng.random() < 0.5) for m in "ab" for i in range(100) for s in range(rng.randrange(1, 4))]
    last = {}
    for teacher, idx, seq, correct in sorted(rows):
        last[teacher, idx] = correct
    want = {m: (sum(v for (t, _), v in last.items() if t == m), 100) for m in "ab"}
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    document = ResultsDocument(spark, out, FIGURES)
    for half in (rows[::2], rows[1::2]):
        _files(spark, half, GRADED, source, 3)
        changes = verdict_changes(_stream(spark, GRADED, source), per_entry)
        with own_state(spark):
            query = keep_corrected(changes, str(tmp_path / "changes"), document, str(tmp_path / "state"))
        query.awaitTermination()
    assert {r["teacher"]: (r["correct"], r["total"]) for r in document.read().collect()} == want


def test_a_replayed_batch_counts_once(spark, tmp_path):
    """The same micro-batch again, as after a failure between writing and committing."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "changes")
    _files(spark, [("a", i, 0, i % 2 == 0) for i in range(10)], GRADED, source, 1)
    document = ResultsDocument(spark, str(tmp_path / "out"), FIGURES)
    for attempt in range(2):
        changes = verdict_changes(_stream(spark, GRADED, source))
        with own_state(spark):
            query = keep_corrected(changes, folder, document, str(tmp_path / f"state{attempt}"))
        query.awaitTermination()
        assert [tuple(r) for r in document.read().collect()] == [("a", 5, 10, 0.5)]


def test_the_store_of_state_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with own_state(spark):
        assert spark.conf.get(name) != before
    assert spark.conf.get(name) == before
