"""Running totals over blocks, positions and samples against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stillhouse.operators import sampling
from stillhouse.operators.ordered import (
    CONSECUTIVE,
    first_rows,
    in_ranges,
    range_shifts,
    rows_below_bound,
    running,
    spread_of,
    with_position,
)
from stillhouse.operators.sampling import first_n, seeded_sample


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_totals(spark, block):
    rng = random.Random(block)
    rows = []
    for key, n in (("hot", 300), ("cold", 20), ("one", 1), (None, 90)):
        positions = rng.sample(range(1000), n)
        rows += [(key, p, rng.randint(-5, 5), rng.choice([None, p])) for p in positions]
    frame = spark.createDataFrame(rows, "k string, p bigint, v bigint, mark bigint")
    got = running(
        frame, ["k"], "p", sums={"s": "v", "n": F.lit(1)}, maxima={"m": "mark"}, block_positions=block
    )
    want = set()
    for key in ("hot", "cold", "one", None):
        total, seen, top = 0, 0, None
        for k, p, v, mark in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total, seen = total + v, seen + 1
            top = mark if mark is not None else top
            want.add((k, p, v, mark, total, seen, top))
    assert {tuple(r) for r in got.collect()} == want


def test_running_shuffles_its_rows_once(spark):
    frame = spark.range(50_000).selectExpr("id % 3 as k", "id as p", "id % 7 as v")
    total = running(frame, ["k"], "p", sums={"s": "v"}, block_positions=1000)
    total.collect()
    plan = total._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_with_position(spark):
    rows = [("a", 5), ("a", 900), ("a", 17), ("b", 3)]
    frame = spark.createDataFrame(rows, "k string, o bigint")
    got = {tuple(r) for r in with_position(frame, ["k"], "o").collect()}
    assert got == {("a", 5, 0), ("a", 17, 1), ("a", 900, 2), ("b", 3, 0)}


@pytest.mark.parametrize("gap", [1, 5, 10_000])
def test_positions_and_totals_whatever_the_gaps(spark, gap):
    """A hot group, clusters and a group of one row: the gaps decide how they are dealt, not what comes out."""
    rng = random.Random(gap)
    rows = [("hot", gap * i + 3, i % 3) for i in range(3000)]
    rows += [("cluster", 10**12 * (i // 400) + i, 1) for i in range(1200)]
    rows += [("one", -5, 7), (None, 2**60, 1), (None, -(2**60), 2)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, p bigint, v bigint").repartition(7)
    want = {}
    for key in {r[0] for r in rows}:
        total = 0
        for place, (_, p, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            total += v
            want[key, p] = (place, total)
    placed = with_position(frame, ["k"], "p")
    assert {(r["k"], r["p"]): r["pos"] for r in placed.collect()} == {k: v[0] for k, v in want.items()}
    total = running(frame, ["k"], "p", sums={"s": "v"})
    assert {(r["k"], r["p"]): r["s"] for r in total.collect()} == {k: v[1] for k, v in want.items()}


def test_no_more_rows_are_carried_than_parts_and_groups(spark):
    frame = spark.range(40_000).selectExpr("id % 3 as k", "id * 10000 as p")
    assert not spread_of(frame, ["k"], "p").dense
    shifts = range_shifts(in_ranges(frame, ["k"], ["p"], 16), ["k"])
    assert shifts.count() <= 16 + 3
    sizes = [r["count"] for r in in_ranges(frame, ["k"], ["p"], 16).groupBy("_part").count().collect()]
    assert max(sizes) < 3 * 40_000 / 16
    assert spread_of(frame.where("false"), ["k"], "p") == CONSECUTIVE
    assert with_position(frame.where("false"), ["k"], "p").count() == 0


def test_dense_positions_are_not_counted(spark):
    frame = spark.range(1000).selectExpr("id % 2 as k", "id div 2 + 4 as p")
    placed = with_position(frame, ["k"], "p")
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert {r["pos"] - r["p"] for r in placed.collect()} == {-4}


def test_first_rows_and_first_n(spark):
    frame = spark.range(100).selectExpr("id % 2 as k", "id as idx")
    assert {r["idx"] for r in first_rows(frame, ["k"], "idx", 2).collect()} == {0, 1, 2, 3}
    assert first_n(frame, 7).count() == 7


def test_first_rows_number_few_rows(spark):
    rng = random.Random(2)
    rows = [("a", 10**12 * i, i) for i in range(3000)] + [(None, -i, i) for i in range(400)] + [("b", 5, 0), ("b", 7, 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, p bigint, v bigint").repartition(5)
    first = first_rows(frame, ["k"], "p", 5)
    want = {("a", 10**12 * i, i) for i in range(5)} | {(None, -i, i) for i in range(395, 400)} | {("b", 5, 0), ("b", 7, 1)}
    assert {tuple(r) for r in first.collect()} == want
    assert rows_below_bound(frame, ["k"], "p", 5).count() < 100


def test_sample_is_widened_until_it_is_whole(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_ROOTS", 0)
    monkeypatch.setattr(sampling, "_ROWS", 0.01)
    frame = spark.range(1000).withColumnRenamed("id", "idx")
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for n in (3, 400):
        assert {r[0] for r in seeded_sample(frame, n).collect()} == set(order[:n])
    assert seeded_sample(frame, 0).count() == 0
    plan = seeded_sample(frame, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Subquery" not in plan


@pytest.mark.parametrize("n", [1, 50, 999, 1000, 1500])
def test_seeded_sample(spark, n):
    frame = spark.range(1000).withColumnRenamed("id", "idx")
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert {r[0] for r in seeded_sample(frame, n).collect()} == set(order[:n])
    spread = frame.repartition(5)
    assert {r[0] for r in seeded_sample(spread, n).collect()} == set(order[:n])
    assert seeded_sample(spread, n).columns == ["idx"]
