"""The three jobs on a small problem set."""

import pytest

from stillhouse.config import BreakerConfig, EvalConfig
from stillhouse.plans import jobs
from stillhouse.sources.completions import read_completions
from stillhouse.sources.stats import parse_stats, scan_stats


@pytest.fixture(scope="module")
def problems(spark):
    rows = [(i, f"{i} and {i}?", f"twice\n#### {2 * i}") for i in range(120)]
    return spark.createDataFrame(rows, "idx bigint, question string, answer string")


def _teachers(broken):
    def teacher(name):
        def open_provider():
            def answer(request):
                if (name, request.idx) in broken:
                    raise RuntimeError("HTTP 429")
                return f"{name} says #### {2 * request.idx}"

            return answer

        return open_provider

    return {name: teacher(name) for name in ("gpt", "deepseek", "gemini")}


def test_generate_resume_and_train(spark, problems, tmp_path):
    root = str(tmp_path / "gen")
    outage = {("gemini", i) for i in range(30, 60)}
    single = {("gpt", 5)}

    def quiet(_seconds):
        return None

    report = jobs.generate(spark, problems, _teachers(outage | single), root, tasks=4, sleep=quiet)
    got = {r["teacher"]: r for r in report.collect()}
    assert (got["gemini"]["stop_reason"], got["gemini"]["kept"]) == ("consecutive", 39)
    assert (got["gpt"]["errors"], got["gpt"]["kept"]) == (1, 120)
    rows = read_completions(spark, f"{root}/completions")
    assert rows.where("teacher = 'gpt' and idx = 5").first()["synthetic_answer"] == "ERROR: HTTP 429"
    assert rows.groupBy("teacher").count().where("teacher = 'gemini'").first()["count"] == 39
    stats = {r["teacher"]: r for r in parse_stats(scan_stats(spark, f"{root}/stats")).collect()}
    assert (stats["gpt"]["total"], stats["gpt"]["errors"], stats["gpt"]["success_rate"]) == (120, 1, 99.17)

    # still down: the failures of the later run replace those of the earlier one
    again = jobs.generate(spark, problems, _teachers(single), root, sleep=quiet)
    got = {r["teacher"]: (r["stop_reason"], r["kept"], r["errors"]) for r in again.collect()}
    assert got == {
        "gpt": ("finished", 120, 1), "deepseek": ("finished", 120, 0), "gemini": ("finished", 120, 0),
    }
    log = spark.read.parquet(f"{root}/attempts")
    # the first job had a round of 20 problems and one of the rest
    assert log.where("run >= 2").select("teacher", "idx").distinct().count() == 31

    out = str(tmp_path / "text")
    jobs.training_text(spark, problems, f"{root}/completions", out)
    counts = {r["teacher"]: r["count"] for r in spark.read.parquet(out).groupBy("teacher").count().collect()}
    assert counts == {"gpt": 119, "deepseek": 120, "gemini": 120, "original": 120}


def _asked(spark, root):
    log = spark.read.parquet(f"{root}/attempts")
    rows = log.select("teacher", "idx").distinct().groupBy("teacher").count().collect()
    return {r["teacher"]: r["count"] for r in rows}


def test_stopped_teacher_is_asked_no_more(spark, problems, tmp_path):
    root = str(tmp_path / "gen")
    dead = {("gemini", i) for i in range(120)}
    sparse = problems.where("idx % 2 = 0")
    report = jobs.generate(
        spark, sparse, _teachers(dead), root, tasks=4, sleep=lambda _s: None, round_rows=20
    )
    got = {r["teacher"]: (r["stop_reason"], r["kept"]) for r in report.collect()}
    assert got == {"gpt": ("finished", 60), "deepseek": ("finished", 60), "gemini": ("consecutive", 9)}
    assert _asked(spark, root) == {"gpt": 60, "deepseek": 60, "gemini": 20}


def test_failed_job_keeps_earlier_rounds(spark, problems, tmp_path):
    root = str(tmp_path / "gen")
    marker = tmp_path / "fail"
    marker.touch()

    def breaking(name):
        def open_provider():
            def answer(request):
                if request.idx >= 50 and marker.exists():
                    raise SystemExit("killed")
                return f"#### {2 * request.idx}"

            return answer

        return open_provider

    teachers = {name: breaking(name) for name in ("gpt", "deepseek", "gemini")}
    (tmp_path / "gen" / "attempts").mkdir(parents=True)  # an empty log is no log
    with pytest.raises(Exception):
        jobs.generate(spark, problems, teachers, root, tasks=4, round_rows=40, first_rows=40)
    assert _asked(spark, root) == dict.fromkeys(teachers, 40)
    marker.unlink()
    report = jobs.generate(spark, problems, teachers, root, tasks=4, round_rows=40)
    assert {r["kept"] for r in report.collect()} == {120}
    log = spark.read.parquet(f"{root}/attempts")
    assert log.count() == 360
    minutes = parse_stats(scan_stats(spark, f"{root}/stats")).agg({"minutes": "max"}).first()[0]
    assert minutes < 1


def test_a_round_reads_only_its_own_calls(spark, problems, tmp_path, monkeypatch):
    """State is carried; the log of earlier rounds is not read again."""
    seen = []

    def watched(outcome, state=None, config=None):
        seen.append(outcome.select("idx").distinct().count())
        return advance(outcome, state, config)

    advance = jobs.stretches.advance
    monkeypatch.setattr(jobs.stretches, "advance", watched)
    root = str(tmp_path / "gen")
    report = jobs.generate(
        spark, problems, _teachers(set()), root, sleep=lambda _s: None, round_rows=50, first_rows=5
    )
    assert {r["kept"] for r in report.collect()} == {120}
    assert seen == [5, 50, 50, 15, 120]
    states = spark.read.parquet(f"{root}/breaker/run=2")
    assert {(r["teacher"], r["rows"]) for r in states.collect()} == {(t, 105) for t in _teachers(set())}


def test_a_round_is_a_handful_of_spark_jobs(spark, problems, tmp_path):
    """What a round costs whatever its size."""
    context, count = spark.sparkContext, {}
    for rounds, rows in ((2, 60), (8, 15)):
        context.setJobGroup(f"rounds-{rounds}", "")
        root = str(tmp_path / f"gen{rounds}")
        quiet = {"sleep": lambda _s: None, "round_rows": rows, "first_rows": rows}
        jobs.generate(spark, problems, _teachers(set()), root, **quiet)
        count[rounds] = len(context.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert (count[8] - count[2]) / 6 <= 8


def test_a_dead_teacher_costs_a_small_round(spark, problems, tmp_path):
    root = str(tmp_path / "gen")
    dead = {("gemini", i) for i in range(120)}
    jobs.generate(spark, problems, _teachers(dead), root, sleep=lambda _s: None)
    assert _asked(spark, root) == {"gpt": 120, "deepseek": 120, "gemini": jobs.FIRST_ROWS}


@pytest.mark.parametrize("rows", [0, 1, 19, 20, 21, 219, 220, 221, 1220, 5000])
def test_round_starts(rows):
    starts, rounds = jobs._round_starts(rows, 20, 1000)
    sizes, left = [], rows
    for size in [20, 200, *[1000] * 10]:
        if left > 0:
            sizes.append(min(size, left))
            left -= size
    assert rounds == len(sizes)
    assert starts == [0, 20, 220][: max(len(sizes), 0)] if rows <= 220 else starts == [0, 20, 220]


def test_time_between_jobs_does_not_count(spark, problems, tmp_path):
    """A job that failed is started again a long time after; its pause is no time of generation."""
    root, now, marker = str(tmp_path / "gen"), tmp_path / "now", tmp_path / "fail"
    marker.touch()

    def clock():
        return float(now.read_text())

    def breaking(name):
        def open_provider():
            def answer(request):
                if request.idx >= 50 and marker.exists():
                    raise SystemExit("killed")
                return f"#### {2 * request.idx}"

            return answer

        return open_provider

    teachers = {name: breaking(name) for name in ("gpt", "deepseek", "gemini")}
    now.write_text("1000")
    with pytest.raises(Exception):
        jobs.generate(spark, problems, teachers, root, tasks=2, round_rows=40, first_rows=40, clock=clock)
    marker.unlink()
    now.write_text("9000000")
    jobs.generate(spark, problems, teachers, root, tasks=2, round_rows=40, first_rows=40, clock=clock)
    log = spark.read.parquet(f"{root}/attempts")
    assert {r[0] for r in log.select("at_s").distinct().collect()} == {1000.0, 9000000.0}
    assert {r["minutes"] for r in parse_stats(scan_stats(spark, f"{root}/stats")).collect()} == {0.0}


def test_a_teacher_that_keeps_no_row_loses_what_an_earlier_job_kept(spark, problems, tmp_path):
    root = str(tmp_path / "gen")
    config = BreakerConfig(max_consecutive=1)
    dead = {("gemini", i) for i in range(120)}
    quiet = {"sleep": lambda _s: None, "breaker": config}
    jobs.generate(spark, problems.where("idx < 5"), _teachers(set()), root, **quiet)
    assert read_completions(spark, f"{root}/completions").where("teacher = 'gemini'").count() == 5
    report = jobs.generate(spark, problems.where("idx >= 5"), _teachers(dead), f"{root}", **quiet)
    got = {r["teacher"]: (r["kept"], r["errors"], r["stop_reason"]) for r in report.collect()}
    # The log has the five good answers of the first job, so the first failure trips after them.
    assert got["gemini"] == (5, 1, "consecutive")
    other = str(tmp_path / "other")
    jobs.generate(spark, problems.where("idx < 5"), _teachers(dead), other, **quiet)
    stored = read_completions(spark, f"{other}/completions")
    assert {r["teacher"] for r in stored.select("teacher").distinct().collect()} == {"gpt", "deepseek"}
    stats = {r["teacher"]: (r["successful"], r["errors"]) for r in parse_stats(scan_stats(spark, f"{other}/stats")).collect()}
    assert stats == {"gpt": (5, 0), "deepseek": (5, 0), "gemini": (0, 1)}


def test_one_variant_leaves_the_others(spark, problems, tmp_path):
    root, out = str(tmp_path / "gen"), str(tmp_path / "text")
    jobs.generate(spark, problems, _teachers(set()), root)
    jobs.training_text(spark, problems, f"{root}/completions", out)
    jobs.training_text(spark, problems, f"{root}/completions", out, choice="gpt")
    assert spark.read.parquet(out).select("teacher").distinct().count() == 4


def test_whole_test_set_is_graded(spark, tmp_path):
    rows = [(i, "q", f"#### {i}") for i in range(3_000)]
    problems = spark.createDataFrame(rows, "idx bigint, question string, answer string")
    predictions = problems.selectExpr("'base' as teacher", "idx", "answer as response")
    board = jobs.evaluate(spark, predictions, problems, str(tmp_path / "r"), "base")
    assert [(r["correct"], r["total"]) for r in board.collect()] == [(3_000, 3_000)]


def test_evaluate(spark, problems, tmp_path):
    rows = [
        (m, i, f"#### {2 * i + (i % wrong == 0)}")
        for m, wrong in (("base", 2), ("gpt", 4), ("deepseek", 5), ("gemini", 3), ("original", 1))
        for i in range(120)
    ]
    predictions = spark.createDataFrame(rows, "teacher string, idx bigint, response string")
    root = str(tmp_path / "results")
    config = EvalConfig(test_size=100)

    def board(choice):
        result = jobs.evaluate(spark, predictions, problems, root, choice, evaluation=config)
        return {r["teacher"]: (r["correct"], r["total"], r["lift_text"]) for r in result.collect()}

    assert board("gpt") == {}
    assert board("base") == {"base": (50, 100, "+0.00%"), "gpt": (75, 100, "+25.00%")}
    everyone = board("all")
    assert everyone["original"] == (0, 100, "-50.00%")
    assert set(everyone) == {"base", "gpt", "deepseek", "gemini", "original"}
