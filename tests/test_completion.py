"""Asking stub teachers with retries."""

import pytest

from stillhouse.operators.completion import complete


def _flaky():
    """A factory made on the spot: executors cannot import this module."""

    def open_provider():
        def answer(request):
            if request.idx == 9 or request.attempt < request.idx % 3:
                raise RuntimeError("quota" if request.idx % 2 else "reset")
            return f"{request.teacher}:{request.prompt}"

        return answer

    return open_provider


def test_attempts(spark):
    rows = [(t, i, f"p{i}") for t in ("a", "b") for i in range(10)]
    requests = spark.createDataFrame(rows, "teacher string, idx bigint, prompt string")
    log = complete(requests, {"a": _flaky(), "b": _flaky()}, ["a", "b"], sleep=lambda s: None).cache()
    of_two = log.where("teacher = 'a' and idx = 2").orderBy("attempt").collect()
    assert [(r["attempt"], r["ok"], r["error"], r["completion"]) for r in of_two] == [
        (0, False, "reset", None),
        (1, False, "reset", None),
        (2, True, None, "a:p2"),
    ]
    given_up = log.where("idx = 9").collect()
    assert len(given_up) == 10 and not any(r["ok"] for r in given_up)


def test_waits(spark, tmp_path):
    waits = str(tmp_path / "waits")

    def note(seconds):
        with open(waits, "a") as out:
            out.write(f"{seconds}\n")

    requests = spark.createDataFrame([("a", 9, "p")], "teacher string, idx bigint, prompt string")
    complete(requests, {"a": _flaky()}, ["a"], sleep=note).collect()
    assert open(waits).read().split() == ["2.0", "6.0", "18.0", "54.0"]


def test_unknown_teacher_fails_before_the_job(spark):
    requests = spark.createDataFrame([("z", 0, "p")], "teacher string, idx bigint, prompt string")
    with pytest.raises(ValueError, match="z"):
        complete(requests, {"a": _flaky()}, ["z"])
