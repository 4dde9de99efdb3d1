"""Problem sets, predictions and call logs derived from the given tables.

Every order is a training problem and every event a test problem; all rows are used. Their keys
are dense from 0 and unique, so they are the row index. The tables built here are plain
projections and explodes of a scan: no row is collected, joined or shuffled to make them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse import fixed

# Columns of the given tables that are used.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "events": "event_id bigint, user_id bigint, event_type string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
# Fixed values: (model, factor, modulus) of the share of wrong answers.
MODELS = (
    ("base", 3, 4),
    ("gpt", 2, 10),
    ("deepseek", 5, 8),
    ("gemini", 7, 6),
    ("original", 1, 2),
)
# Fixed values: (teacher, factor, modulus, failing residues, seconds per problem).
CALLS = (
    ("gpt", 3, 29, 1, 8),
    ("deepseek", 5, 31, 1, 9),
    ("gemini", 7, 5, 3, 5),
)
# Problems for which one teacher is down.
OUTAGE = ("deepseek", 700, 730)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan of the columns in use; Spark's own settings decide how it is split."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _grouped(value: str) -> str:
    """Whole number below a million with a thousands comma."""
    thousands = f"concat({value} div 1000, ',', lpad({value} % 1000, 3, '0'))"
    return f"if({value} >= 1000, {thousands}, string({value}))"


def _worked(unit: str) -> str:
    """Solution text of ``n`` times ``price`` with its annotation and the marked answer."""
    return (
        "concat('The total is ', n, '*', price, '=<<', n, '*', price, '=', n * price, '>>', "
        rf"n * price, ' {unit}.\n#### ', {_grouped('(n * price)')})"
    )


def train_problems(orders: DataFrame) -> DataFrame:
    numbers = orders.selectExpr(
        "o_orderkey as idx", "1 + o_orderkey % 50 as n", "1 + o_custkey % 97 as price"
    )
    return numbers.selectExpr(
        "idx",
        "'train' as split",
        "concat('An order has ', n, ' items at ', price, ' dollars each. What is the total?')"
        " as question",
        f"{_worked('dollars')} as answer",
    )


def test_problems(events: DataFrame) -> DataFrame:
    numbers = events.selectExpr(
        "event_id as idx", "event_type", "1 + event_id % 50 as n", "1 + user_id % 97 as price"
    )
    return numbers.selectExpr(
        "idx",
        "'test' as split",
        "concat('A user logs ', n, ' events of kind ', event_type, ' worth ', price,"
        " ' points each. How many points is that?') as question",
        f"{_worked('points')} as answer",
    )


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both splits; a filter on ``split`` leaves only the one table to scan."""
    return problems_of(spark, sf_dir, "train").unionByName(problems_of(spark, sf_dir, "test"))


def problems_of(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    if split == "train":
        return train_problems(load(spark, sf_dir, "orders"))
    return test_problems(load(spark, sf_dir, "events"))


def predictions_of(events: DataFrame, corrected: bool = False) -> DataFrame:
    """Five models answering every test problem in five styles, each wrong at its own rate.

    With ``corrected`` there is a column ``seq``, and one problem in seven is answered twice: the
    second answer is right where ``idx`` is even and wrong elsewhere.
    """
    models = ", ".join(
        f"struct('{name}' as teacher, {factor}L as factor, {modulus}L as modulus)"
        for name, factor, modulus in MODELS
    )
    given = events.selectExpr(
        "event_id as idx",
        "(1 + event_id % 50) * (1 + user_id % 97) as total",
        f"inline(array({models}))",
    )
    off, seq = "if((idx div 7) * factor % modulus = 0, 1, 0)", []
    if corrected:
        given = given.selectExpr("*", "explode(sequence(0L, if(idx % 7 = 3, 1L, 0L))) as seq")
        off, seq = f"if(seq = 1, idx % 2, {off})", ["seq"]
    given = given.selectExpr("teacher", "idx", f"total + {off} as given", *seq)
    response = rf"""case idx % 5
        when 0 then concat('Work shown.\n#### ', {_grouped("given")})
        when 1 then concat('So the answer is ', given, '.')
        when 2 then concat('total = ', given, '\n')
        when 3 then concat('It comes to ', given, ' dollars')
        else concat('#### $', given, '.00') end as response"""
    return given.selectExpr("teacher", "idx", response, *seq)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(load(spark, sf_dir, "events"))


def _requests(problem_set: DataFrame) -> DataFrame:
    """One row per problem and teacher with the failed calls before the answer; five if none."""

    def call(name: str, factor: int, modulus: int, residues: int, seconds: int) -> str:
        down = f"idx between {OUTAGE[1]} and {OUTAGE[2]} or " if name == OUTAGE[0] else ""
        fails = (
            f"case when {down}idx * {factor} % {modulus} < {residues} then 5L "
            f"when idx * {factor} % 11 = 0 then 2L else 0L end"
        )
        return f"struct('{name}' as teacher, {seconds}L as seconds, {fails} as fails)"

    calls = ", ".join(call(*c) for c in CALLS)
    return problem_set.selectExpr("idx", "question", "answer", f"inline(array({calls}))")


_ERROR = """case idx % 3 when 0 then 'HTTP 429 Too Many Requests'
    when 1 then 'Quota exceeded' else 'connection reset' end"""
_TAUGHT = r"concat('Step 1: multiply.\n', answer)"


def attempts_of(problem_set: DataFrame) -> DataFrame:
    calls = _requests(problem_set).selectExpr(
        "*", f"explode(sequence(0L, least(fails, {fixed.MAX_TRIES - 1}L))) as attempt"
    )
    return calls.selectExpr(
        "teacher",
        "idx",
        "attempt",
        "attempt = fails as ok",
        f"if(attempt = fails, null, {_ERROR}) as error",
        f"if(attempt = fails, {_TAUGHT}, null) as completion",
        "idx * seconds + attempt as at_s",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three teachers asked for every training problem, up to five calls each."""
    return attempts_of(problems_of(spark, sf_dir, "train"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per teacher and training problem, the question carried along."""
    failure = f"concat('{fixed.ERROR_MARK} ', {_ERROR})"
    return _requests(problems_of(spark, sf_dir, "train")).selectExpr(
        "idx",
        "question",
        "answer",
        f"if(fails < {fixed.MAX_TRIES}, {_TAUGHT}, {failure}) as synthetic_answer",
        "teacher",
    )
