"""Extraction, normalization and comparison of single answers."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stillhouse.functions import answers as A

EXTRACTED = [
    ("#### 42", "42", 1),
    ("#### $18", "18", 4),
    ("The ANSWER is 12.", "12", 2),
    ("Answer:\n 5", "5", 2),
    ("a = 7.", "7", 4),
    ("3 apples 4,56 pears", "56", 4),
    ("", "", 0),
    ("#### 18", "18", 1),
    ("#### 18 then 5", "18", 1),
    ("= 1.50", "1.50", 3),
    ("0.00001", "0.00001", 4),
    ("1,2345", "5", 4),
    ("cost:$5", "5", 4),
    ("#### 1.", "1", 1),
    ("x #### 1,234.50 y #### 7", "1234.50", 1),
    ("**#### 18**", "18", 1),
    ("answer: -3", "-3", 2),
    ("a = 7\n", "7", 3),
    ("x: 1,000 \n\n", "1000", 3),
    ("none", "", 0),
    ("#### -0", "-0", 1),
    ("5-3 left", "-3", 4),
    ("12345678.5 end", "12345678.5", 4),
    ("99999999999999999999", "99999999999999999999", 4),
    ("#### 6.67", "6.67", 1),
    ("#### 12,34", "12", 1),
    ("#### ٣", "", 0),
    ("answer is answer: 5 then 6", "5", 2),
    ("answer is 5 #### 6", "6", 1),
    ("x=####", "", 0),
    ("5=5", "5", 3),
    ("a: -3", "-3", 3),
    ("= 7 \t\n", "7", 3),
    ("=--5", "-5", 4),
    ("= 7 or so", "7", 4),
    ("1-5=", "-5", 4),
    (":5 = 6 ", "6", 3),
    ("ANSWER:\n1,234.5 = 9", "1234.5", 2),
    ("answer is x, answer: 9 = 3", "9", 2),
    ("=1,2345", "5", 4),
    (None, "", 0),
]

SHORT = [
    ("x #### 1,234.50 y #### 7", "7"),
    ("x: 1,000", "000"),
    ("1,2345", "2345"),
    ("The ANSWER is 12.", "12."),
    ("a = 7.", "7."),
    ("#### none but 9 here", "9"),
    ("12 #### ", "12"),
    ("So = 4 and = 5", "5"),
    ("none", None),
    ("The answer is 6, not 7<|im_end|>", "6"),
]

NORMALIZED = [
    ("007", "7"),
    ("0.0", "0"),
    ("-0.50", "-0.5"),
    ("1000.0", "1000"),
    ("10.", "10"),
    (None, ""),
    (" 1,234 ", "1234"),
    ("-0", "0"),
    ("1e3", "1000"),
    ("+5", "5"),
    (".5", "0.5"),
    ("1_000", "1000"),
    ("5d", "5d"),
    ("infinity", "infinity"),
    ("twelve", "twelve"),
    (" 7 ", "7"),
]

SAME = [
    ("18", "18.00", True),
    ("1,000", "1000.0", True),
    ("-0", "0", True),
    ("1e3", "1000", True),
    ("5", "5d", False),
    ("5d", "5d", True),
    ("", "", True),
    (None, "", True),
    ("", "0", False),
    ("abc", "abd", False),
    ("0.1", "0.10000000000000001", True),
]


def _column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string").coalesce(1)
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extract_answer(spark):
    texts = [t for t, _, _ in EXTRACTED]
    assert _column(spark, texts, A.extract_answer) == [a for _, a, _ in EXTRACTED]
    assert _column(spark, texts, lambda t: A.hit_answer(A.answer_hit(t))) == [
        a for _, a, _ in EXTRACTED
    ]
    assert _column(spark, texts, lambda t: A.hit_rule(A.answer_hit(t))) == [
        r for _, _, r in EXTRACTED
    ]


def test_extract_answer_short(spark):
    assert _column(spark, [t for t, _ in SHORT], A.extract_answer_short) == [a for _, a in SHORT]


def test_normalize_answer(spark):
    got = _column(spark, [t for t, _ in NORMALIZED], A.normalize_answer)
    assert got == [a for _, a in NORMALIZED]


def test_same_answer(spark):
    frame = spark.createDataFrame([(a, b) for a, b, _ in SAME], "a string, b string").coalesce(1)
    bare = frame.select(A.bare(F.col("a")).alias("a"), A.bare(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    verdicts = bare.select(A.same_answer(a, A.numeric_value(a), b, A.numeric_value(b)))
    assert [r[0] for r in verdicts.collect()] == [v for _, _, v in SAME]


def test_annotations(spark):
    text = "48/2 = <<48/2=24>>24 and <<24+1=25>>25"
    assert _column(spark, [text], A.annotation_count) == [2]
    assert _column(spark, [text], A.annotation_expressions) == [["48/2", "24+1"]]
    assert _column(spark, [text], A.annotation_results) == [["24", "25"]]
    assert _column(spark, [text], A.without_annotations) == ["48/2 = 24 and 25"]


_PIECES = ["#### ", "answer is ", "Answer: ", "= ", ": ", "\n", " ", "$", ",", ".", "-", "x "]
_TEXTS = st.lists(
    st.one_of(st.sampled_from(_PIECES), st.integers(0, 10**7).map(str)), max_size=9
).map("".join)


def _model(text):
    """The four rules said once more, as the model the Spark expression is held against."""
    number = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
    first = [
        re.search(rf"####\s*({number})", text, re.ASCII),
        re.search(rf"(?:answer is|answer:)\s*({number})", text.lower(), re.ASCII),
        re.search(rf"[=:]\s*({number})\s*$", text, re.ASCII),
    ]
    found = [m.group(1) for m in first if m] + re.findall(number, text, re.ASCII)[-1:]
    return found[0].replace(",", "") if found else ""


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_TEXTS, min_size=200, max_size=300))
def test_extract_answer_like_model(spark, texts):
    assert _column(spark, texts, A.extract_answer) == [_model(t) for t in texts]
