"""Numeric answers in free text: extract, normalize, compare.

Every function maps Columns to one Column of built-in expressions, so a whole grading
projection stays inside one codegen stage and no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillhouse import fixed
from stillhouse.functions.text import SPACE, strip, strip_marker

MARKED = rf"{fixed.ANSWER_MARK}{SPACE}*({fixed.NUMBER})"
# A number with what stands before it if that makes it an answer, and the white space after it. The
# first character is looked at alone, so that most places of a text cost one comparison.
CLAIMED = rf"(?i)(?=[a=:\-0-9])(?:(?:answer is|answer:|[=:]){SPACE}*)?{fixed.NUMBER}{SPACE}*"

SHORT_STATED = (
    rf"[Tt]he answer is{SPACE}*({fixed.PLAIN_NUMBER})",
    rf"[Aa]nswer:{SPACE}*({fixed.PLAIN_NUMBER})",
    rf"={SPACE}*({fixed.PLAIN_NUMBER}){SPACE}*$",
    rf"({fixed.PLAIN_NUMBER}){SPACE}*$",
)

#: What counts as a number when an answer is compared: sign, digits with single underscores,
#: fraction, exponent. A cast alone would also take ``5d`` or ``Infinity``.
_DIGITS = r"\d+(?:_\d+)*"
NUMERIC = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_PLAIN = r"^-?\d+\.?\d*$"

ANNOTATION = r"<<[^<=>]*=[^<>]*>>"
ANNOTATION_PARTS = r"<<([^<=>]*)=([^<>]*)>>"


def _first(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL without one (``regexp_extract`` gives '')."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(1))


def _last_number(text: Column, number: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(number), 0), F.lit(-1))


def answer_hit(text: Column) -> Column:
    """Rule digit followed by the number that rule found; ``0`` when none did.

    Rules in order: 1 number after the answer mark, 2 number after "answer is" / "answer:",
    3 number after ``=`` or ``:`` at the end, 4 last number anywhere. Marks are looked for first,
    which is cheap. A text without one is scanned once more: its numbers, each with the words or
    sign before it, are one list, in which the other rules are told apart. No two of them can claim
    the same characters, so the list is the same whichever rule it is read for.
    Use :func:`hit_rule` and :func:`hit_answer` on the materialized column.
    """

    def number(claim: Column) -> Column:
        return F.regexp_extract(claim, fixed.NUMBER, 0)

    def first_rule(claims: Column) -> Column:
        stated = F.get(F.filter(claims, lambda c: F.lower(F.left(c, F.lit(1))) == "a"), F.lit(0))
        last = F.try_element_at(claims, F.lit(-1))
        # White space after a number is part of its claim, so the claim of a trailing one ends the text.
        trailing = F.left(last, F.lit(1)).isin("=", ":") & F.endswith(text, last)
        return (
            F.when(stated.isNotNull(), F.concat(F.lit("2"), number(stated)))
            .when(trailing, F.concat(F.lit("3"), number(last)))
            .when(last.isNotNull(), F.concat(F.lit("4"), number(last)))
        )

    # The list is an element of an array so that it is made once for all its uses.
    claims = F.array(F.regexp_extract_all(text, F.lit(CLAIMED), 0))
    return F.coalesce(
        F.concat(F.lit("1"), _first(text, MARKED)),
        F.get(F.transform(claims, first_rule), F.lit(0)),
        F.lit("0"),
    )


def hit_rule(hit: Column) -> Column:
    return F.left(hit, F.lit(1)).cast("int")


def hit_answer(hit: Column) -> Column:
    return F.replace(F.substring(hit, 2, 2**31 - 1), F.lit(","), F.lit(""))


def extract_answer(text: Column) -> Column:
    """The answer by the four rules, commas dropped, '' when the text holds no number."""
    return hit_answer(answer_hit(text))


def extract_answer_short(text: Column, end_marker: str = fixed.END_OF_TURN) -> Column:
    """The prototype's extractor: last mark wins, commas end a number, NULL when none.

    Kept apart from :func:`extract_answer` because it reads ``1,000`` as ``000``.
    """
    clean = strip_marker(text, end_marker)
    tail = F.substring_index(clean, fixed.ANSWER_MARK, -1)
    after_mark = F.when(
        F.contains(clean, F.lit(fixed.ANSWER_MARK)), _first(tail, f"({fixed.PLAIN_NUMBER})")
    )
    stated = [_first(clean, p) for p in SHORT_STATED]
    return F.coalesce(after_mark, *stated, _last_number(clean, fixed.PLAIN_NUMBER))


def ground_truth(answer: Column) -> Column:
    """Text after the last answer mark, the whole text when it has none."""
    return strip(F.substring_index(answer, fixed.ANSWER_MARK, -1))


def bare(answer: Column) -> Column:
    """Commas and outer whitespace dropped; NULL becomes ''."""
    return strip(F.replace(F.coalesce(answer, F.lit("")), F.lit(","), F.lit("")))


def numeric_value(bare_answer: Column) -> Column:
    """Double value of a :func:`bare` answer, NULL when it is not a number."""
    digits = F.replace(bare_answer, F.lit("_"), F.lit(""))
    return F.when(bare_answer.rlike(NUMERIC), digits.try_cast("double"))


def normalize_answer(answer: Column) -> Column:
    """Display form: whole numbers without fraction, no padding zeros, other text as it is.

    Decimals keep their digits instead of going through a double, so the text is the same in
    every engine. Verdicts never use it, see :func:`same_answer`.
    """
    text = bare(answer)
    tidy = F.regexp_replace(text, r"^(-?)0+(\d)", "$1$2")
    tidy = F.regexp_replace(tidy, r"(\.\d*[1-9])0+$", "$1")
    tidy = F.regexp_replace(tidy, r"\.0*$", "")
    tidy = F.regexp_replace(tidy, r"^-0$", "0")
    value = numeric_value(text)
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e18))
    return (
        F.when(text.rlike(_PLAIN), tidy)
        .when(value.isNotNull() & whole, value.cast("bigint").cast("string"))
        .when(value.isNotNull(), value.cast("string"))
        .otherwise(text)
    )


def same_answer(
    left_bare: Column, left_value: Column, right_bare: Column, right_value: Column
) -> Column:
    """Equal as numbers when both are numbers, else equal as text; never NULL.

    Comparing doubles gives the verdict that comparing their shortest texts would give and
    does not depend on how an engine prints a double.
    """
    both_text = left_value.isNull() & right_value.isNull()
    return F.when(both_text, left_bare == right_bare).otherwise(
        F.coalesce(left_value == right_value, F.lit(False))
    )


def annotation_count(text: Column) -> Column:
    """Number of ``<<expression=result>>`` calculator annotations."""
    return F.regexp_count(text, F.lit(ANNOTATION)).cast("bigint")


def annotation_expressions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANNOTATION_PARTS), 1)


def annotation_results(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANNOTATION_PARTS), 2)


def without_annotations(text: Column) -> Column:
    return F.regexp_replace(text, ANNOTATION, "")
