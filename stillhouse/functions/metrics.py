"""Ratios, lift, rounding and run facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillhouse import fixed


def div(value: Column, by: int) -> Column:
    """Whole-number division that stays exact beyond what a double can hold."""
    return F.call_function("div", value, F.lit(by))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, rounded as the double it is and half to even.

    ``round`` and ``format_string`` round the printed digits half up instead: they make 224.9 of
    224.85, although the double lies below it.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def rounded(value: Column, digits: int) -> Column:
    return fixed_text(value, digits).cast("double")


def accuracy(correct: Column, total: Column) -> Column:
    return rounded(ratio(correct, total), fixed.ACCURACY_DIGITS)


def percent_text(value: Column, digits: int = 2, signed: bool = False) -> Column:
    text = F.concat(fixed_text(value * 100, digits), F.lit("%"))
    return F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text


def direction(lift: Column) -> Column:
    return F.when(lift >= 0, "improvement").otherwise("degradation")


def relative_gain(value: Column, base: Column) -> Column:
    return F.try_divide(value - base, base)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


def effective_batch(batch: Column, accumulation: Column) -> Column:
    return batch * accumulation


def training_steps(rows: Column, batch: Column, epochs: Column) -> Column:
    return (epochs * F.ceil(rows / batch)).cast("bigint")


def model_label(teacher: Column, base: str = fixed.BASE) -> Column:
    return F.when(teacher == base, fixed.BASE_LABEL).otherwise(F.upper(teacher))
