"""Classifying failed calls and the time their retries cost."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillhouse import fixed
from stillhouse.config import RetryConfig

_RATE_LIMIT = "|".join(re.escape(w) for w in fixed.RATE_LIMIT_WORDS)


def is_rate_limit(message: Column) -> Column:
    return F.lower(message).rlike(_RATE_LIMIT.replace(r"\ ", " "))


def backoff_seconds(message: Column, attempt: Column, retry: RetryConfig = RetryConfig()) -> Column:
    """Wait after a failed attempt (0-based); NULL after the last one, which gives up."""
    factor = F.when(is_rate_limit(message), F.lit(float(retry.rate_limit_factor))).otherwise(
        F.lit(float(retry.other_factor))
    )
    return F.when(
        message.isNotNull() & (attempt < retry.max_tries - 1),
        F.lit(retry.first_delay_s) * F.pow(factor, attempt),
    )


def is_final(ok: Column, attempt: Column, retry: RetryConfig = RetryConfig()) -> Column:
    """True on the one attempt that settles a request: the success, or the last failure."""
    return ok | (attempt == retry.max_tries - 1)
