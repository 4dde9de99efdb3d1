"""Calling teachers from Spark tasks.

A provider is anything that answers a :class:`Request` with a text or raises. The library ships
none: clients, keys and pacing belong to the caller.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from stillhouse import config, fixed
from stillhouse.config import RetryConfig


class Request(NamedTuple):
    teacher: str
    idx: int
    attempt: int
    prompt: str


Provider = Callable[[Request], str]
#: Called once per task and teacher, so clients are opened where they are used.
ProviderFactory = Callable[[], Provider]

ATTEMPT_SCHEMA = (
    "teacher string, idx bigint, attempt bigint, ok boolean, error string, completion string, "
    "at_s double"
)
#: Calls a task holds before it hands them on.
_ROWS_AT_ONCE = 1_000


def check_providers(providers: Mapping[str, ProviderFactory], teachers: list[str]) -> None:
    unknown = [t for t in teachers if t not in providers]
    if unknown:
        raise ValueError(f"no provider for teachers {unknown}")


def complete(
    requests: DataFrame,
    providers: Mapping[str, ProviderFactory],
    teachers: list[str],
    retry: RetryConfig = RetryConfig(),
    tasks: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.time,
) -> DataFrame:
    """The attempt log of ``teacher, idx, prompt`` rows, each asked until it answers or gives up.

    Tasks may run again after a lost executor, so a provider has to bear repeated requests.
    Write the log before using it: every action on this frame would call the teachers anew.
    ``tasks`` is the number of tasks that ask at the same time; the requests of one teacher are
    dealt out to all of them.
    """
    check_providers(providers, teachers)
    # Send what tasks use of this package along with them; executors need not have it.
    for module in (sys.modules[__name__], config):
        cloudpickle.register_pickle_by_value(module)
    factories = dict(providers)
    rate_limit_words = fixed.RATE_LIMIT_WORDS

    def wait(message: str, attempt: int) -> float:
        limited = any(w in message.lower() for w in rate_limit_words)
        factor = retry.rate_limit_factor if limited else retry.other_factor
        return retry.first_delay_s * factor**attempt

    def ask(provider: Provider, teacher: str, idx: int, prompt: str) -> Iterator[tuple]:
        for attempt in range(retry.max_tries):
            try:
                text = provider(Request(teacher, idx, attempt, prompt))
            except Exception as failure:  # any failure of a call is data, not a failed task
                message = str(failure)
                yield teacher, idx, attempt, False, message, None, clock()
                if attempt < retry.max_tries - 1:
                    sleep(wait(message, attempt))
            else:
                yield teacher, idx, attempt, True, None, text, clock()
                return

    columns = [c.split()[0] for c in ATTEMPT_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_providers: dict[str, Provider] = {}
        for batch in batches:
            rows: list[tuple] = []
            for teacher, idx, prompt in zip(batch["teacher"], batch["idx"], batch["prompt"]):
                if teacher not in open_providers:
                    open_providers[teacher] = factories[teacher]()
                rows.extend(ask(open_providers[teacher], teacher, int(idx), prompt))
                if len(rows) >= _ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    asked = requests.select("teacher", "idx", "prompt")
    asked = asked.repartition(tasks) if tasks else asked
    return asked.mapInPandas(run, ATTEMPT_SCHEMA)
