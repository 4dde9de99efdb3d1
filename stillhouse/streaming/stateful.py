"""What streams keep in state of their own: the breaker in row order, and corrected verdicts."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stillhouse import config as settings
from stillhouse.config import BreakerConfig
from stillhouse.functions.metrics import accuracy, div
from stillhouse.sources.results import ResultsDocument

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a teacher that may wait for one before them.
MOST_AHEAD = 1_000_000
#: Rows of a teacher that are laid out and judged at a time.
ROWS_AT_ONCE = 500_000
#: Problems whose verdicts are one entry of the state.
VERDICTS_PER_ENTRY = 4_096

LIVE_BREAKER_SCHEMA = (
    "teacher string, rows bigint, processed bigint, kept bigint, errors bigint, run bigint, longest_run bigint, "
    "trip_idx bigint, keeps int, waiting bigint"
)
CHANGE_SCHEMA = "teacher string, bucket bigint, total bigint, correct bigint"


@contextmanager
def own_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep state of their own, which needs another store than Spark's default."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _in_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes as runs of consecutive ``idx`` with a byte for each row, a batch at a time.

    A teacher of a batch has a row at least, an empty run if none of its rows has an ``idx``.
    """
    for frame in frames:
        for teacher, own in frame.groupby("teacher", dropna=False, sort=False):
            placed = own[own["idx"].notna()]
            # A row that arrives again is the same row.
            idx, first = np.unique(placed["idx"].to_numpy(dtype=np.int64), return_index=True)
            oks = placed["ok"].to_numpy(dtype=bool)[first].astype(np.int8)
            begins = np.flatnonzero(np.diff(idx, prepend=idx[:1] - 2) != 1)
            ends = np.append(begins[1:], len(idx))
            runs = [(int(idx[b]), oks[b:e].tobytes()) for b, e in zip(begins, ends)] if len(idx) else [(0, b"")]
            name = None if pd.isna(teacher) else teacher
            yield pd.DataFrame({"teacher": [name] * len(runs), "start": [r[0] for r in runs], "oks": [r[1] for r in runs]})


class _Runs:
    """Runs of a teacher's rows in the order of ``idx``: a byte per row, and three numbers per run."""

    def __init__(self, starts: list[np.ndarray], lengths: list[np.ndarray], oks: list[bytes]):
        lengths, starts = np.concatenate(lengths), np.concatenate(starts)
        # Of runs that begin alike, that which came first stays first.
        order = np.argsort(starts, kind="stable")
        self._oks = np.frombuffer(b"".join(oks), dtype=np.int8)
        self._places = (np.cumsum(lengths) - lengths)[order]
        self._starts = starts[order]
        self._ends = self._starts + lengths[order]
        self._arrived = order
        #: Where the rows up to each run end; from there on no earlier run reaches.
        self._reach = np.maximum.accumulate(self._ends) if len(order) else self._ends

    def ready(self, seen: int) -> int:
        """The first row from ``seen`` on that is missing."""
        before = np.concatenate([[seen], np.maximum(self._reach[:-1], seen)]) if len(self._reach) else []
        gap = np.flatnonzero(self._starts > before)
        upto = self._reach[: gap[0]] if len(gap) else self._reach
        return max(seen, int(upto[-1])) if len(upto) else seen

    def count(self, low: int) -> int:
        """Different rows from ``low`` on."""
        if not len(self._reach):
            return 0
        before = np.concatenate([[low], np.maximum(self._reach[:-1], low)])
        return int(np.maximum(self._ends - np.maximum(self._starts, before), 0).sum())

    def cut(self, low: int, high: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows from ``low`` on and below ``high``, each once, as it arrived first."""
        high = int(self._reach[-1]) if high is None else high
        some = slice(int(np.searchsorted(self._reach, low, side="right")), int(np.searchsorted(self._starts, high)))
        begins, ends = np.maximum(self._starts[some], low), np.minimum(self._ends[some], high)
        sizes = np.maximum(ends - begins, 0)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        idx = np.repeat(begins, sizes) + inside
        ok = self._oks[np.repeat(self._places[some] + begins - self._starts[some], sizes) + inside] > 0
        if sizes.sum() > 1 and not (np.diff(idx) > 0).all():
            first = np.lexsort((np.repeat(self._arrived[some], sizes), idx))
            idx, ok = idx[first], ok[first]
            once = np.append(True, idx[1:] != idx[:-1])
            idx, ok = idx[once], ok[once]
        return idx, ok


def _send_along() -> None:
    """Send what tasks use of this package along with them; executors need not have it."""
    for module in (sys.modules[__name__], settings):
        cloudpickle.register_pickle_by_value(module)


class _Breaker(StatefulProcessor):
    """Rows of a teacher in the order of ``idx``; those that come early wait."""

    _FIELDS = "rows bigint, errors bigint, run bigint, longest_run bigint, block_errors bigint, trip_idx bigint, keeps int"

    def __init__(self, config: BreakerConfig, most_ahead: int):
        self._config, self._most_ahead = config, most_ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("breaker", self._FIELDS)
        self._early = handle.getListState("early", "idx bigint, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._state.get()
        seen, errors, run, longest, block_errors, trip_idx, keeps = known or (0, 0, 0, 0, 0, None, None)
        waiting = 0
        starts, lengths, oks = [], [], []
        for frame in rows:
            if trip_idx is None:
                starts.append(frame["start"].to_numpy(dtype=np.int64))
                lengths.append(np.fromiter(map(len, frame["oks"]), np.int64, len(frame)))
                oks.append(b"".join(frame["oks"]))
        if trip_idx is None:
            early = list(self._early.get())
            starts.append(np.array([r[0] for r in early], dtype=np.int64))
            lengths.append(np.ones(len(early), dtype=np.int64))
            oks.append(bytes(bytearray(r[1] for r in early)))
            held = _Runs(starts, lengths, oks)
            del starts, lengths, oks
            ready = held.ready(seen)
            waiting = held.count(ready)
            if waiting > self._most_ahead:
                raise RuntimeError(f"{waiting} rows of {key[0]} wait for row {ready}")
            while seen < ready and trip_idx is None:
                ok = held.cut(seen, min(ready, seen + ROWS_AT_ONCE))[1]
                step = self._judge(ok, seen, run, block_errors)
                errors += step["errors"]
                run, block_errors, longest = step["run"], step["block_errors"], max(longest, step["longest"])
                seen += step["used"]
                if step["keeps"] is not None:
                    trip_idx, keeps, waiting = seen - 1, step["keeps"], 0
            if trip_idx is not None:
                self._early.clear()
            elif waiting:
                idx, ok = held.cut(ready, None)
                self._early.put(list(zip(idx.tolist(), ok.tolist())))
            elif early:
                self._early.clear()
            self._state.update((seen, errors, run, longest, block_errors, trip_idx, keeps))
        kept = seen if keeps is None else seen - 1 + keeps
        columns = [c.split()[0] for c in LIVE_BREAKER_SCHEMA.split(", ")]
        values = [key[0], seen, seen, kept, errors, run, longest, trip_idx, keeps, waiting]
        frame = pd.DataFrame([values], columns=columns)
        yield frame.astype({"trip_idx": "Int64", "keeps": "Int32"})

    def _judge(self, ok: np.ndarray, seen: int, run: int, block_errors: int) -> dict:
        """What the rows add, up to the first trip; the run is judged before the block."""
        block, reach = self._config.block_rows, self._config.max_consecutive
        places = np.arange(len(ok))
        last_ok = np.maximum.accumulate(np.where(ok, places, -1 - run))
        runs = places - last_ok
        failures = np.cumsum(~ok)
        ends = places[(seen + places) % block == block - 1]
        upto = failures[ends]
        in_block = np.diff(upto, prepend=-block_errors)
        by_run = np.flatnonzero(runs >= reach)[:1]
        by_rate = ends[in_block / float(block) > self._config.block_error_rate][:1]
        trips = [(int(p), 0) for p in by_run] + [(int(p), 1) for p in by_rate]
        place, keeps = min(trips, default=(len(ok) - 1, None))
        used = place + 1
        if not used:
            return {"used": 0, "errors": 0, "run": run, "longest": run, "block_errors": block_errors, "keeps": None}
        total = int(failures[place])
        closed = upto[ends <= place]
        left = total - int(closed[-1]) if len(closed) else total + block_errors
        return {
            "used": used,
            "errors": total,
            "run": int(runs[place]),
            "longest": int(runs[:used].max()),
            "block_errors": left,
            "keeps": keeps,
        }

    def close(self) -> None:
        pass


def live_breaker(
    outcome_stream: DataFrame, config: BreakerConfig = BreakerConfig(), most_ahead: int = MOST_AHEAD
) -> DataFrame:
    """The breaker while outcomes arrive, in any order: one row per teacher that a micro-batch touched.

    ``idx`` is dense from 0. Rows are judged in its order; what comes early waits in state. State
    is bounded: a few numbers per teacher, and at most ``most_ahead`` waiting rows, beyond which the
    query fails rather than grow. Nothing waits once a teacher has tripped; its later rows are
    passed over. Rows that arrive again change nothing. Rows of a teacher meet in one task of each
    micro-batch, because their order decides; they come there as runs of consecutive ``idx``, a byte
    per row, put together where they are read. Start it inside :func:`own_state`.
    """
    _send_along()
    rows = outcome_stream.select("teacher", F.col("idx").cast("bigint").alias("idx"), F.coalesce("ok", F.lit(False)).alias("ok"))
    runs = rows.mapInPandas(_in_runs, "teacher string, start bigint, oks binary")
    return runs.groupBy("teacher").transformWithStateInPandas(
        _Breaker(config, most_ahead), LIVE_BREAKER_SCHEMA, "Update", "None"
    )


class _LastVerdicts(StatefulProcessor):
    """Last verdict per problem of a bucket, and what a micro-batch changes in the bucket's sums."""

    def __init__(self, per_entry: int):
        self._per_entry = per_entry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("verdicts", "seqs binary, correct binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size = self._per_entry
        known = self._state.get()
        if known is None:
            # A verdict of -1 is none.
            seqs, correct = np.full(size, np.iinfo(np.int64).min), np.full(size, -1, dtype=np.int8)
        else:
            seqs, correct = np.frombuffer(known[0], np.int64).copy(), np.frombuffer(known[1], np.int8).copy()
        before = int((correct >= 0).sum()), int((correct > 0).sum())
        for frame in rows:
            place, seq = frame["idx"].to_numpy() % size, frame["seq"].to_numpy()
            verdict = frame["correct"].to_numpy(dtype=np.int8)
            # Of rows with one idx the last in order of seq; of one seq a right answer wins, whatever the order of arrival.
            order = np.lexsort((verdict, seq, place))
            place, seq, verdict = place[order], seq[order], verdict[order]
            last = np.append(place[1:] != place[:-1], True)
            place, seq, verdict = place[last], seq[last], verdict[last]
            newer = (seq > seqs[place]) | ((seq == seqs[place]) & (verdict > correct[place]))
            seqs[place[newer]], correct[place[newer]] = seq[newer], verdict[newer]
        self._state.update((seqs.tobytes(), correct.tobytes()))
        after = int((correct >= 0).sum()), int((correct > 0).sum())
        yield pd.DataFrame(
            [[key[0], key[1], after[0] - before[0], after[1] - before[1]]],
            columns=["teacher", "bucket", "total", "correct"],
        )

    def close(self) -> None:
        pass


def verdict_changes(graded_stream: DataFrame, per_entry: int = VERDICTS_PER_ENTRY) -> DataFrame:
    """What each micro-batch changes in the numbers of graded and right answers: ``teacher, bucket, total, correct``.

    ``graded_stream`` has ``teacher, idx, seq, correct``. An answer that comes again with a larger
    ``seq`` replaces the one before, which is taken out of the sums; one with a smaller ``seq`` that
    comes late changes nothing. State is nine bytes per problem, in entries of ``per_entry`` problems,
    so a teacher's problems are spread over as many groups. Start it inside :func:`own_state`.
    """
    _send_along()
    rows = graded_stream.select(
        "teacher",
        div(F.col("idx"), per_entry).alias("bucket"),
        "idx",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("correct").cast("int").alias("correct"),
    )
    return rows.groupBy("teacher", "bucket").transformWithStateInPandas(
        _LastVerdicts(per_entry), CHANGE_SCHEMA, "Update", "None"
    )


def keep_corrected(
    changes: DataFrame, folder: str, document: ResultsDocument, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Start a query that keeps each model's accuracy over last answers in ``document``.

    The changes of a micro-batch, a row per model, are written to a folder of its own number, so
    a batch that is replayed after a failure replaces its own changes. Accuracy is their sum.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        summed = batch.groupBy("teacher").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
        summed.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        so_far = spark.read.schema("teacher string, total bigint, correct bigint, batch bigint").parquet(folder)
        figures = (
            so_far.where(F.col("batch") <= batch_id)
            .groupBy("teacher")
            .agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
        )
        document.upsert(
            figures.withColumn("accuracy", accuracy(F.col("correct"), F.col("total"))).select(*document.schema.names)
        )

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
