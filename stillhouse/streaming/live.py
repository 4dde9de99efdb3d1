"""Accuracy and error counts while rows still arrive.

Counts add up in any order, so late rows need no watermark and the state is one row per model.
At the end of the input the figures equal those of the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stillhouse.config import RetryConfig
from stillhouse.functions.retry import is_final
from stillhouse.operators.grading import accuracy_by_teacher, grade_against
from stillhouse.sources.results import ResultsDocument


def live_accuracy(prediction_stream: DataFrame, truth: DataFrame) -> DataFrame:
    """Streaming accuracy per model; each micro-batch is joined to the true answers.

    ``truth`` comes from :func:`~stillhouse.operators.grading.true_answers` and is read in every
    micro-batch: write it before, best to a :class:`~stillhouse.sources.bucketed.BucketedStore`, so
    that neither the problems' texts are read nor the answers dealt out again.
    """
    return accuracy_by_teacher(grade_against(prediction_stream, truth))


def live_errors(attempt_stream: DataFrame, retry: RetryConfig = RetryConfig()) -> DataFrame:
    """Streaming count of settled requests and errors per teacher."""
    settled = is_final(F.col("ok"), F.col("attempt"), retry)
    return attempt_stream.groupBy("teacher").agg(
        F.count_if(settled).alias("processed"),
        F.count_if(settled & ~F.col("ok")).alias("errors"),
    )


def keep_results(
    live: DataFrame, document: ResultsDocument, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Start a query that writes each model's latest figures into ``document``.

    A micro-batch carries the new totals of the models it touched, so replaying one after a
    failure replaces the same keys by the same figures.
    """

    def replace(batch: DataFrame, _batch_id: int) -> None:
        document.upsert(batch)

    writer = (
        live.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
