"""Wall time of the headline queries, as one JSON line.

Every query runs over its whole tables into a sink that discards rows, so the time is that of
the plan and not of moving results to the driver. One warm-up query starts the JVM's compiler.

The given tables are single row groups, which one task has to read however many cores there are.
They are copied first, untimed, into as many files as there are cores, the way a large table comes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from stillhouse.plans.queries import QUERIES
from stillhouse.sources.tables import SCHEMAS

HEADLINE = (
    "leaderboard_lift",
    "graded_rows",
    "accuracy_by_teacher",
    "accuracy_notebook_variant",
    "running_accuracy",
    "sample_first5",
    "extract_answer_documents",
    "normalize_answers",
    "gen_prompts",
    "train_text_by_teacher",
    "strip_prompt",
    "chat_conversations",
    "teachers_side_by_side",
    "error_sentinel",
    "gen_stats",
    "gen_progress",
    "error_rate_blocks",
    "error_runs",
    "circuit_breaker",
    "circuit_breaker_rows",
    "backoff_totals",
    "pending_work",
    "complete_with_retries",
    "sample_seeded",
    "annotations",
    "style_profile",
    "stream_accuracy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stillhouse-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.minPartitionNum", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    copies = tempfile.TemporaryDirectory(prefix="stillhouse-bench-")
    for table in SCHEMAS:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.repartition(int(cpus)).write.parquet(f"{copies.name}/{table}.parquet")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, copies.name).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    names = sys.argv[1:] or HEADLINE
    run("leaderboard_lift")
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
    copies.cleanup()


if __name__ == "__main__":
    main()
