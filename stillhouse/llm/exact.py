"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.llm.columns import keyed_text, lower_ascii

#: Copies of a group's row in the join that tells documents their group.
SALTS = 32


def _places(nodes: int, fan_in: int) -> list[int]:
    """Place values of the base ``fan_in`` digits of a node's number."""
    places = [1]
    while places[-1] * fan_in < nodes:
        places.append(places[-1] * fan_in)
    return places


def merge_runs(digests: DataFrame, nodes: int, fan_in: int = 4, keep: str = "smallest") -> DataFrame:
    """One row per distinct text: ``sha, check, n_bytes, keep_id, group_size``.

    ``digests`` has ``doc_id, sha, check, n_bytes``. Rows start on the node of their input
    partition, which counts equal ones and has them as a run in digest order. In each round nodes
    whose numbers differ in one base ``fan_in`` digit exchange runs: a row moves to the node that
    has its digest's digit there. The runs that meet are merged into one in the order of digest
    and id; the first row of a digest has the id that stays and takes the counts of the others.
    After the last round a node holds one range of digests, each once. A digest that a third of all
    rows share is one row per node from the start, so no node ever gets more than ``fan_in`` rows of it.

    Rows merge only if SHA-256, an independent 64-bit hash and the length agree, at every level.
    """
    smallest = keep == "smallest"
    pick = F.min if smallest else F.max
    places = _places(nodes, fan_in)
    size = places[-1] * fan_in
    key = ("sha", "check", "n_bytes")
    by_id = F.col("keep_id").asc_nulls_last() if smallest else F.col("keep_id").desc_nulls_last()
    level = (
        digests.select((F.spark_partition_id() % size).cast("long").alias("node"), *key, "doc_id")
        .groupBy("node", *key)
        .agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    same = Window.partitionBy("node", *key)
    for place in places:
        own = F.floor(F.col("node") / place) % fan_in
        wanted = F.floor(F.pmod(F.col("check"), F.lit(size)) / place) % fan_in
        moved = level.withColumn("node", (F.col("node") + (wanted - own) * place).cast("long"))
        # The windows read the merged run as it is sorted here; rows of one digest stand together.
        run = moved.repartition(size, "node", "sha").sortWithinPartitions("node", *key, by_id)
        level = (
            run.withColumn("_first", F.row_number().over(same.orderBy(by_id)))
            .withColumn("_all", F.sum("group_size").over(same))
            .where("_first = 1")
            .select("node", *key, "keep_id", F.col("_all").alias("group_size"))
        )
    return level.drop("node")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    nodes: int | None = None,
    fan_in: int = 4,
) -> DataFrame:
    """Every row with the row of its text that stays: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after lower-casing A-Z. NULL counts as the empty text.
    Of equal texts the ``smallest`` (or ``largest``) id stays. Rows that repeat id and text are
    all returned, all count in ``group_size``, and stay or go together. A NULL id stays only in a
    group without any other id. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    nodes = nodes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = keyed_text(docs, id_col, text_col).select("doc_id", lower_ascii(F.col("text")).alias("low"))
    digests = low.select(
        "doc_id",
        F.unhex(F.sha2("low", 256)).alias("sha"),
        F.xxhash64("low").alias("check"),
        F.octet_length("low").alias("n_bytes"),
    )
    groups = (
        merge_runs(digests, nodes, fan_in, keep)
        .where("group_size > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = digests.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    found = salted.join(groups, ["sha", "check", "n_bytes", "salt"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
