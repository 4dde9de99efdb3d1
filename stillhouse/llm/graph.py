"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.sources.shared import shared_folder


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round of the star method: neighbours of a node are hung on the smallest of them.

    The smallest neighbour is a pre-aggregated minimum joined back, so a node that a third of
    all links meet in is one row on one side of the join, and Spark may split the other.
    """
    if large:
        pairs = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    hung = pairs.join(least, F.col("a") == F.col("u")).withColumn("m", F.least("m", "a"))
    if large:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``) that isn't the smallest of its component.

    Large and small stars take turns until nothing moves, which takes about the logarithm of the
    longest chain. Each round is checkpointed to the shared folder; the driver sees one checksum.
    """
    shared_folder(links.sparkSession)
    links = links.where("a != b").select("a", "b").distinct().checkpoint()
    seen = None
    while True:
        links = _star(_star(links, True), False).checkpoint()
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
