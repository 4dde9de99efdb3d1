"""The corpus pipeline: rules, repeated lines, near copies, repeated passages, packing.

Every stage takes the table that the one before it kept and returns the columns of documents;
the last returns packed pieces. NULL texts count as empty and rows with NULL ids go through. Each
row is kept or left by its own verdict, whatever rows share its id; only rows equal in id, text and
lang go or stay together. Columns beyond those of documents are left behind. An empty table stays
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.llm.lines import remove_repeated_chunks
from stillhouse.llm.near import near_groups
from stillhouse.llm.packing import pack
from stillhouse.llm.quality import risk_controlled_rules
from stillhouse.llm.suffix import remove_repeats
from stillhouse.sources.shared import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Minhashes, suffix arrays and chosen cuts have no SQL; ``tests/llm`` has a brute-force version.
ORACLE_SQL = None


def _marked(docs: DataFrame) -> DataFrame:
    """Documents with a mark of what a verdict depends on besides the id."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit(":"), "lang"), F.lit(""))
    return docs.select(*COLUMNS, F.concat(F.md5(text), lang).alias("mark"))


def _of_kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows whose own verdict is to be kept; ``judged`` carries their ``mark``."""
    kept = judged.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("mark").eqNullSafe(F.col("kept_mark"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """Columns of documents with another text."""
    changed = docs.select("doc_id", F.col(text).alias("text"), "lang", "source")
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = _marked(docs)
    return _of_kept(docs, risk_controlled_rules(docs, labels, more=["mark"]))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(remove_repeated_chunks(docs, more=["lang", "source"]), "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _marked(docs)
    return _of_kept(docs, near_groups(docs, more=["mark"]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(remove_repeats(docs, more=["lang", "source"]), "kept")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    folder = new_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
