"""One query per operator over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.llm.bpe import encode_texts
from stillhouse.llm.divergence import source_divergence
from stillhouse.llm.exact import exact_groups
from stillhouse.llm.html import extract
from stillhouse.llm.lines import remove_repeated_chunks
from stillhouse.llm.mixing import systematic_mix
from stillhouse.llm.near import near_groups
from stillhouse.llm.packing import pack
from stillhouse.llm.quality import risk_controlled_rules
from stillhouse.llm.repair import damage, repair
from stillhouse.llm.suffix import remove_repeats
from stillhouse.llm.toxicity import score
from stillhouse.llm.warc import archive_folder, read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = score(docs, docs, labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), full=False).drop("kept")


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=2)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    records = read_archives(index, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_lines",
        "n_chunks",
        "n_removed_chunks",
        "n_removed_lines",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = risk_controlled_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_texts(table(spark, sf_dir, "documents"), path, full=False)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = systematic_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations.select("conv_id"), full=False)
