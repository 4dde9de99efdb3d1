"""Audit of how the words of sources differ within a language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.sources.shared import new_path

#: Documents of a language that have a term it keeps, at least.
MIN_DOCS = 30
#: Terms listed per source.
TOP_TERMS = 50
#: Shares are counted in these parts, with so much added to each count.
PARTS, PRIOR = 1_000_000_000, 5
#: Characters of a term: letters of ASCII and all beyond it; in UTF-8 those are bytes from 0x80.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counters that a task holds before it hands them on, some 100 MB.
HELD = 500_000
#: A counter is one number: documents in the lower bits, occurrences above them.
_DOC_BITS = 40
#: Sources whose pairs are added up in one matrix, and rows of counts that share a matrix.
BLOCK_SOURCES, BUCKET_ROWS = 256, 20_000


def _share(count: Column | str, total: str, terms: str) -> str:
    """Exact share in parts, one at least; 0 where a language keeps no term."""
    top = f"cast({PARTS} as decimal(38,0)) * ({count} + {PRIOR})"
    return f"if({terms} = 0, 0L, 1L + {top} div nullif({total} + {PRIOR} * {terms}, 0))"


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``lang, text, spread``: each text of a language once, with its rows per source.

    Texts are the same if their SHA-256 is. Copies are counted per task before anything is
    shuffled, so a text that a third of all rows share is one row per task; ``spread`` has an
    entry per source that holds the text.
    """
    keyed = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("rows"))
    spread = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "rows")).alias("spread"))
    texts = keyed.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return texts.join(spread, ["lang", "digest"]).select("lang", "text", "spread")


def term_counts(texts: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` from distinct texts: each is split into terms once.

    Occurrences and documents are weighted by the rows that a source has of the text. A task adds
    up what it has seen and hands it on when it holds ``HELD`` counters; a grouping ends the sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            langs, sources, terms, ns, docs = [], [], [], [], []
            for (lang, source), found in held.items():
                langs += [lang] * len(found)
                sources += [source] * len(found)
                terms += found
                ns += [v >> _DOC_BITS for v in found.values()]
                docs += [v & ((1 << _DOC_BITS) - 1) for v in found.values()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(sources, pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(ns, pa.int64()),
                    pa.array(docs, pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for lang, text, spread in zip(*(column.to_pylist() for column in batch.columns)):
                once = Counter(_TERM.findall(text.lower()))
                for entry in spread:
                    rows = entry["rows"]
                    found = held.setdefault((lang, entry["source"]), {})
                    size -= len(found)
                    for term, n in once.items():
                        found[term] = found.get(term, 0) + ((n * rows) << _DOC_BITS) + rows
                    size += len(found)
                    if size >= HELD:
                        yield out()
                        held, size = {}, 0
        if held:
            yield out()

    # Bytes: lower() then changes A-Z only.
    encoded = texts.select("lang", F.col("text").cast("binary"), "spread")
    counted = encoded.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n`` of terms that enough documents of the language have."""
    same = Window.partitionBy("lang", "term")
    summed = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("lang_docs")
    )
    return summed.where(F.col("lang_docs") >= min_docs).drop("lang_docs")


def _facts(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source its sum ``total``, the language's ``lang_total``, number of ``terms``, and ``base``, the share of a term it lacks."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    joined = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    return joined.withColumn("base", F.expr(_share("0", "total", "terms")))


def _shared(rows: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Per pair of sources the correction for the terms that both have: ``lang, x, y, value``.

    Terms are dealt to buckets and sources to blocks. A task has the rows of a bucket for two
    blocks and adds each term's pairs up in one matrix, so what leaves it doesn't grow with the
    number of terms.
    """
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    dealt = (
        rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        names = np.unique(rows["source"].to_numpy(dtype=object))
        place = {name: i for i, name in enumerate(names)}
        rows = rows.assign(place=rows["source"].map(place)).sort_values("term", kind="stable")
        places, shares = rows["place"].to_numpy(), rows["share"].to_numpy()
        bases, is_low = rows["base"].to_numpy(), rows["block"].to_numpy() == low
        terms = pd.factorize(rows["term"])[0]
        cuts = np.flatnonzero(np.diff(terms, prepend=-1, append=len(rows) + 1))
        found = np.zeros((len(names), len(names)), dtype=np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = slice(a, b)
            if low == high:
                left = right = np.arange(a, b)
            else:
                left, right = a + np.flatnonzero(is_low[part]), a + np.flatnonzero(~is_low[part])
            if len(left) and len(right):
                p, q = shares[left][:, None], shares[right][None, :]
                u, v = bases[left][:, None], bases[right][None, :]
                both = np.abs(p - q) - np.abs(p - v) - np.abs(q - u) + np.abs(u - v)
                found[np.ix_(places[left], places[right])] += both
        if low == high:
            found = np.triu(found, 1)
        rows_at, columns_at = np.nonzero(found)
        x, y = np.minimum(rows_at, columns_at), np.maximum(rows_at, columns_at)
        return pd.DataFrame({"lang": lang, "x": names[x], "y": names[y], "value": found[rows_at, columns_at]})

    return dealt.groupBy("lang", "bucket", "low", "high").applyInPandas(
        add_up, "lang string, x string, y string, value bigint"
    )


def pair_distances(kept: DataFrame, facts: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """``lang, x, y, value``: sum of share differences of each two sources of a language, once per pair.

    Only counts above 0 are looked at. With all terms absent on both sides a pair differs by its
    bases, times the number of terms. A term that one side has changes that by an amount which
    depends on the other side's base alone: those are added up per level of the share, as shares
    above all bases of the language need only their sum. For terms of both sides the two amounts
    are corrected.
    """
    highest = facts.groupBy("lang").agg(F.max("base").alias("highest"))
    levels = (
        kept.join(highest, "lang")
        .groupBy("lang", "source", "base", F.least("share", "highest").alias("level"))
        .agg(F.count("*").alias("n"), F.sum("share").alias("sum"))
    )
    other = facts.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    beside = levels.join(other, "lang").where("source != other")
    above = F.col("sum") - F.col("n") * F.col("other_base")
    away = F.when(F.col("level") >= F.col("other_base"), above).otherwise(-above)
    one_sided = beside.select(
        "lang",
        F.least("source", "other").alias("x"),
        F.greatest("source", "other").alias("y"),
        (away - F.col("n") * F.abs(F.col("base") - F.col("other_base"))).alias("value"),
    )
    absent = (
        facts.select("lang", F.col("source").alias("x"), F.col("base"), "terms")
        .join(other.withColumnRenamed("other", "y"), "lang")
        .where("x < y")
        .select("lang", "x", "y", (F.col("terms") * F.abs(F.col("base") - F.col("other_base"))).alias("value"))
    )
    amounts = absent.unionByName(one_sided).unionByName(_shared(kept, buckets, blocks))
    return amounts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """How each source of a language differs from its others, and in which terms from the language:
    ``lang, source, part, item, value, rank``.

    Part ``pair`` has every other source of the language with the sum of differences over all kept
    terms; part ``term`` the ``top`` terms whose share in the source is above that of the language.

    NULL texts, languages and sources are empty strings, groups like any other. A source without
    kept terms has its pairs too; a language that keeps no term has distances of 0. Rows that
    repeat each count; ids are not looked at, and other columns are left behind. An empty table
    gives no rows. Ties go by the item.
    """
    blank = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*blank)
    kept = _written(kept_counts(term_counts(distinct_texts(rows)), min_docs), "kept-terms")
    facts = _written(_facts(rows.select("lang", "source").distinct(), kept), "source-facts")
    shared = (
        kept.join(facts, ["lang", "source"])
        .withColumn("share", F.expr(_share("n", "total", "terms")))
        .withColumn("lang_share", F.expr(_share("lang_n", "lang_total", "terms")))
        .select("lang", "source", "term", "share", "lang_share", "base")
    )
    # Two numbers: rows of counts and sources of the language with most of them.
    n_rows = kept.count()
    n_sources = facts.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    buckets, blocks = 1 + n_rows // BUCKET_ROWS, 1 + n_sources // BLOCK_SOURCES
    pairs = pair_distances(shared, facts, buckets, blocks)
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    both = pairs.select("lang", ways.alias("way"), "value").select(
        "lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"
    )
    over = shared.where("share > lang_share").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best)
