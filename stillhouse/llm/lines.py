"""Repeated passages of lines, found as content-defined chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.columns import keyed_text

#: Mean number of lines in a chunk.
MEAN_LINES = 4
#: Fewest lines of a chunk that is removed.
MIN_LINES = 2
#: Tasks over which the places of one chunk are spread.
SALTS = 32
#: Where a chunk stands: id and digest of its row's text, and its number there.
PLACE = ["doc_id", "whole", "chunk"]


def _number(line: Column) -> Column:
    """32-bit hash of a line, from its MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _chunked(docs: DataFrame, mean_lines: int) -> DataFrame:
    """Lines of each text and ``chunks``: number, first line and length of each.

    A chunk ends after a line where the rolling hash of this line and the one before it is a
    multiple of ``mean_lines``; only two lines decide, so chunks of a passage that was moved or
    has lines put in front are the same again from its second boundary on.
    """
    rest = [c for c in docs.columns if c != "text"]
    split = docs.select(*rest, F.split("text", "\n", -1).alias("lines"))
    numbered = split.select(*rest, "lines", F.transform("lines", _number).alias("numbers"))
    rolling = (
        "case when i = size(numbers) - 1 then true when i = 0 then false "
        f"else (3 * numbers[i - 1] + numbers[i]) % {mean_lines} = 0 end"
    )
    ends = F.expr(f"filter(sequence(0, size(numbers) - 1), i -> {rolling})")
    return numbered.select(*rest, "lines", ends.alias("ends")).select(
        *rest, "lines", F.expr(_CHUNKS).alias("chunks")
    )


_CHUNKS = """transform(ends, (e, c) -> struct(c as chunk,
        if(c = 0, 0, ends[c - 1] + 1) as first,
        e - if(c = 0, -1, ends[c - 1]) as n_lines))"""


def remove_repeated_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean_lines: int = MEAN_LINES,
    min_lines: int = MIN_LINES,
    more: Sequence[str] = (),
) -> DataFrame:
    """Texts without chunks of lines that stand earlier: ``doc_id, kept_text, n_lines, n_chunks, n_removed_chunks, n_removed_lines``.

    Of chunks with equal bytes and at least ``min_lines`` lines, not all of them blank, the first
    by ``(id, place in the text)`` stays, in whichever document it is. Candidates are found by
    hash; a chunk goes only where its bytes equal those of an earlier one.

    The columns in ``more`` are returned with each row.

    NULL text counts as empty: one empty line, never removed. Rows that share an id, or have none,
    are told apart by a digest of their texts, in whose order they come; rows with equal id and
    text are one place and stay alike. NULL ids come before all others. Other columns are ignored; an empty table gives no rows.
    """
    whole = F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("whole")
    carried = F.to_json("more", {"ignoreNullFields": "false"}) if more else F.lit(None).cast("string")
    # Text and what is carried are one array: both uses of the texts then shuffle the same column.
    texts = keyed_text(docs, id_col, text_col, more).select(
        "doc_id", "text", whole, F.array("text", carried).alias("load")
    )
    piece = F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.n_lines")), "\n")
    keyed = (
        _chunked(texts.drop("load"), mean_lines)
        # There is always a chunk; a plain explode would filter by the whole expression first.
        .select("doc_id", "whole", "lines", F.explode_outer("chunks").alias("c"))
        .where(F.col("c.n_lines") >= min_lines)
        .select("doc_id", "whole", F.col("c.chunk").alias("chunk"), piece.alias("piece"))
        .where(F.col("piece").rlike(r"[^\x20\x09-\x0D]"))
    )
    # Hashes that occur at more than one place; nothing but hashes and places is shuffled.
    hashed = keyed.select(*PLACE, F.xxhash64("piece").alias("h"))
    marked = _per_row(_repeated(hashed, "h"))
    # The chunks so marked are compared by their bytes: grouped by the text itself.
    suspects = (
        _chunked(_with_marked(texts, marked), mean_lines)
        .select("doc_id", "whole", "lines", "chunks", F.explode_outer("marked").alias("chunk"))
        .select(*PLACE, "lines", F.get("chunks", F.col("chunk")).alias("c"))
        .where("c is not null")
        .select(*PLACE, piece.alias("piece"))
    )
    removed = _per_row(_repeated_bytes(suspects).where(F.struct(*PLACE) != F.col("first")))
    parts = (
        _chunked(_with_marked(texts, removed), mean_lines)
        .withColumn("more", F.from_json("carried", docs.select(*more).schema) if more else F.lit(None))
        .withColumn("numbers", F.transform("chunks", lambda c: c["chunk"]))
        .withColumn(
            "stay",
            F.when(F.col("marked").isNull(), F.col("numbers")).otherwise(
                F.array_except("numbers", "marked")
            ),
        )
        .withColumn(
            "kept",
            F.when(F.col("marked").isNull(), F.col("lines")).otherwise(
                F.expr(
                    "flatten(transform(stay, k ->"
                    " slice(lines, chunks[k].first + 1, chunks[k].n_lines)))"
                )
            ),
        )
    )
    return parts.select(
        "doc_id",
        *([F.col(f"more.{c}").alias(c) for c in more]),
        F.array_join("kept", "\n").alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"),
        (F.size("chunks") - F.size("stay")).cast("long").alias("n_removed_chunks"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed_lines"),
    )


def _repeated(places: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands at more than one place, with the ``first`` of these places."""
    keys = places.groupBy(key).agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
    return _told(places, keys.where("first != last"), key)


def _repeated_bytes(suspects: DataFrame) -> DataFrame:
    """The same for chunks, compared by their bytes.

    The grouping is by the text itself. Its result goes back to the places by digest, so no text
    is shuffled again; a digest that two different texts had would be left out.
    """
    digest = F.unhex(F.sha2("piece", 256)).alias("digest")
    texts = suspects.groupBy("piece").agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
    keys = (
        texts.select(digest, "first", "last")
        .groupBy("digest")
        .agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where("texts = 1 and first != last")
    )
    return _told(suspects.select(*PLACE, digest), keys, "digest")


def _told(places: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Places with the first place of their key, for the keys given.

    The one row of a key is copied per salt, so the places of a key that a third of all
    documents have are spread over that many tasks.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keys = keys.select(key, "first", copies)
    salted = places.withColumn("salt", F.pmod(F.hash(*PLACE), F.lit(SALTS)))
    return salted.join(keys, [key, "salt"])


def _per_row(places: DataFrame) -> DataFrame:
    row = F.col("doc_id").alias("marked_id"), F.col("whole").alias("marked_whole")
    return places.groupBy(*row).agg(F.collect_set("chunk").alias("marked"))


def _with_marked(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """Texts with their marked chunks.

    Both uses join the same columns by the same null-safe keys: nothing is filtered or left out on
    one of the sides only, so Spark shuffles the texts once.
    """
    same = F.col("doc_id").eqNullSafe(F.col("marked_id")) & F.col("whole").eqNullSafe(F.col("marked_whole"))
    joined = texts.select("doc_id", "whole", "load").join(marked, same, "left")
    return joined.select(
        "doc_id", "whole", F.get("load", F.lit(0)).alias("text"), F.get("load", F.lit(1)).alias("carried"), "marked"
    )
