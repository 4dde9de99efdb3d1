"""Near duplicates by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.llm.graph import components
from stillhouse.llm.textbytes import mix, shingle_sets, slices
from stillhouse.sources.shared import shared_folder

#: Minhashes in a part of a key.
ROWS = 3
#: Parts in each of the two collections: 2 * 12 * 3 minhashes give 12 * 12 tables of six rows.
#: A pair of similarity 0.8 is missed with chance 2 * (1 - 0.8^3)^12 = 0.0004, one of 0.9 with 1e-7.
PARTS = 12
#: Bytes of keys that one task sorts.
BUCKET_BYTES = 24 << 20

_ENTRY = np.dtype([("key", "<u4"), ("doc", "<i8")])
_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, left binary, right binary"


def _sketch(batches: Iterator[pa.RecordBatch], size: int, rows: int, parts: int) -> Iterator[pa.RecordBatch]:
    k = 2 * rows * parts
    random = np.random.default_rng(7)
    factor = random.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = random.integers(0, 2**63, k, dtype=np.uint64)
    for batch in batches:
        counts, d1, d2, left, right = [], [], [], [], []
        for _, data, offsets in slices(batch.column(1)):
            for own in shingle_sets(data, offsets, size):
                counts.append(own.size)
                d1.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                if not own.size:
                    left.append(b"")
                    right.append(b"")
                    continue
                least = np.full(k, np.iinfo(np.uint64).max)
                for a in range(0, own.size, 4096):
                    np.minimum(least, _least(own[a : a + 4096], factor, shift), out=least)
                joined = least.reshape(2 * parts, rows)
                key = mix(joined[:, 0])
                for r in range(1, rows):
                    key = mix(key * factor[0] + joined[:, r])
                left.append(key[:parts].tobytes())
                right.append(key[parts:].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (counts, d1, d2)),
             pa.array(left, pa.binary()), pa.array(right, pa.binary()), *batch.columns[2:]],
            names=["doc_id", "n_shingles", "d1", "d2", "left", "right", *batch.schema.names[2:]],
        )


def _least(values: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Least value of each hash function over ``values``."""
    out = values[None, :] * factor[:, None]
    out += shift[:, None]
    return out.min(axis=1)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in slices(batch.column(1)):
            sets = shingle_sets(data, offsets, size)
            ends = np.cumsum([0, *(s.size for s in sets)])
            flat = pa.array(np.concatenate(sets).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            ids = batch.column(0).slice(first, len(sets)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, lists], names=["set_id", "set"])


def _deal(batches: Iterator[pa.RecordBatch], parts: int, each: int) -> Iterator[pa.RecordBatch]:
    """Keys of all tables, packed per bucket; links of documents that meet within the batch.

    Of documents with the same key in a batch only the smallest goes on, the others are linked
    to it at once. So a key that a third of all documents have reaches its bucket once a batch.
    """
    for batch in batches:
        doc = batch.column(0).to_numpy()
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, parts)
            for c in (1, 2)
        )
        packed: list[tuple[int, bool, bytes]] = []
        for table in range(parts * parts if doc.size else 0):
            i, j = divmod(table, parts)
            key = mix(left[:, i] * np.uint64(3) + right[:, j] + np.uint64(table))
            order = np.lexsort((doc, key))
            key, own = key[order], doc[order]
            fresh = np.ones(own.size, bool)
            fresh[1:] = key[1:] != key[:-1]
            bucket = (key >> np.uint64(32)) % np.uint64(each)
            name = mix((key & np.uint64(0xFFFFFFFF)) + ((np.uint64(table * each) + bucket) << np.uint64(32)))
            met = _links(name, own, fresh)
            if met.size:
                packed.append((table * each, True, met.tobytes()))
            key, own, bucket = key[fresh], own[fresh], bucket[fresh]
            entry = np.empty(own.size, _ENTRY)
            entry["key"], entry["doc"] = key & np.uint64(0xFFFFFFFF), own
            for part in np.unique(bucket).tolist():
                packed.append((table * each + part, False, entry[bucket == part].tobytes()))
        buckets, links, entries = zip(*packed) if packed else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array(links, pa.bool_()), pa.array(entries, pa.binary())],
            names=["bucket", "links", "entries"],
        )


def _links(key: np.ndarray, doc: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Meeting, document and smallest document of the same key, for all others of sorted keys."""
    head = np.maximum.accumulate(np.where(fresh, np.arange(doc.size), 0))
    rest = ~fresh
    return np.stack([key[rest].view(np.int64), doc[rest], doc[head][rest]], 1)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one bucket: those found in batches, and those of documents from different ones."""
    met = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows.loc[rows["links"], "entries"]]
    packed = rows.loc[~rows["links"], "entries"]
    entry = np.frombuffer(b"".join(packed), _ENTRY)
    entry = entry[np.lexsort((entry["doc"], entry["key"]))]
    key, doc = entry["key"].astype(np.uint64), entry["doc"]
    fresh = np.ones(doc.size, bool)
    fresh[1:] = key[1:] != key[:-1]
    # 32 bits of the key and the bucket name the meeting.
    named = mix(key + (np.uint64(rows["bucket"].iloc[0]) << np.uint64(32)))
    return pd.DataFrame(np.concatenate([*met, _links(named, doc, fresh)]), columns=["meeting", "a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets have ``100 * common >= share * all``."""
    mine = sets.select(F.col("set_id").alias("a"), F.col("set").alias("sa"))
    other = sets.select(F.col("set_id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(mine, "a").join(other, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - common
    return both.where(100 * common >= share * every).select("a", "b")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    share: int = 80,
    rows: int = ROWS,
    parts: int = PARTS,
    more: Sequence[str] = (),
) -> DataFrame:
    """Components of near duplicates: ``doc_id, n_shingles, component_id, kept``.

    A text's set is its distinct runs of ``shingle`` words, A-Z lower-cased; fewer words are one
    run. Texts are linked if ``100 * common >= share * all`` on the full sets. The component's
    id is the smallest id reachable, and its row is kept.

    1. Equal sets are one class, represented by its smallest id.
    2. Representatives get two collections of ``parts`` keys of ``rows`` minhashes each; every
       pair of one key of either is a table, so ``2 * parts * rows`` minhashes serve
       ``parts ** 2`` tables.
    3. Documents that meet in a table are paired with the smallest one there, and confirmed.
    4. Where three or more meet and don't end up in one component, some were not compared with
       each other. Those of different components now are, by an exact join on rare shingles.

    NULL, empty and blank texts have no set and are linked with nothing; with a NULL id,
    ``component_id`` is NULL and the row is kept. Rows that repeat id and text are all returned and go
    or stay together. Where rows of one id have different texts, each is linked with other rows of
    its own text alone, and stays if these share their ids as well. The columns in ``more`` are returned with each row, others
    are ignored; an empty table gives no rows.
    """
    shared_folder(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    sketches = texts.mapInArrow(partial(_sketch, size=shingle, rows=rows, parts=parts), _SKETCH + carried).checkpoint()
    texts = texts.select("doc_id", "text")
    same = ["n_shingles", "d1", "d2"]
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    # A link names documents by id, so rows whose id has several texts can't be named in one.
    several = (
        usable.groupBy("doc_id")
        .agg(F.min(F.struct(*same)).alias("one"), F.max(F.struct(*same)).alias("other"))
        .where("one != other")
        .select("doc_id")
    )
    if not several.isEmpty():
        usable = usable.join(several, "doc_id", "left_anti").select(*usable.columns)
    classes = usable.groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.min_by("left", "doc_id").alias("left"), F.min_by("right", "doc_id").alias("right")
    )
    each = 1 + sketches.count() * _ENTRY.itemsize // BUCKET_BYTES
    dealt = classes.select("rep", "left", "right").mapInArrow(
        lambda batches: _deal(batches, parts, each), "bucket int, links boolean, entries binary"
    )
    met = dealt.groupBy("bucket").applyInPandas(_meet, "meeting long, a long, b long").checkpoint()
    sizes = classes.select(F.col("rep").alias("size_id"), F.col("n_shingles").alias("n"))
    pairs = _of_like_size(met.select("a", "b").distinct(), sizes, share)
    sets = _named(texts, pairs.select(F.explode(F.array("a", "b"))), shingle)
    good = _confirmed(pairs, sets, share).checkpoint()
    found = components(good)
    rest = _uncompared(met, found, sizes, texts, shingle, share)
    good = good.union(rest).checkpoint()
    found = components(good)
    members = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        *same, F.coalesce("root", "rep").alias("root")
    )
    joined = sketches.select("doc_id", *same, *more).join(members, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        *more,
    )


def _of_like_size(pairs: DataFrame, sizes: DataFrame, share: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    a = sizes.select(F.col("size_id").alias("a"), F.col("n").alias("na"))
    b = sizes.select(F.col("size_id").alias("b"), F.col("n").alias("nb"))
    return (
        pairs.join(a, "a").join(b, "b")
        .where(100 * F.least("na", "nb") >= share * F.greatest("na", "nb"))
        .select("a", "b")
    )


def _named(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Full sets ``set_id, set`` of the documents whose ids are named."""
    own = texts.join(ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct(), "doc_id", "left_semi")
    return own.mapInArrow(partial(_sets, size=shingle), "set_id long, set array<long>")


def _uncompared(
    met: DataFrame, found: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, share: int
) -> DataFrame:
    """Confirmed links between documents that met in a table without being compared there.

    Only documents of meetings of three or more with more than one component are looked at, and
    only pairs of different components. They are joined exactly, by rare shingles: with all
    shingles in the order of their frequency, two sets with enough in common have their first
    common shingle so early in both that the rest of either is long enough. So frequent shingles
    make no pairs, unless the sets differ in little else.
    """
    root = found.select(F.col("node").alias("k"), "root")
    both = met.select("meeting", F.explode(F.array("a", "b")).alias("k")).distinct()
    rooted = both.join(root, "k", "left").select("meeting", "k", F.coalesce("root", "k").alias("root"))
    mixed = (
        rooted.groupBy("meeting")
        .agg(F.count("*").alias("met"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("met > 2 and lo != hi")
        .select("meeting")
    )
    members = (
        rooted.join(mixed, "meeting", "left_semi")
        .select("k", "root")
        .distinct()
        .join(sizes.withColumnRenamed("size_id", "k"), "k")
        .checkpoint()
    )
    sets = _named(texts, members.select("k"), shingle).checkpoint()
    often = F.count("*").over(Window.partitionBy("token"))
    ranked = (
        sets.select(F.col("set_id").alias("k"), F.explode("set").alias("token"))
        .withColumn("df", often)
        .groupBy("k")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    )
    early = f"slice(ranked, 1, size(ranked) - cast(({share} * size(ranked) + 99) div 100 as int) + 1)"
    prefix = (
        ranked.select("k", F.posexplode(F.expr(early)).alias("pos", "t"))
        .where("t.df > 1")
        .select("k", "pos", "t.token")
        .join(members, "k")
        .withColumn("left", F.col("n") - F.col("pos"))
    )
    x, y = (
        prefix.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("k", "n", "root", "left")))
        for s in "xy"
    )
    # Of a pair the smaller set is x. It needs its first common shingle earlier than a larger one.
    x = x.where(f"left_x * {100 + share} >= {2 * share} * n_x")
    pairs = (
        x.join(y, "token")
        .where("root_x != root_y and (n_x < n_y or n_x = n_y and k_x < k_y)")
        .where(f"100 * n_x >= {share} * n_y")
        .where(f"least(left_x, left_y) * {100 + share} >= {share} * (n_x + n_y)")
        .select(F.col("k_x").alias("a"), F.col("k_y").alias("b"))
        .distinct()
    )
    return _confirmed(pairs, sets, share)
