"""The corpus pipeline, stage by stage, against plain Python."""

import random

from test_dedup import near_components, without_repeated_chunks, without_repeats
from test_models_and_tokens import check_packed, counts

import corpus_pipeline


def _docs(spark, n=70):
    rng = random.Random(12)
    passage = "\n".join(" ".join(f"p{k}{j}" for j in range(12)) for k in range(8))
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 40, 90]))]
        text = " ".join(words)
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 0 and rows:
            text = rows[-1][1] + " more"
        rows.append((i, text if i != 12 else None, "en", "s", len(text)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_every_stage(spark, tmp_path):
    docs = _docs(spark)
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(70)], "doc_id bigint, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            assert check_packed(docs.collect(), dict(before)) < 0.1
            break
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":  # seventy labels certify nothing
            want = {i: t for i, t in before if not counts(t)[-1]}
        elif name == "line_dedup":
            want = without_repeated_chunks(before)
        elif name == "near_dedup":
            kept = {i for i, _, root in near_components(before, 5) if i == root}
            want = {i: t for i, t in before if i in kept}
        else:
            sizes = {i: n - gone for i, n, gone, *_ in without_repeats(before)}
            assert {i: len(t.encode()) for i, t in after.items()} == sizes
            want = after
        assert after == want
        assert after and all(r["n_chars"] == len(r["text"]) for r in docs.collect() if name in ("line_dedup", "suffix_dedup"))
        before = list(after.items())


def test_empty_table(spark, tmp_path):
    docs = _docs(spark).limit(0)
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


AWKWARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark string, kept boolean, stratum string"


def test_run_with_null_and_repeated_ids_and_more_columns(spark, tmp_path):
    """Rows that share an id, or have none, are judged one by one."""
    good = [f"{k} " + " ".join(f"g{k}x{j}" for j in range(60)) for k in range(7)]
    bad = "too short"
    rows = [(1, good[0], "en"), (1, bad, "en"), (1, good[1], None), (None, good[2], "en"), (None, bad, "en"), (None, bad, None)]
    rows += [(2, good[3], "en"), (3, good[3] + " more", "en"), (3, good[4], "de"), (2, bad, "en"), (4, None, None), (5, "", "en")]
    rows += [(6, good[5], "en")] * 2 + [(7, good[6], "en"), (8, good[6] + " more", "en"), (1, good[6], "fr")]
    frame = spark.createDataFrame([(*r, "s", 7, "?", False, "?") for r in rows], AWKWARD)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    documents = spark.read.parquet(str(tmp_path / "documents.parquet"))
    passed = corpus_pipeline.quality_rules(spark, documents, str(tmp_path))
    want = [(i, t) for i, t, _ in rows if t and t != bad]
    assert sorted(((r["doc_id"], r["text"]) for r in passed.collect()), key=repr) == sorted(want, key=repr)
    kept = corpus_pipeline.near_dedup(spark, documents, str(tmp_path))
    # 8 is like 7, and so is the third text of 1; the other rows that share an id can't be named in a link.
    texts = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    left = [(i, t) for i, t, _ in rows if (i, t) not in [(8, good[6] + " more"), (1, good[6])]]
    assert texts == sorted(left, key=repr)
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in done}, key=repr) == sorted({1, 2, 3, 6, 7, None}, key=repr)
    assert len({(r["sequence_id"], r["offset"]) for r in done}) == len(done)


def test_run_writes_its_stages(spark, tmp_path):
    """What run returns is the reading of a written table."""
    _docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    done = corpus_pipeline.run(spark, str(tmp_path))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    assert done.count() > 0
