"""Quality rules whose cutoffs hold a stated risk of rejecting good documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.columns import SPACES, keyed_text
from stillhouse.sources.shared import shared_folder

# Measure, SQL of its value, cutoffs from the loosest to the strictest. A document
# is rejected by a measure whose value reaches the cutoff.
MEASURES: tuple[tuple[str, str, tuple[int, ...]], ...] = (
    ("symbols", "1000 * n_symbols div n_words", (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 80, 60, 40)),
    ("dup_lines", "1000 * n_dup_lines div n_lines", (900, 800, 700, 600, 500, 400, 350, 300, 250, 200)),
    ("repeats", "1000 * n_repeat_words div n_words", (300, 280, 260, 240, 220, 200, 180, 160, 140, 120, 100)),
    ("word_length", "100 * word_chars div n_words", (5000, 4000, 3000, 2500, 2000, 1800, 1600, 1500, 1400, 1300, 1200)),
)
#: Share of a stratum's good documents that all measures together may reject.
RISK = 0.02
#: Chance that any cutoff of any stratum breaks its share.
DELTA = 0.05
#: Bad documents that a cutoff has to reject for each good one to be of use.
BAD_PER_GOOD = 10
#: Words in a window of the repetition measure.
WINDOW = 8


def features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()
) -> DataFrame:
    """Counts of each text, read whole, in its own row: no shuffle.

    ``n_words, word_chars, n_symbols, n_lines`` (lines with a word), ``n_dup_lines`` (of these,
    equal to an earlier one), ``n_repeat_words`` (words within 8-word windows that occur at
    least twice, the first included) and ``base_failed``. NULL and empty texts have no words.
    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    texts = keyed_text(docs, id_col, text_col, more)
    kept = ["doc_id", "more"]
    bare = F.regexp_replace("text", SPACES, "")
    with_word = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.expr(r"transform(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != ''), w -> xxhash64(w))")
    counted = texts.select(
        *kept,
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        with_word.alias("lines"),
        words.alias("words"),
    )
    last = f"size(words) - {WINDOW - 1}"
    windows = F.expr(
        f"if({last} < 2, array(), transform(sequence(1, {last}), i -> xxhash64(slice(words, i, {WINDOW}))))"
    )
    sized = counted.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Few texts repeat a window; only these sort theirs.
    sorted_windows = F.expr(
        """if(size(windows) = size(array_distinct(windows)), null,
              array_sort(transform(windows, (h, i) -> struct(h as h, i as i))))"""
    )
    at = F.expr(
        """array_sort(transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h)
              or (k < size(s) - 1 and s[k + 1].h = x.h)), x -> x.i))"""
    )
    covered = F.expr(
        f"""if(at is null, 0L, aggregate(at, struct(0L as n, -{WINDOW} as prev),
              (a, p) -> struct(a.n + least({WINDOW}, p - a.prev) as n, p as prev), a -> a.n))"""
    )
    rest = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    return (
        sized.select(*kept, *rest, sorted_windows.alias("s"))
        .select(*kept, *rest, at.alias("at"))
        .select(*kept, *rest, covered.alias("n_repeat_words"))
        .withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
        .select("doc_id", *[F.col(f"more.{c}").alias(c) for c in more], *rest, "n_repeat_words", "base_failed")
    )


def _log_factorial(z: str) -> str:
    """SQL of ``ln(z!)`` for whole ``z >= 0``: Stirling's series, shifted up by ten."""
    y = f"cast({z} + 11 as double)"
    series = f"({y} - 0.5D) * ln({y}) - {y} + 0.918938533204672742D + 1D / (12 * {y}) - 1D / (360 * pow({y}, 3)) + 1D / (1260 * pow({y}, 5))"
    product = " * ".join(f"cast({z} + {k} as double)" for k in range(1, 11))
    return f"({series} - ln({product}))"


def binomial_at_most(x: str, n: str, p: float) -> Column:
    """Chance of at most ``x`` hits in ``n`` trials of chance ``p``, exact but for rounding.

    Terms are summed from ``x`` down; those over 60 standard deviations away add nothing.
    """
    start = f"greatest(0L, {x} - 100L - cast(60 * sqrt({n} * {p}D * {1 - p}D) as long))"
    term = (
        f"exp({_log_factorial(n)} - {_log_factorial('k')} - {_log_factorial(f'({n} - k)')}"
        f" + k * ln({p}D) + ({n} - k) * ln({1 - p}D))"
    )
    return F.expr(f"aggregate(sequence({start}, {x}), 0D, (a, k) -> a + {term})")


def certified_cutoffs(
    labelled: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """Cutoffs per stratum: ``stratum, measure, cutoff``; none for what can't be certified.

    ``labelled`` has ``stratum``, ``good`` and the counts of ``features``. A cutoff is certified
    if the exact binomial test rejects that it turns away more than its share of the stratum's
    good documents. ``risk`` and ``delta`` are divided evenly among measures, and ``delta`` also
    among strata (Bonferroni). Within a measure cutoffs are tested from the loosest on and the
    first failure ends the sequence, which needs no further correction. Of the certified ones
    that reject ``BAD_PER_GOOD`` bad documents for each good one, the loosest is taken that
    rejects as many bad ones as any.
    """
    level = [
        f"struct({k} as measure, aggregate(array({', '.join(map(str, cuts))}), 0, (a, c) -> a + if({value} >= c, 1, 0)) as level)"
        for k, (_, value, cuts) in enumerate(MEASURES)
    ]
    reached = labelled.where("not base_failed").select(
        "stratum", "good", F.expr(f"inline(array({', '.join(level)}))")
    )
    counts = reached.groupBy("stratum", "measure", "level").agg(
        F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    cutoffs = F.create_map(
        *[x for k, (_, _, cuts) in enumerate(MEASURES) for x in (F.lit(k), F.array(*map(F.lit, cuts)))]
    )
    per_measure = counts.groupBy("stratum", "measure").agg(
        F.collect_list(F.struct("level", "good", "bad")).alias("levels"), F.sum("good").alias("n")
    )
    steps = per_measure.select(
        "stratum",
        "measure",
        "n",
        F.expr("count(1) over (partition by measure)").alias("strata"),
        F.size(F.element_at(cutoffs, F.col("measure"))).alias("cuts"),
        F.posexplode(F.element_at(cutoffs, F.col("measure"))).alias("step", "cutoff"),
        "levels",
    )
    # Cutoffs fall, so a value that reaches ``level`` of them reaches the last ones.
    above = "aggregate(filter(levels, l -> l.level >= cuts - step), 0L, (a, l) -> a + l.{})"
    hits = steps.select(
        "stratum",
        "measure",
        "step",
        "cutoff",
        "n",
        "strata",
        F.expr(above.format("good")).alias("x"),
        F.expr(above.format("bad")).alias("caught"),
    )
    share = risk / len(MEASURES)
    tested = hits.withColumn(
        "passed",
        F.expr(f"x <= n * {share}D")
        & (binomial_at_most("x", "n", share) <= F.lit(delta / len(MEASURES)) / F.col("strata")),
    )
    return (
        tested.groupBy("stratum", "measure")
        .agg(
            F.min(F.when(~F.col("passed"), F.col("step"))).alias("failed"),
            F.collect_list(F.struct("step", "cutoff", "caught", "x")).alias("steps"),
        )
        .withColumn(
            "ok",
            F.expr(
                "filter(steps, s -> (failed is null or s.step < failed)"
                f" and s.caught > 0 and s.caught >= {BAD_PER_GOOD} * s.x)"
            ),
        )
        .withColumn("most", F.expr("array_max(transform(ok, s -> s.caught))"))
        .withColumn("best", F.expr("array_min(filter(ok, s -> s.caught = most))"))
        .where("best is not null")
        .select("stratum", "measure", F.col("best.cutoff").alias("cutoff"))
    )


def risk_controlled_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    good_col: str = "quality",
    risk: float = RISK,
    delta: float = DELTA,
    more: Sequence[str] = (),
) -> DataFrame:
    """Counts and verdict of every document: those of ``features``, ``stratum``, ``rejected_by``, ``kept``.

    The columns in ``more`` are returned with each row.

    ``base_failed`` documents go. Of the others those go that reach a certified cutoff of their
    stratum (``rejected_by`` names the measures). The guarantee is per stratum; a stratum with
    too few labels to certify anything rejects nothing. Labelled rows are the holdout: nothing
    else is fitted to them. Of several labels of one id a bad one counts; NULL labels, labels of
    NULL ids and of unknown ids don't. Rows that repeat an id are all returned. A NULL stratum
    is one of its own. Other columns are ignored; empty tables give no rows.
    """
    shared_folder(docs.sparkSession)
    plain = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("stratum"), *more
    )
    # Counts are a small part of the texts and have two uses: written once to the shared folder.
    counts = features(plain, more=["stratum", *more]).checkpoint()
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg((F.min(good_col) > 0).alias("good"))
    )
    cutoffs = certified_cutoffs(counts.join(marks, "doc_id"), risk, delta)
    # One row per stratum, with a cutoff per measure where there is one.
    wide = cutoffs.groupBy(F.col("stratum").alias("cut_stratum")).agg(
        *[F.max(F.when(F.col("measure") == k, F.col("cutoff"))).alias(f"cut_{name}") for k, (name, _, _) in enumerate(MEASURES)]
    )
    judged = counts.join(wide, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    rejected = F.array_compact(
        F.array(*[F.when((~F.col("base_failed")) & F.expr(f"{value} >= cut_{name}"), F.lit(name)) for name, value, _ in MEASURES])
    )
    return judged.select(
        *counts.columns,
        rejected.alias("rejected_by"),
        ((~F.col("base_failed")) & (F.size(rejected) == 0)).alias("kept"),
    )
