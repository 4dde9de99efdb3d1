"""A table with every awkward row, shared by the tests of the text operators."""

from __future__ import annotations

CLASHING = ("h", "salt", "node", "first", "chunk", "lines", "marked", "stratum", "root", "rep", "shard", "more", "kept")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"{c} string" for c in CLASHING
)

LONG = " ".join(f"word{i % 977} tail{i * 7919 % 10007}" for i in range(40_000))
PASSAGE = "The quick brown fox jumps over the lazy dog and then it sleeps for a whole long day."
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "x"),
    (7, "x"),
    (7, "x"),
    (8, LONG),
    (9, LONG + " more"),
    (None, "x"),
    (None, None),
    (10, f"one line\n{PASSAGE}\nanother line here\nthe end é ü"),
    (11, f"start é\n{PASSAGE}\nanother line here\nother end"),
    (12, "é" * 60),
    (13, "ab" + "é" * 60 + "c"),
    (14, "<|endoftext|> it's <|startoftext|> we'll 123 !?  　 ΣΑΣ"),
    (15, "a\nb\na\nb\na\nb\na\nb"),
]


def table(spark, rows=ROWS):
    full = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or "")) + ("?",) * len(CLASHING) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
