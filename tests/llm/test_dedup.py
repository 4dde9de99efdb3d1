"""Exact, line, near and passage removal against plain Python on awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from cases import ROWS, table

from stillhouse.llm import suffix
from stillhouse.llm.exact import exact_groups
from stillhouse.llm.graph import components
from stillhouse.llm.lines import remove_repeated_chunks
from stillhouse.llm.near import near_groups
from stillhouse.llm.suffix import remove_repeats


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    got = exact_groups(table(spark), keep=keep, nodes=5, fan_in=2).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(_lower(t), []).append(i)
    want = []
    for i, t in ROWS:
        ids = [k for k in groups[_lower(t)] if k is not None]
        kept = (min if keep == "smallest" else max)(ids) if ids else None
        sha = hashlib.sha256(_lower(t).encode()).hexdigest()
        want.append((i, kept, len(groups[_lower(t)]), i == kept, sha))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert exact_groups(table(spark).limit(0)).count() == 0


def test_runs_are_sorted_and_merged_in_every_round(spark):
    """Each round has an exchange, a sort by digest and id, and takes the first row of a digest."""
    done = exact_groups(table(spark), nodes=8, fan_in=2)
    plan = done._jdf.queryExecution().executedPlan().toString()
    rounds = 3
    assert len(re.findall(r"Sort \[node#\d+L ASC NULLS FIRST, sha#\d+ ASC NULLS FIRST, check", plan)) >= rounds
    assert len(re.findall(r"Exchange hashpartitioning\(node#\d+L, sha#\d+, 8\), REPARTITION_BY_NUM", plan)) == rounds


def test_exact_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(900)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(table(spark, rows)).collect()}
    assert got == {i: (1, 600) if i % 3 else (i, 1) for i in range(900)}


def chunks(text):
    """Chunks of lines, by the same rule in plain Python."""
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out = [[lines[0]]]
    for i in range(1, len(lines)):
        if i > 1 and (3 * h[i - 2] + h[i - 1]) % 4 == 0:
            out.append([])
        out[-1].append(lines[i])
    return out


def without_repeated_chunks(rows):
    """``id -> kept text`` for rows with unique ids."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for c in chunks(t):
            piece = "\n".join(c)
            removable = len(c) >= 2 and re.search(r"[^\x20\x09-\x0D]", piece)
            if not removable or piece not in seen:
                kept += c
            seen.setdefault(piece, i)
        out[i] = "\n".join(kept)
    return out


def _line_rows(seed=4, n=60):
    rng = random.Random(seed)
    block = [f"shared line {k}" for k in range(30)]
    rows = []
    for i in range(n):
        lines = [f"own {i} {k}" for k in range(rng.randrange(6))]
        at = rng.randrange(20)
        lines += block[at : at + rng.randrange(12)] + ["", " "] * rng.randrange(3)
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines(spark):
    rows = [*_line_rows(), (100, None), (101, "one"), (None, "shared line 3\nshared line 4\nshared line 5")]
    frame = remove_repeated_chunks(table(spark, rows), more=["lines", "lang"])
    got = {r["doc_id"]: r["kept_text"] for r in frame.collect()}
    assert got == without_repeated_chunks(rows)
    assert {r["lines"] for r in frame.collect()} == {"?"}
    assert frame.agg({"n_removed_chunks": "sum"}).first()[0] > 10
    assert remove_repeated_chunks(table(spark).limit(0)).count() == 0
    assert remove_repeated_chunks(table(spark)).count() == len(ROWS)


@pytest.mark.parametrize("row_id", [None, 5])
def test_lines_of_rows_that_share_an_id(spark, row_id):
    """A chunk goes only from the row that repeats it, and what stands nowhere else stays."""
    blocks = {}
    for k in range(400):  # passages that are one chunk each, wherever they stand
        piece = [f"line {k} a", f"line {k} b", f"line {k} c"]
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in piece]
        if (3 * h[0] + h[1]) % 4 and (3 * h[1] + h[2]) % 4 == 0:
            blocks.setdefault("ends", []).append("\n".join(piece))
    a, b, c, d, e = blocks["ends"][:5]
    texts = ["\n".join(t) for t in ([a, b, c], [d, a, e], [b, e], [b, e])]
    rows = [(row_id, t) for t in texts]
    got = Counter(r["kept_text"] for r in remove_repeated_chunks(table(spark, rows)).collect())
    order = sorted(set(texts), key=lambda t: hashlib.sha256(t.encode()).digest()[:16])
    seen, kept = set(), {}
    for t in order:
        own = ["\n".join(x) for x in chunks(t)]
        kept[t] = "\n".join(x for x in own if x not in seen)
        seen.update(own)
    assert got == Counter(kept[t] for t in texts)
    assert all(any(p in t for t in got) for p in (a, b, c, d, e))


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", _lower(text)) if w]
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def near_components(rows, size, share=80):
    """Component of each row, all pairs compared."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= share * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def _near_rows(seed=9):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(copy)))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, size):
    rows = [*_near_rows(), *[r for r in ROWS if r[0] not in (None, 7)]]
    got = near_groups(table(spark, rows), shingle=size).collect()
    want = near_components(rows, size)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_awkward(spark):
    got = near_groups(table(spark), shingle=2).collect()
    assert len(got) == len(ROWS)
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(None, True)}
    assert [r["component_id"] for r in got if r["doc_id"] == 7] == [6, 6]
    assert near_groups(table(spark).limit(0)).count() == 0


def test_near_where_a_template_hides_the_links(spark):
    """Documents that meet everywhere by a template, similar in pairs only: none is lost."""
    rng = random.Random(2)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for pair in range(25):
        own = [f"p{pair}x{k}" for k in range(40)]
        for _ in range(2):
            last = [f"q{rng.randrange(10**6)}" for _ in range(4)]
            rows.append((len(rows), " ".join(template + own + last)))
    got = near_groups(table(spark, rows), shingle=1).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(near_components(rows, 1))


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (5, 5)]
    random.Random(1).shuffle(links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {**dict.fromkeys(range(1, 61), 0), 101: 100, 103: 100}


def without_repeats(rows):
    """``(id, bytes, removed, spans, sha)`` and kept bytes, every window compared."""
    first = {}
    texts = [((-(2**63) if i is None else i), (t or "").encode()) for i, t in rows]
    for i, data in texts:
        for k in range(len(data) - 49):
            w = data[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for (row_id, _), (i, data) in zip(rows, texts):
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((row_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(spark, monkeypatch):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdefgh éü") for _ in range(rng.randrange(40, 200))) for _ in range(8)]
    rows = [(rng.randrange(1000), "".join(rng.choice(shared)[rng.randrange(30) :] for _ in range(rng.randrange(5)))) for _ in range(60)]
    rows += [(2000, "a" * 500), (2001, "a" * 49), (2002, "b" + "a" * 120), *[r for r in ROWS if r[0] not in (8, 9)]]
    got = remove_repeats(table(spark, rows), more=["more", "lang"]).collect()
    keys = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[k] for k in keys) for r in got) == Counter(without_repeats(rows))
    assert {r["more"] for r in got} == {"?"} and {r["lang"] for r in got} == {"en", None}
    assert remove_repeats(table(spark).limit(0)).count() == 0


def _buckets_of_a_passage():
    """Bytes that each bucket gets where every document has a passage behind text of its own."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(120))
    rows = [(k, "".join(rng.choice(letters) for _ in range(60)) + passage) for k in range(600)]
    parts = [rows[k::4] for k in range(4)]
    frames = []
    for part in parts:
        data = [t.encode() for _, t in part]
        size = np.array([len(x) for x in data])
        none = np.zeros(size.size, np.int64)
        ids = np.array([i for i, _ in part])
        blob = suffix._press(ids, np.ones(size.size, bool), size, np.frombuffer(b"".join(data), np.uint8), none, np.zeros(0, np.uint8))
        frames.append(pd.DataFrame({"docs": [blob]}))
    names = pd.concat([suffix._names((k,), f, 64) for k, f in enumerate(frames)])
    again = pd.concat([suffix._repeated((b,), own) for b, own in names.groupby("bucket")])
    total = Counter()
    for k, f in enumerate(frames):
        for _, row in suffix._strings((k,), f, again[again["shard"] == k], 64).iterrows():
            total[row["bucket"]] += suffix._unpress(row["entries"], "<i8", "<i8", "<i8", "<i8", "u1")[4].size
    return total


def test_a_hot_name_is_dealt_out(monkeypatch):
    held = _buckets_of_a_passage()
    monkeypatch.setattr(suffix, "HOT_BYTES", 8_000)
    dealt = _buckets_of_a_passage()
    assert max(held.values()) > 0.5 * sum(held.values())
    assert max(dealt.values()) < 0.1 * sum(dealt.values())


def test_passages_under_hot_names(spark, monkeypatch):
    """The same result where every name is hot: windows go by their own hash."""
    remembered = suffix._repeated

    def repeated(key, rows):
        most, suffix.HOT_BYTES = suffix.HOT_BYTES, 0  # in the worker, which others use afterwards
        try:
            return remembered(key, rows)
        finally:
            suffix.HOT_BYTES = most

    monkeypatch.setattr(suffix, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(suffix, "_repeated", repeated)
    rng = random.Random(7)
    shared = ["".join(rng.choice("abcdefgh éü") for _ in range(rng.randrange(60, 200))) for _ in range(6)]
    rows = [(k, f"own {rng.random()} " + rng.choice(shared) + f" {rng.random()}") for k in range(60)] + [(None, shared[0])]
    got = remove_repeats(table(spark, rows)).collect()
    keys = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[k] for k in keys) for r in got) == Counter(without_repeats(rows))
    assert sum(r["n_removed"] for r in got) > 1_000


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(40):
        letters = rng.choice(["a", "ab", "abcdefgh"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 300)))
        text += text[: rng.randrange(len(text) + 1)]
        data = np.frombuffer(text.encode(), np.uint8)
        order = suffix.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = [0]
        for a, b in itertools.pairwise(order.tolist()):
            common.append(next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b)))
        assert suffix.common_prefixes(data, order).tolist() == common


def test_window_minima_over_several_arrays(monkeypatch):
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 300)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd") for _ in range(90)) for _ in range(6)]
    texts = sorted({(rng.choice(base) + rng.choice(base))[rng.randrange(40) :][: rng.randrange(50, 100)].encode() for _ in range(60)})
    docs = np.array([rng.randrange(50) for _ in texts])
    first = {}
    for text, doc in zip(texts, docs.tolist()):
        for k in range(len(text) - 49):
            first[text[k : k + 50]] = min(first.get(text[k : k + 50], 99), doc)
    values, bounds = suffix.window_minima(texts, docs)
    for k, text in enumerate(texts):
        assert values[bounds[k] : bounds[k + 1]].tolist() == [first[text[i : i + 50]] for i in range(len(text) - 49)]


def _passage_docs(seed, n=40):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = []
    for i in range(n):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 200)))
        a = rng.randrange(0, 200)
        rows.append((i // 2 if i % 5 else None, own + passage[a : a + rng.randrange(40, 300)] + own[:30]))
    return rows


def test_strings_have_the_same_numbers_however_documents_were_cut():
    """A shard that is read again in other blobs, as after a lost executor, tells the same strings."""
    rows = _passage_docs(4)

    def blobs(order, size):
        out = []
        for at in range(0, len(order), size):
            part = [rows[k] for k in order[at : at + size]]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([r[1].encode() for r in part], pa.binary()),
                    pa.array([0] * len(part), pa.int64()),
                    pa.array([f"m{k}" for k in order[at : at + size]], pa.string()),
                ],
                names=["doc_id", "data", "shard", "more"],
            )
            out += [b for done in suffix._dealt(iter([batch])) for b in done.column(1).to_pylist()]
        return out

    def told(parts):
        docs = pd.DataFrame({"docs": parts})
        names = suffix._names((0,), docs, 3)
        back = pd.concat([suffix._repeated((b,), g) for b, g in names.groupby("bucket")])
        return docs, back, suffix._strings((0,), docs, back, 3)

    order = list(range(len(rows)))
    docs, back, strings = told(blobs(order, 100))
    other = order[:]
    random.Random(9).shuffle(other)
    docs2, back2, strings2 = told(blobs(other, 7))
    key = lambda f: sorted(zip(f["bucket"], f["entries"]))
    assert key(strings) == key(strings2) and len(strings)
    minima = pd.concat([suffix._minima((b,), g) for b, g in strings.groupby("bucket")])
    # strings told by one reading, removed by another
    one = suffix._removed((0,), docs, pd.concat([back, minima]), 3, True)
    two = suffix._removed((0,), docs2, pd.concat([back2, minima]), 3, True)
    assert sorted(map(repr, one.itertuples(index=False))) == sorted(map(repr, two.itertuples(index=False)))
    assert one["n_removed"].sum() > 0


@pytest.mark.parametrize("more", [[], ["lang", "source"]])
def test_line_dedup_shuffles_texts_once(spark, more):
    common = "\n".join(f"line {k} of the common text" for k in range(20))
    docs = table(spark, [(i, f"{common}\nown {i}\nand {i}") for i in range(30)])
    done = remove_repeated_chunks(docs, more=more)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    by_row = [line for line in plan if "Exchange hashpartitioning(coalesce(doc_id" in line]
    assert len([line for line in by_row if "ReusedExchange" not in line]) == 1
    assert any("ReusedExchange" in line and "load" in line for line in by_row)
