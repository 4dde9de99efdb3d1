"""Audit and mixing of sources against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from cases import LONG

from stillhouse.llm import divergence
from stillhouse.llm.divergence import distinct_texts, source_divergence
from stillhouse.llm.mixing import systematic_mix

SCHEMA = "doc_id bigint, text string, lang string, source string, rank int, target double, n bigint, place bigint"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 0.5, 9, 9) for r in rows], SCHEMA).repartition(4)


# --- mixing ------------------------------------------------------------------------------------


def _mixed(rows):
    """What the mix takes, with fractions and one loop over each source."""
    sizes = defaultdict(list)
    for doc_id, text, _, source in rows:
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
        sizes[source].append((doc_id, n))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(n for _, n in sizes[s]) for s in names}
    target, free = {}, set(names)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= share
    out = []
    for s in names:
        rate = math.floor(target[s] * 2**24 / size[s]) if size[s] else 0
        at = int(hashlib.md5((b"mix" if s is None else b"mix:" + s.encode())).hexdigest()[:6], 16)
        key = lambda r: (-r[1], hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest())
        for doc_id, n in sorted(sizes[s], key=key):
            out.append((doc_id, n, size[s], float(target[s]), n * ((at + rate) // 2**24 - at // 2**24)))
            at += rate
    return out


def _rows(n=400):
    rows = [(i, "w " * (1 + i * i % 97), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(n)]
    rows += [(n, None, "en", None), (n, "a b", "en", None), (None, "x", None, "hot"), (None, "x", None, "hot")]
    rows += [(n + 1, "", "en", "empty"), (n + 2, " \t\n\x0b", "en", ""), (n + 3, LONG, "en", "long"), (n + 4, "ö\xa0ü é", "de", "")]
    return rows + [(7, "same words here", "en", "copies")] * 50


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_the_mix_is_the_systematic_sample(spark):
    rows = _rows()
    got = systematic_mix(_frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken")
    assert _sorted(got.collect()) == _sorted(_mixed(rows))


def test_the_mix_does_not_depend_on_partitions(spark):
    frame = _frame(spark, _rows())
    first = _sorted(systematic_mix(frame).collect())
    assert first == _sorted(systematic_mix(frame.repartition(13, "text")).collect())


def test_targets_are_met_and_stop(spark):
    rows = _rows(900)
    got = systematic_mix(_frame(spark, rows)).collect()
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest + 1
        assert own[0]["target"] <= 3 * own[0]["source_size"]
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in own)


def test_a_mix_of_nothing(spark):
    frame = _frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    got = systematic_mix(frame).select("size", "source_size", "target", "taken").collect()
    assert {tuple(r) for r in got} == {(0, 0, 0.0, 0)}
    assert systematic_mix(frame.where("false")).collect() == []


# --- divergence --------------------------------------------------------------------------------


def _diverged(rows, min_docs, top):
    """The audit with a count for every source and kept term."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in names), Counter()))
        own = {s: shares(counts[lang, s]) for s in names}
        for s in names:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in names if o != s]
            over = [(whole[t] - own[s][t], t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return out


def _texts():
    words = "Alpha beta GAMMA delta épsilon zeta eta theta iota kappa lambda mu nu xi Éa éA naïve b2b x-y".split()
    rows = []
    for i in range(300):
        text = " ".join(words[(i * k + k * k) % (5 + i % 14)] for k in range(i % 17))
        rows.append((i, text, ("en", "de", None)[i % 3], f"s{i % 7}" if i % 2 else "hot"))
    rows += [(900 + i, "Copy of the same alpha text.", "en", ("hot", "s1", None)[i % 3]) for i in range(40)]
    rows += [(None, None, "en", "quiet"), (None, "", "en", "quiet"), (1, "123 !?", "xx", "a"), (2, "one", "xx", "b")]
    return rows + [(3, LONG, "en", "s1"), (4, "\x00a[b]c{d}\x7fe", "en", ""), (5, "ſ K İ ß", "de", "s2")]


@pytest.mark.parametrize("min_docs, held, block", [(30, 200_000, 256), (3, 50, 2)])
def test_divergence_is_that_of_all_counts(spark, monkeypatch, min_docs, held, block):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 40 if block == 2 else 100_000)
    rows = _texts()
    got = source_divergence(_frame(spark, rows), min_docs=min_docs, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert _sorted(got.collect()) == _sorted(_diverged(rows, min_docs, 5))


def test_equal_texts_are_split_once(spark):
    rows = _frame(spark, _texts()).na.fill("", ["lang", "source", "text"])
    distinct = distinct_texts(rows.select("lang", "source", "text"))
    assert distinct.count() == len({(r[2] or "", r[1] or "") for r in _texts()})
    copies = distinct.where("text like 'Copy%'").collect()
    assert {(e["source"], e["rows"]) for e in copies[0]["spread"]} == {("hot", 14), ("s1", 13), ("", 13)}


def test_divergence_of_nothing(spark):
    frame = _frame(spark, _texts())
    assert source_divergence(frame.where("false")).collect() == []
    got = source_divergence(frame.where("lang = 'xx'")).collect()
    assert {tuple(r) for r in got} == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}
