"""Conversation repair against brute force: all ways to edit a conversation, cheapest first."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from stillhouse.llm.repair import Suffixes, damage, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, head string, digest string"
LEGAL = re.compile(r"(s?(ua)+)?")


def _digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), _digest(r[1], r[2])))


def _faults(rows):
    """Per row its fault: blank, duplicate, truncated or none."""
    seen, found = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        if not shown:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif shown[-1] not in ".!?":
            found.append("truncated")
        else:
            found.append("")
        seen.add((role, text))
    return found


def _cheapest(rows, faults):
    """Least cost and audit by a search over prefixes of edits; no state of a grammar is used."""
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if (at, roles, audit) in done:
            continue
        done.add((at, roles, audit))
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        options = [("I", 2, role, "", 0) for role in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            options.append(("D", 3, None, "", 1))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                options.append(("K", 0 + more, role, text, 1))
                options += [("R", 2 + more, new, text, 1) for new in ("user", "assistant")]
        for edit, price, role, text, step in options:
            longer = roles if role is None else roles + (role[:1] or "?")
            if re.fullmatch(r"s?(ua)*u?", longer):
                kept = lines if role is None else (*lines, f"{role}:{text}")
                heapq.heappush(queue, (cost + price, audit + edit, at + step, longer, kept))


def _expected(conversations):
    """By id what the query has to return for the rows of a conversation."""
    want = {}
    for conv_id, rows in conversations.items():
        rows = _ordered(rows)
        faults = _faults(rows)
        cost, audit, text = _cheapest(rows, faults)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        want[conv_id] = (
            gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return want


def _got(frame):
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


def _table(spark, conversations):
    rows = [(c, *r, "?", "?", "?") for c, own in conversations.items() for r in own]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _random_conversations(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "sys", "Assistant"]
    texts = ["Yes.", "No", "", " \n", "Why?", "é…", "é.", "a. ", "b .c", "!"]
    return {
        k: [(rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 6))]
        for k in range(n)
    }


def test_repairs_are_the_cheapest(spark):
    conversations = _random_conversations(150, 3)
    conversations[None] = [(None, "user", "Hi."), (None, "user", "Hi."), (3, "assistant", "Yes")]
    conversations[1000] = [(0, "system", "Be kind.")]
    conversations[1001] = [(0, "user", "One."), (1, "user", "Two."), (2, "user", "Three.")]
    assert _got(repair(_table(spark, conversations), full=False)) == _expected(conversations)


def test_repaired_rows_are_legal_and_give_the_digest(spark):
    conversations = _random_conversations(60, 8)
    frame = _table(spark, conversations)
    rows = {}
    for r in repair(frame).collect():
        rows.setdefault(r["conv_id"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    for conv_id, want in _expected(conversations).items():
        own = sorted(rows.get(conv_id, []))
        assert [r[0] for r in own] == list(range(len(own)))
        assert LEGAL.fullmatch("".join(r[2][0] for r in own))
        assert "".join(r[1] for r in own) == want[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in own).encode()).hexdigest() == want[-1]


def test_nulls_missing_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, None, None, None), (2, 4, "user", None), (2, None, None, "x.")], SCHEMA[: SCHEMA.index(", audit")])
    ids = spark.createDataFrame([(1,), (2,), (7,), (7,), (None,)], "conv_id bigint")
    got = _got(repair(frame, ids, full=False))
    nothing = hashlib.sha256(b"").hexdigest()
    want = _expected({1: [(None, " ", " ")], 2: [(4, "user", " "), (None, " ", "x.")]})
    assert got == want | {7: (0, 0, 0, 0, 0, 0, "", nothing), None: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repair(frame.where("false"), full=False).collect() == []
    assert repair(frame.where("false")).collect() == []


def test_one_long_conversation(spark):
    rows = [(i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 7 else "") for i in range(6000)]
    rows += [(9000, "user", "Turn 1.")] * 500
    frame = _table(spark, {5: rows})
    got = _got(repair(frame, full=False))[5]
    assert got[0] == 9000 + 1 - 6001 and got[1] == 858 and got[2] == 499
    assert got[4] == 499 and len(got[6].replace("I", "")) == 6500
    assert got[5] == Suffixes().repair("".join("x" if i % 7 == 0 else "ua"[i % 2] for i in range(6000)) + "u" + "x" * 499)[0]


def test_ends_are_worked_out_once():
    rng = random.Random(4)
    signatures = {"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 9))) for _ in range(3000)}
    signatures |= {"ua" * 300, "x" + "ua" * 300}
    rests = Suffixes()
    alone = {s: Suffixes().repair(s) for s in signatures}
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        assert rests.repair(signature) == alone[signature]
    assert rests.made == len({s[i:] for s in signatures for i in range(len(s))})


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_all_short_signatures(length):
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for symbols in itertools.product("suaoSUAOx", repeat=length):
        rows = [(i, roles[c.lower()], str(i)) for i, c in enumerate(symbols)]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in symbols]
        assert Suffixes().repair("".join(symbols)) == _cheapest(rows, faults)[:2]


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No! Why?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        row = (conv_id, turn, "user" if code == 4 else role, text)
        want += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(tuple, damage(frame).collect()), key=repr) == sorted(want, key=repr)
