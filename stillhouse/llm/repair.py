"""Repair of conversations whose rows break the order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stillhouse.llm.columns import SPACES
from stillhouse.sources.shared import new_path

#: Costs of the edits (fixed values of the contract).
REROLE, DELETE, INSERT, UNDELETED_TRUNCATED = 2, 3, 2, 1
#: Copies of a signature's edits in the join that brings them to conversations, and the length up to which they are copied.
SALTS, SALTED_LENGTH = 32, 1_000
#: Symbols that decide which range a signature goes to, and length up to which audits are kept as texts.
RANGE_SYMBOLS, KEPT_AUDITS = 64, 64

# Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEEP = {
    "s": {_START: _SYSTEM},
    "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER},
    "a": {_USER: _ASSISTANT},
}
#: The one role that may be put in, and the state after it.
_TURN = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_NAME = {_USER: "user", _ASSISTANT: "assistant"}
#: Symbol of a row that has to go. Others are the role's initial, ``o`` for other roles, upper case if truncated.
GONE = "x"


class Node(NamedTuple):
    """What is left of a conversation: least cost from each state, beyond ``base``; the edits up to
    the next row and the state after them; the whole audit from each state, for short rests."""

    base: int
    costs: tuple[int, ...]
    edits: tuple[tuple[str, int], ...]
    audits: tuple[str, ...] | None


#: Nothing is left: a user's turn needs an answer, a system's turn both.
END = Node(0, (0, 2 * INSERT, INSERT, 0), (), ("", "II", "I", ""))


class Suffixes:
    """Nodes of the automaton that reads signatures from their ends.

    Conversations with the same rest share its node. Signatures have to come in the order of
    their reversed symbols: the rest that one shares with the one before is then on the path from
    the end, every rest is worked out once, and only one path is held. Rests that cost the same
    from every state, but for a constant, share their edits as well.
    """

    def __init__(self) -> None:
        self._path, self._symbols = [END], ""
        self._steps: dict[tuple, tuple] = {}
        self.made = 0

    def _step(self, symbol: str, costs: tuple[int, ...]) -> tuple:
        """Least costs, edits and next states with a row of ``symbol`` before a rest of ``costs``."""
        found = self._steps.get((symbol, costs))
        if found is None:
            extra = UNDELETED_TRUNCATED if symbol.isupper() else 0
            direct = []
            for state in range(4):
                # In the order of the edits' initials, so of equal costs the first is the least audit.
                options = [(DELETE + costs[state], 0, "D", state)]
                if symbol != GONE:
                    kept = _KEEP.get(symbol.lower(), {}).get(state)
                    if kept is not None:
                        options.append((extra + costs[kept], 2, "K", kept))
                    turn = _TURN[state]
                    options.append((REROLE + extra + costs[turn], 3, "R", turn))
                direct.append(min(options))
            best = [(cost, edit, after) for cost, _, edit, after in direct]
            for state in range(4):
                # Putting in the next turn, or that and the one after it, before the row's own edit.
                cost, _, edit, after = direct[state]
                ways = [(cost, edit, after)]
                at, put_in = state, ""
                for _ in range(3):
                    at, put_in = _TURN[at], put_in + "I"
                    cost, _, edit, after = direct[at]
                    ways.append((cost + INSERT * len(put_in), put_in + edit, after))
                best[state] = min(ways)
            least = min(b[0] for b in best)
            found = least, tuple(b[0] - least for b in best), tuple((b[1], b[2]) for b in best)
            self._steps[symbol, costs] = found
        return found

    def path(self, signature: str) -> list[Node]:
        """Nodes of all rests of ``signature``, from the end."""
        backwards = signature[::-1]
        shared = 0
        for a, b in zip(backwards, self._symbols):
            if a != b:
                break
            shared += 1
        del self._path[shared + 1 :]
        for depth in range(shared, len(backwards)):
            rest = self._path[-1]
            least, costs, edits = self._step(backwards[depth], rest.costs)
            audits = None
            if depth < KEPT_AUDITS:
                audits = tuple(edit + rest.audits[after] for edit, after in edits)
            self._path.append(Node(rest.base + least, costs, edits, audits))
            self.made += 1
        self._symbols = backwards
        return self._path

    def repair(self, signature: str) -> tuple[int, str]:
        """Least cost of a conversation and its edits."""
        path = self.path(signature)
        cost = path[-1].base + path[-1].costs[_START]
        state, parts = _START, []
        for node in reversed(path):
            if node.audits is not None:
                return cost, "".join(parts) + node.audits[state]
            edit, state = node.edits[state]
            parts.append(edit)
        raise AssertionError("the end has its audits")


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage by a hash of id and turn: dropped, emptied, unended, repeated and misattributed rows.

    NULL roles and texts become one space; NULL ids and turns stay, and are one space in the hash.
    """

    def shown(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role = F.when(F.col("code") == 4, "user").otherwise(shown("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(shown("text"), ".!?", ""))
    rows = conversations.select("conv_id", "turn", "role", "text", code.alias("code")).where("code != 0")
    times = F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.otherwise(shown("text")).alias("text"), F.explode(times).alias("copy")
    ).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text"))).alias("digest")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows of a conversation without their texts, equal ones as one with ``copies``, and their faults."""
    blank = ~F.col("text").rlike(SPACES.replace("[", "[^", 1).rstrip("+"))
    open_end = ~F.col("text").rlike(rf"[.!?]{SPACES[:-1]}*\z")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    flat = rows.select(
        "conv_id", "turn", "role", _digest(), kind.alias("kind"), blank.alias("blank"), (~blank & open_end).alias("truncated")
    )
    counted = flat.groupBy(*flat.columns).agg(F.count("*").alias("copies"))
    same = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    return counted.withColumn("first", F.row_number().over(same) == 1)


def _signed(rows: DataFrame) -> DataFrame:
    """One row per conversation: its signature, gaps and faults, read in order from a sorted part."""
    ordered = _symbols(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    columns = ("conv_id", "turn", "kind", "blank", "truncated", "copies", "first")
    declared = (
        f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, signature string, "
        "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    )
    out = _arrow_schema(declared)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: list | None = None

        def close() -> None:
            conv_id, parts, low, high, turns, blanks, repeats, open_ends, illegal, _ = now
            gaps = 0 if low is None else high - low + 1 - turns
            done.append((conv_id, "".join(parts), gaps, blanks, repeats, open_ends, illegal))

        for batch in batches:
            for conv_id, turn, kind, blank, truncated, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        close()
                    now = [conv_id, [], None, None, 0, 0, 0, 0, 0, ""]
                if turn is not None and turn != now[3]:
                    now[2] = turn if now[2] is None else now[2]
                    now[3] = turn
                    now[4] += 1
                if blank:
                    now[5] += copies
                    now[1].append(GONE * copies)
                else:
                    if first:
                        now[1].append(kind.upper() if truncated else kind)
                        now[7] += truncated
                    now[6] += copies - first
                    now[1].append(GONE * (copies - first))
                # A role after itself is never legal.
                now[8] += copies - 1 + (now[9] != "" and now[9] + kind not in ("su", "ua", "au"))
                now[9] = kind
            if done:
                yield _batch(done, out)
                done = []
        if now is not None:
            close()
            yield _batch(done, out)

    return ordered.select(*columns).mapInArrow(sign, declared)


def _arrow_schema(declared: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(declared))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema)


def _edits(signed: DataFrame) -> DataFrame:
    """Cost and audit of each signature, all conversations together: ``sig, length, cost, audit``.

    Signatures go to ranges of their reversed symbols, so those with a common end meet in a task.
    """
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = signed.groupBy("sig").agg(F.any_value("signature").alias("signature"))
    ordered = each.withColumn("end", F.reverse(F.right("signature", F.lit(RANGE_SYMBOLS)))).repartitionByRange(
        parts, "end"
    ).sortWithinPartitions(F.reverse("signature"))
    declared = "sig binary, length bigint, cost bigint, audit string"
    out = _arrow_schema(declared)

    def work_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rests = Suffixes()
        for batch in batches:
            rows = [
                (sig, len(signature), *rests.repair(signature))
                for sig, signature in zip(*(c.to_pylist() for c in batch.columns))
            ]
            if rows:
                yield _batch(rows, out)

    return ordered.select("sig", "signature").mapInArrow(work_out, declared)


_SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _planned(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit; zeros where it has no rows."""
    spark = rows.sparkSession
    path = new_path(spark, "signatures")
    _signed(rows).withColumn("sig", F.unhex(F.md5("signature"))).write.parquet(path)
    signed = spark.read.parquet(path)
    salts = F.when(F.col("length") <= SALTED_LENGTH, SALTS).otherwise(1)
    edits = _edits(signed).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salt = F.when(F.length("signature") <= SALTED_LENGTH, F.pmod(F.hash("conv_id"), F.lit(SALTS))).otherwise(0)
    found = signed.withColumn("salt", salt).join(edits, ["sig", "salt"]).select(
        F.struct("conv_id").alias("conv"), *_SUMMARY
    )
    all_ids = ids.select(F.struct("conv_id").alias("conv")).distinct()
    joined = all_ids.join(found, "conv", "left").na.fill(0).na.fill("", ["audit"])
    return joined.select("conv.conv_id", *_SUMMARY)


def repair(rows: DataFrame, ids: DataFrame | None = None, full: bool = True) -> DataFrame:
    """Conversations with the cheapest edits that make their roles ``(system? (user assistant)+)?``.

    ``rows`` has ``conv_id, turn, role, text``. Rows go by turn, NULL first; rows of one turn by
    role and a digest of the text. Only the first fault of a row counts: blank, repeated (role and
    text seen earlier in the conversation), truncated. Blank and repeated rows are deleted, others
    kept, given another role or deleted, and turns with an empty text put in. Of equally cheap edits
    the ones whose initials are least are taken.

    With ``full`` the repaired rows are returned: ``conv_id, place, edit, role, text``. Otherwise one
    row per id in ``ids`` (those of ``rows`` by default): ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``; the digest is that of the lines ``role:text``.

    Roles and faults of a conversation are put in a signature without its texts; edits are worked
    out once per signature and end of signature. Texts are then read in order next to their edits, so
    a task holds a batch of them, whatever the length of a conversation. All rows of one conversation
    are read by one task, as its digest has to be.

    NULL roles and texts count as one space, a NULL id is a conversation. A role that begins with
    none of ``s``, ``u``, ``a`` can't be kept, nor can an empty one. An id without rows gives zeros, an
    empty audit and the digest of nothing. Other columns are left behind; an empty table gives no rows.
    """
    space = F.lit(" ")
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    planned = _planned(rows, rows if ids is None else ids)
    texts = rows.select("conv_id", "turn", "role", _digest(), "text").withColumn("head", F.lit(False))
    heads = planned.withColumn("head", F.lit(True))
    both = heads.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), *_order())
    kind = rows.schema["conv_id"].dataType.simpleString()
    if full:
        declared = f"conv_id {kind}, place bigint, edit string, role string, text string"
    else:
        declared = (
            f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "cost bigint, audit string, repaired_sha256 string"
        )
    out = _arrow_schema(declared)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        head: tuple | None = None
        audit, at, state, place, digest = "", 0, _START, 0, hashlib.sha256()

        def add(how: str, role: str, text: str) -> None:
            nonlocal place
            if full:
                done.append((head[0], place, how, role, text))
            else:
                digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            place += 1

        def put_in() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _TURN[state]
                add("I", _NAME[state], "")
                at += 1

        def close() -> None:
            put_in()
            if not full:
                done.append((*head, digest.hexdigest()))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                *summary, is_head, role, text = row
                if is_head:
                    if head is not None:
                        close()
                    head, audit = tuple(summary), summary[-1]
                    at, state, place, digest = 0, _START, 0, hashlib.sha256()
                    continue
                put_in()
                how = audit[at]
                at += 1
                if how == "K":
                    state = _KEEP[role[0]][state]
                    add(how, role, text)
                elif how == "R":
                    state = _TURN[state]
                    add(how, _NAME[state], text)
            if done:
                yield _batch(done, out)
                done.clear()
        if head is not None:
            close()
        if done:
            yield _batch(done, out)

    return ordered.select("conv_id", *_SUMMARY, "head", "role", "text").mapInArrow(edit, declared)
