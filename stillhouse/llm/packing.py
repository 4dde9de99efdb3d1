"""Packing of token streams into sequences, in order, by dynamic programming."""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stillhouse.llm.bpe import _byte_letters
from stillhouse.llm.pieces import TEXTS_AT_ONCE, PieceCache, cut_up

#: Tokens of a sequence.
WINDOW = 1024
#: Cost of a cut inside a document at a sentence's end, in tokens of padding.
SENTENCE_CUT = 1.0
#: Cost of a cut inside a sentence.
INNER_CUT = 8.0
#: Tokens over which the cuts are chosen together.
BLOCK = 1 << 20

# Fixed value: the splitting rule of byte-level vocabularies.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """Ids of a byte-level vocabulary in the tokenizers JSON format.

    Texts are cut at single spaces and line ends between other characters: the splitting rule
    never joins what stands before such a place with what follows. Pieces not seen before are
    encoded by the same merges in the faster of the libraries; texts with other white space or
    with strings of special tokens are encoded whole.
    """

    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        self._special = [t["content"] for t in parts["added_tokens"]]
        ranks = {
            bytes(byte_of[c] for c in token): k
            for token, k in parts["model"]["vocab"].items()
            if token not in self._special
        }
        self._fast = tiktoken.Encoding("pieces", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        ends = [k for token, k in ranks.items() if token[-1:] in (b".", b"!", b"?", b"\n")]
        self.ends_sentence = np.zeros(max(ranks.values()) + 2, bool)
        self.ends_sentence[ends] = True
        self._begins = np.zeros(max(ranks.values()) + 2, bool)
        self._begins[[k for token, k in ranks.items() if token[:1] == b" "]] = True
        self._pieces = PieceCache(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes | None]:
        """Pieces that follow a space, all in one text; those that follow a line end, one by one."""
        plain = [p for p in pieces if p[:1] != "\n"]
        joined = " ".join(plain)
        if joined.split() != plain:
            plain = [p for p in plain if p.split() == [p]]
            joined = " ".join(plain)
        found: dict[str, bytes] = {}
        if plain:
            ids = np.array(self._fast.encode_ordinary(" " + joined), np.uint32)
            # Only the first token of a piece begins with a space.
            found = dict(zip(plain, cut_up(ids, np.flatnonzero(self._begins[ids]))))
        for piece in pieces:
            if piece[:1] == "\n" and piece[1:].split() == [piece[1:]]:
                found[piece] = np.array(self._fast.encode_ordinary(piece), "<u4").tobytes()
        return [found.get(p) for p in pieces]

    def forget(self) -> None:
        """Let go of remembered pieces; the vocabulary stays."""
        self._pieces.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        heads, tails, plain = [], [], []
        for k, text in enumerate(texts):
            if not any(s in text for s in self._special):
                head, *tail = text.replace("\n", " \n").split(" ")
                heads.append(head)
                tails.append(tail)
                plain.append(k)
        out: list[np.ndarray | None] = [None] * len(texts)
        for k, head, ids in zip(plain, heads, self._pieces.ids(tails)):
            if ids is not None and head.split() == [head]:
                first = self._fast.encode_ordinary(head)
                out[k] = np.concatenate([np.array(first, np.uint32), ids])
            else:
                out[k] = np.array(self._fast.encode_ordinary(texts[k]), np.uint32)
        for k, ids in enumerate(out):
            if ids is None:
                whole = self._whole.encode(texts[k], add_special_tokens=False).ids
                out[k] = np.array(whole, np.uint32)
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def choose_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of least total padding and cost of cuts, the first and the last included.

    ``places`` ascend by at most ``window``. A sequence is padded to ``window`` unless its length
    is a power of two. The least cost up to a place is ``window`` plus the least of (cost before
    a sequence plus its start) over starts within reach, less the place: a sliding minimum, kept
    in a queue of growing values. Exact halves and quarters of a
    window need no padding and are looked up besides.
    """
    p = places.tolist()
    n = len(p)
    exact: dict[int, list[int]] = {}
    length = window >> 2
    while length < window:
        at = np.searchsorted(places, places - length)
        for j in np.flatnonzero((places >= length) & (places[np.minimum(at, n - 1)] == places - length)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        length *= 2
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(p[0]), 0)])
    costs = costs.tolist()
    for j in range(1, n):
        here = p[j]
        reach = here - window
        while p[queue[0][1]] < reach:
            queue.popleft()
        value, i = queue[0]
        value += window - here
        if j in exact:
            for k in exact[j]:
                if best[k] <= value:
                    value, i = best[k], k
        value += costs[j]
        best[j], back[j] = value, i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return places[cuts[::-1]]


class _Block:
    """Tokens that wait for their cuts, with the documents they belong to."""

    def __init__(self, ends_sentence: np.ndarray, window: int, sentence_cut: float, inner_cut: float):
        self._ends, self._window = ends_sentence, window
        self._sentence_cut, self._inner_cut = sentence_cut, inner_cut
        self._parts: list[tuple[object, int, int, np.ndarray]] = []
        self.size = 0
        self._made = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self._parts.append((doc_id, 0, ids.size, ids))
        self.size += ids.size

    def cut(self, last: bool) -> dict[str, list]:
        """Pieces of all sequences but, unless this is the ``last`` block, the last few."""
        out: dict[str, list] = {k: [] for k in _COLUMNS}
        if not self.size:
            return out
        ids = np.concatenate([part for *_, part in self._parts])
        ends = np.cumsum([part.size for *_, part in self._parts])
        cost = np.full(ids.size + 1, np.inf)
        cost[:: self._window] = self._inner_cut
        cost[1:][self._ends[ids]] = self._sentence_cut
        cost[ends] = 0
        cost[0] = 0
        places = np.flatnonzero(np.isfinite(cost))
        cuts = choose_cuts(places, cost[places], self._window)
        if not last:
            cuts = cuts[: max(1, np.searchsorted(cuts, ids.size - 4 * self._window))]
        k, begin = 0, 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = a
            while at < b:
                doc_id, start, total, part = self._parts[k]
                stop = min(b, int(ends[k]))
                own = ids[at:stop]
                row = (doc_id, start + at - begin, stop - at, zlib.crc32(own.astype("<u4").tobytes()), total, self._made, at - a)
                for name, value in zip(_COLUMNS, row):
                    out[name].append(value)
                at = stop
                if at == ends[k]:
                    begin = at
                    k += 1
            self._made += 1
        done = int(cuts[-1])
        rest = self._parts[k:]
        if rest:
            doc_id, start, total, part = rest[0]
            rest[0] = (doc_id, start + done - begin, total, part[done - begin :])
        self._parts, self.size = rest, ids.size - done
        return out


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _packed(
    batches: Iterator[pa.RecordBatch], path: str, window: int, sentence_cut: float, inner_cut: float, block: int
) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    waiting = _Block(bpe.ends_sentence, window, sentence_cut, inner_cut)
    base = TaskContext.get().partitionId() << 40
    stop = np.zeros(1, np.uint32)
    kind = None

    def rows(last: bool) -> pa.RecordBatch:
        out = waiting.cut(last)
        out["sequence_id"] = [base + k for k in out["sequence_id"]]
        types = [kind, *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(_COLUMNS, types)], names=_COLUMNS)

    try:
        for batch in batches:
            kind = batch.column(0).type
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(first, TEXTS_AT_ONCE)
                encoded = bpe.encode([text or "" for text in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded):
                    waiting.add(doc_id, np.concatenate([ids, stop]))
                    if waiting.size >= block:
                        yield rows(False)
        if kind is not None:
            yield rows(True)
    finally:
        bpe.forget()


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    sentence_cut: float = SENTENCE_CUT,
    inner_cut: float = INNER_CUT,
    block: int = BLOCK,
) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and the id 0. The documents of an input partition are one stream, in
    their order; the stream is cut at ends of documents, at ends of sentences or, where the
    distance asks for it, inside sentences, so that padding and the costs of cuts are least
    (``choose_cuts``). Cuts are chosen over blocks of ``block`` tokens, the last few sequences of
    which go on into the next block, so a task holds one block and one document. There is no
    shuffle; each partition ends with one sequence that may be short.

    NULL and empty texts are the id 0 alone. Rows with a NULL or repeated id are documents like
    any other. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COLUMNS[1:])
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    job = partial(_packed, path=path, window=window, sentence_cut=sentence_cut, inner_cut=inner_cut, block=block)
    return own.mapInArrow(job, schema)
