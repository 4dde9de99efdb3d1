"""Byte pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.pieces import TEXTS_AT_ONCE, PieceCache, spread

_FOREVER = 1 << 40
# White space of the vocabulary's patterns.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder of a word-end BPE vocabulary in the tokenizers JSON format.

    Symbols are bytes; the last byte of a word is another symbol than the same byte elsewhere,
    so a word is a string over 512 letters. Encoding takes the longest token at each place, from
    an Aho-Corasick automaton over reversed tokens, keeps it if it is compatible with the token
    before it, otherwise tries the next shorter one, and steps back where none is left; places
    found to lead nowhere are never entered again, so the work is linear. Two tokens are
    compatible if the merges, in their order, would not cross the border between them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        self._end = model["end_of_word_suffix"]
        vocabulary = model["vocab"]
        letters = _byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}

        def symbols(token: str) -> str:
            last = token.endswith(self._end)
            plain = [byte_of[c] for c in (token[: -len(self._end)] if last else token)]
            return "".join(map(chr, plain[:-1])) + chr(plain[-1] + 256 * last)

        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self._id = {symbols(t): k for t, k in vocabulary.items() if t not in self.special}
        size = max(*vocabulary.values(), *self.special.values()) + 1
        self._rank: dict[tuple[int, int], int] = {}
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, both = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self._rank[a, b] = rank
            self._made.setdefault(both, (a, b, rank))
        self._right, self._left = {}, {}
        self._fits: dict[tuple[int, int], bool] = {}
        whole = {k for k in self._id.values() if k not in self._made}
        for token, (a, b, _) in sorted(self._made.items(), key=lambda x: x[1][2]):
            if a in whole and b in whole and self._compatible(a, b, but=(a, b)):
                whole.add(token)
        self._size = {k: len(s) for s, k in self._id.items()}
        self._shorter = {}
        self._longest = ahocorasick.Automaton()
        for text, token in self._id.items():
            if token in whole:
                self._longest.add_word(text[::-1], token)
                shorter = (self._id.get(text[:n]) for n in range(len(text) - 1, 0, -1))
                self._shorter[token] = next((s for s in shorter if s in whole), None)
        self._longest.make_automaton()
        names = [b""] * size
        for token, k in [*vocabulary.items(), *self.special.items()]:
            names[k] = token.encode() + b" "
        self._bytes = np.frombuffer(b"".join(names), np.uint8)
        self._bounds = np.cumsum([0, *map(len, names)])
        self._words = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._pieces = PieceCache(self._encode_pieces)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Symbols at one edge of a token while it is merged: symbol, rank of birth and of death."""
        known = self._right if side else self._left
        if token not in known:
            made = self._made.get(token)
            if made is None:
                known[token] = [(token, -1, _FOREVER)]
            else:
                inner = self._spine(made[side], side)
                symbol, birth, _ = inner[-1]
                known[token] = [*inner[:-1], (symbol, birth, made[2]), (token, made[2], _FOREVER)]
        return known[token]

    def _compatible(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``.

        A crossing merge happens if both its symbols are there at once and its rank comes before
        that of the merges that end them; of equal ranks the one further left is first.
        """
        for x, born_x, dead_x in self._spine(a, 1):
            for y, born_y, dead_y in self._spine(b, 0):
                rank = self._rank.get((x, y))
                if rank is not None and (x, y) != but and born_x < dead_y and born_y < dead_x and rank < dead_x and rank <= dead_y:
                    return False
        return True

    def _fit(self, pair: tuple[int, int]) -> bool:
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[pair] = self._compatible(*pair)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        text = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        n = len(text)
        whole = self._id.get(text)
        if whole in self._shorter:
            return [whole]
        longest = [-1] * n
        for at, token in self._longest.iter(text[::-1]):
            start = n - 1 - at
            if longest[start] < 0 or self._size[token] > self._size[longest[start]]:
                longest[start] = token
        open_ = [True] * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + self._size[token]
            if open_[end] and (not tokens or self._fit((tokens[-1], token))):
                tokens.append(token)
                at = end
                if at == n:
                    return tokens
                token = longest[at]
                continue
            token = self._shorter[token]
            while token is None:
                open_[at] = False
                last = tokens.pop()
                at -= self._size[last]
                token = self._shorter[last]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        words = self._words.findall
        return [
            np.array([k for w in words(p) for k in self.encode_word(w.encode())], "<u4").tobytes()
            for p in pieces
        ]

    def forget(self) -> None:
        """Let go of remembered pieces; the vocabulary stays."""
        self._pieces.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; strings of special tokens are those tokens."""
        parts: list[list[str]] = []
        owners: list[tuple[int, int | None]] = []
        for k, text in enumerate(texts):
            split = self._special.split(text) if "<" in text else [text]
            for part in split:
                token = self.special.get(part)
                owners.append((k, token))
                if token is None:
                    parts.append(self._split(part))
        plain = iter(self._pieces.ids(parts))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, token in owners:
            out[k].append(next(plain) if token is None else np.array([token], np.uint32))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    @staticmethod
    def _split(text: str) -> list[str]:
        # Letters are lower-cased one by one, so a sigma does not depend on its place.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return [p for p in _SPACE.split(text) if p] if odd else text.split()

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by spaces: the stretches of one byte table that ``ids`` point at."""
        return spread(self._bytes, self._bounds, ids.astype(np.int64))[:-1].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    try:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = batch.slice(first, TEXTS_AT_ONCE)
                counts, ids_sha, text_sha, ids, texts = [], [], [], [], []
                for own in bpe.encode([text or "" for text in rows.column(1).to_pylist()]):
                    data, decoded = own.astype("<u4").tobytes(), bpe.decode(own)
                    counts.append(own.size)
                    ids_sha.append(hashlib.sha256(data).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                    if full:
                        ids.append(own.astype(np.int32))
                        texts.append(decoded.decode())
                columns = [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    finally:
        bpe.forget()


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True
) -> DataFrame:
    """Ids and decoded text of every row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``full``, ``ids, decoded``.

    The vocabulary at ``path`` is read by each worker; it has to be there on every machine. NULL
    and empty texts have no ids and decode to the empty text. Rows stay as they are, NULL and
    repeated ids too. Other columns are ignored; an empty table gives no rows. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if full else ""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(partial(_encoded, path=path, full=full), schema)
