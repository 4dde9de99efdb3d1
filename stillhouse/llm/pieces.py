"""Token ids of pieces of text, remembered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Bytes of pieces and ids that a task remembers before it starts anew, what Python needs for them included.
REMEMBERED_BYTES = 64 << 20
#: Bytes that an entry takes besides its characters and ids: a text, bytes and their place in a table.
_ENTRY_BYTES = 200
#: Texts whose new pieces are encoded together.
TEXTS_AT_ONCE = 200


class PieceCache:
    """Ids of lists of pieces; most pieces were seen before and cost one look-up.

    ``encode`` gets new pieces, each once, and returns the ids of every one as bytes of unsigned
    32-bit numbers, or None for a piece that can't stand alone. The memory is emptied between
    calls once it holds so many bytes, and by ``forget`` at the end of a task, so that an idle worker
    holds nothing; the ids don't depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[bytes | None]]):
        self._encode = encode
        self.forget()

    def forget(self) -> None:
        self._known: dict[str, bytes] = {}
        self._odd: set[str] = set()
        self._bytes = 0

    def ids(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Ids of each text's pieces; None for a text with a piece that can't stand alone."""
        if self._bytes > REMEMBERED_BYTES:
            self.forget()
        known, odd = self._known, self._odd
        new = list(set().union(*texts).difference(known, odd))
        for piece, data in zip(new, self._encode(new) if new else ()):
            self._bytes += _ENTRY_BYTES + 4 * len(piece) + len(data or b"")
            if data is None:
                odd.add(piece)
            else:
                known[piece] = data
        look = known.__getitem__
        out: list[np.ndarray | None] = []
        for pieces in texts:
            try:
                out.append(np.frombuffer(b"".join(map(look, pieces)), "<u4"))
            except KeyError:
                out.append(None)
        return out


def cut_up(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Ids as bytes, cut at the places ``starts``, the first of which is 0."""
    data = ids.astype("<u4").tobytes()
    ends = [*(4 * starts[1:]).tolist(), len(data)]
    return [data[a:b] for a, b in zip((4 * starts).tolist(), ends)]


def spread(flat: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Stretches ``flat[bounds[k] : bounds[k + 1]]`` of all ``numbers``, one after the other."""
    starts = bounds[numbers]
    sizes = bounds[numbers + 1] - starts
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
