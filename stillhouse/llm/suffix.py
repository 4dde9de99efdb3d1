"""Repeated byte strings, found by suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.pieces import spread
from stillhouse.llm.textbytes import SLICE_BYTES, mix, prefix_hashes, slices, span_hashes

#: Bytes of a repeated string.
LENGTH = 50
#: Bytes of the gram whose smallest hash names a window; a window has LENGTH - GRAM + 1 of them.
GRAM = 20
#: Bytes of documents in a shard.
SHARD_BYTES = 4 << 20
#: Bytes of distinct strings under one suffix array.
ARRAY_BYTES = 4 << 20
#: Bytes of distinct strings of a name from which its windows are dealt out one by one.
HOT_BYTES = 16 << 20
#: Bytes of distinct strings of a name in a shard that are not told one by one.
LIGHT_BYTES = 1 << 10

_NEVER = np.iinfo(np.int64).max
_FIRST = np.iinfo(np.int64).min


# --- suffix arrays -----------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them; zeros follow the end."""
    padded = np.zeros(data.size + 8, np.uint8)
    padded[: data.size] = data
    out = padded.astype(np.uint64)
    for step in (1, 2, 4):
        out = (out[:-step] << np.uint64(8 * step)) | out[step:]
    return out[: data.size + 1]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` in the order of the suffixes that begin there.

    Larsson-Sadakane refinement: after a sort by eight bytes every suffix has its group's number
    as rank. A round doubles the sorted length by the rank of the suffix that far behind, and
    only groups that still have several members take part in it.
    """
    words = _words(data)[: data.size]
    order = np.argsort(words)
    key = words[order]
    fresh = np.ones(data.size, bool)
    fresh[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(data.size), 0))
    rank = np.zeros(data.size + 1, np.int64)
    rank[order] = head + 1
    many = ~fresh
    many[:-1] |= ~fresh[1:]
    slot = np.flatnonzero(many)
    sorted_to = 8
    while slot.size:
        place = order[slot]
        behind = rank[np.minimum(place + sorted_to, data.size)]
        key = (rank[place] << 32) | behind
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[slot] = place
        fresh = np.ones(slot.size, bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[place] = slot[np.maximum.accumulate(np.where(fresh, np.arange(slot.size), 0))] + 1
        many = ~fresh
        many[:-1] |= ~fresh[1:]
        slot = slot[many]
        sorted_to *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in ``order`` has in common with the one before it.

    Kasai's bound, in text order: where the bytes in front agree too, the value is one less than
    that of the place before. Only the other places are compared, eight bytes at a time, and
    the rest follows as a running maximum.
    """
    n = data.size
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    places = np.arange(n)
    own = np.ones(n, bool)
    own[1:] = (before[1:] < 1) | (before[:-1] < 0) | (data[:-1] != data[before[1:] - 1])
    own &= before >= 0
    words = _words(data)
    at = places[own]
    other = before[own]
    size = np.zeros(at.size, np.int64)
    live = np.arange(at.size)
    while live.size:
        x, y = at[live] + size[live], other[live] + size[live]
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        left = n - np.maximum(x, y)
        zero = np.where(differ == 0, 8, 7 - (np.frexp(np.maximum(differ, np.uint64(1)).astype(np.float64))[1] - 1) // 8)
        size[live] += np.minimum(np.maximum(zero, 0), np.maximum(left, 0))
        live = live[(differ == 0) & (left > 8)]
    bound = np.zeros(n, np.int64)
    bound[own] = at + size
    values = np.maximum.accumulate(bound) - places
    values[before < 0] = 0
    return np.maximum(values, 0)[order]


# --- shards of documents -----------------------------------------------------------------------


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpress(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<i8", len(kinds) + 1)[1:]
    begins = np.cumsum(sizes) - sizes + 8 * (len(kinds) + 1)
    parts = zip(kinds, sizes.tolist(), begins.tolist())
    return [np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at) for kind, size, at in parts]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch, compressed per shard."""
    for batch in batches:
        known = pa.compute.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).cast(pa.int64()).to_numpy()
        shard = batch.column(2).to_numpy()
        more = np.array(batch.column(3).to_pylist(), object)
        out, blobs = [], []
        for first, data, offsets in slices(batch.column(1), 64 << 20):
            own = slice(first, first + offsets.size - 1)
            for s in np.unique(shard[own]).tolist():
                rows = np.flatnonzero(shard[own] == s)
                out.append(s)
                carried = [x.encode() for x in more[own][rows]]
                blobs.append(
                    _press(
                        ids[own][rows], known[own][rows], np.diff(offsets)[rows], spread(data, offsets, rows),
                        np.fromiter(map(len, carried), np.int64, len(carried)), np.frombuffer(b"".join(carried), np.uint8),
                    )
                )
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "docs"])


def _by_content(ids: np.ndarray, known: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Order of documents by id, NULL first, and then by a digest of their bytes."""
    by = np.lexsort((ids, known))
    same = (ids[by][1:] == ids[by][:-1]) & (known[by][1:] == known[by][:-1])
    for group in np.split(by, np.flatnonzero(~same) + 1) if same.any() else ():
        if group.size > 1:
            digests = [hashlib.sha256(data[offsets[k] : offsets[k + 1]]).digest() for k in group.tolist()]
            group[:] = group[sorted(range(group.size), key=digests.__getitem__)]
    return by


class _Shard:
    """Documents of a shard in slices, and the runs of windows with one smallest gram hash.

    They stand in the order of their ids, those of one id in the order of a digest, however they
    were cut into blobs. What is numbered in a shard has the same number whenever it is read, also
    if an executor was lost and rows came in another order.
    """

    def __init__(self, blobs: list[bytes]):
        parts = [_unpress(b, "<i8", "?", "<i8", "u1", "<i8", "u1") for b in blobs]
        ids, known, sizes, data, lengths, carried = (np.concatenate(x) for x in zip(*parts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        by = _by_content(ids, known, data, offsets)
        self.ids, self.known, sizes = ids[by], known[by], sizes[by]
        self.data = spread(data, offsets, by)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self._more = lengths[by], spread(carried, np.concatenate([[0], np.cumsum(lengths)]), by)
        #: A NULL id comes before all others.
        self.order_ids = np.where(self.known, self.ids, _FIRST)

    def more(self) -> list[str]:
        """What is carried along with each document."""
        ends = np.cumsum(self._more[0]).tolist()
        raw = self._more[1].tobytes()
        return [raw[e - n : e].decode() for n, e in zip(self._more[0].tolist(), ends)]

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        first, n = 0, self.ids.size
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + SLICE_BYTES, "right")) - 1)
            own = self.offsets[first : last + 1]
            yield first, self.data[own[0] : own[-1]], own - own[0]
            first = last

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice: first document, bytes, offsets; per run: name, document, start, windows, hash of its bytes.

        A window's name is the smallest hash of its grams, so equal windows have equal names,
        and neighbouring windows mostly share theirs.
        """
        for first, data, offsets in self.slices():
            n = data.size - LENGTH + 1
            if n < 1:
                empty = np.zeros(0, np.int64)
                yield first, data, offsets, empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
                continue
            sums, down = prefix_hashes(data)
            name = (sums[GRAM:] - sums[:-GRAM]) * down[: data.size - GRAM + 1]
            name ^= name >> np.uint64(32)
            name *= np.uint64(0xD6E8FEB86659FD93)
            name ^= name >> np.uint64(32)
            span = 1
            while 2 * span <= LENGTH - GRAM + 1:
                name = np.minimum(name[:-span], name[span:])
                span *= 2
            rest = LENGTH - GRAM + 1 - span
            name = np.minimum(name[:-rest], name[rest:]) if rest else name
            inside = np.ones(n + 1, bool)
            for b in offsets[1:-1].tolist():
                inside[max(b - LENGTH + 1, 0) : min(b, n)] = False
            inside[n] = False
            begins = inside[:-1].copy()
            begins[1:] &= ~(inside[:-2] & (name[1:] == name[:-1]))
            start = np.flatnonzero(begins)
            # A run ends where the next one or a place without a window begins.
            stops = np.flatnonzero(begins | ~inside[:-1])
            stops = np.append(stops, n)
            end = stops[np.searchsorted(stops, start, "right")]
            doc = np.searchsorted(offsets, start, "right") - 1
            content = span_hashes(sums, down, start, end + LENGTH - 1)
            yield first, data, offsets, name[start], doc + first, start, end - start, content


def _bucket(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a name, and 31 further bits that tell names of a bucket apart well enough."""
    return (name & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), (name >> np.uint64(33)).astype(np.uint32)


def _names(key: tuple, rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Names in a shard, once each, per bucket; a bit tells if several documents have it.

    Behind them stand the names with more than ``LIGHT_BYTES`` of distinct strings, and these bytes.
    """
    shard = _Shard(rows["docs"].tolist())
    found = [(name, shard.order_ids[doc], count + LENGTH - 1, content) for _, _, _, name, doc, _, count, content in shard.runs()]
    name, doc, size, content = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((doc, name))
    name, doc, size, content = name[by], doc[by], size[by], content[by]
    fresh = np.ones(name.size, bool)
    fresh[1:] = name[1:] != name[:-1]
    several = np.zeros(name.size, bool)
    several[1:] = ~fresh[1:] & (doc[1:] != doc[:-1])
    heads = np.flatnonzero(fresh)
    several = np.logical_or.reduceat(several, heads) if heads.size else several[:0]
    bucket, rest = _bucket(name[heads], buckets)
    entry = (rest << np.uint32(1)) | several.astype(np.uint32)
    total = np.add.reduceat(size, heads) if heads.size else size[:0]
    # Equal strings count once; only names that have many bytes at all are looked at closer.
    owner = np.cumsum(fresh) - 1
    close = np.flatnonzero(total[owner] > LIGHT_BYTES) if heads.size else heads
    by = close[np.lexsort((content[close], owner[close]))]
    new = np.ones(by.size, bool)
    new[1:] = (owner[by][1:] != owner[by][:-1]) | (content[by][1:] != content[by][:-1])
    total = np.bincount(owner[by[new]], size[by[new]], heads.size).astype(np.int64)

    def packed(at: np.ndarray) -> bytes:
        heavy = at[total[at] > LIGHT_BYTES]
        return _press(entry[at], rest[heavy], total[heavy])

    return _by_bucket(key[0], bucket, packed)


def _by_bucket(shard: int, bucket: np.ndarray, packed: Callable[[np.ndarray], bytes]) -> pd.DataFrame:
    by = np.argsort(bucket, kind="stable")
    parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if by.size else []
    return pd.DataFrame(
        {"bucket": [int(bucket[p[0]]) for p in parts], "shard": shard, "entries": [packed(p) for p in parts]},
    ).astype({"bucket": "int64", "shard": "int64"})


def _repeated(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Names of a bucket that several documents have, sent back to the shards that have them.

    A bit tells if a name is hot: its strings may come to more than ``HOT_BYTES`` in all shards.
    """
    parts, heavy, heavy_bytes = zip(*(_unpress(b, "<u4", "<u4", "<i8") for b in rows["entries"]))
    entry, heavy, heavy_bytes = np.concatenate(parts), np.concatenate(heavy), np.concatenate(heavy_bytes)
    names, number, shards_of = np.unique(entry >> np.uint32(1), return_inverse=True, return_counts=True)
    most = LIGHT_BYTES * shards_of + np.bincount(np.searchsorted(names, heavy), heavy_bytes, names.size)
    hot = (most > HOT_BYTES)[number]
    of = np.repeat(np.arange(len(parts)), [p.size for p in parts])
    by = np.argsort(entry >> np.uint32(1), kind="stable")
    rest, of, flag, hot = (entry >> np.uint32(1))[by], of[by], (entry & np.uint32(1))[by], hot[by]
    again = flag > 0
    same = rest[1:] == rest[:-1]
    again[1:] |= same
    again[:-1] |= same
    rest, of = (rest[again] << np.uint32(1)) | hot[again].astype(np.uint32), of[again]
    by = np.argsort(of, kind="stable")
    shards = rows["shard"].to_numpy()
    parts = np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if by.size else []
    return pd.DataFrame(
        {"shard": [int(shards[of[p[0]]]) for p in parts], "bucket": key[0], "entries": [_press(rest[p]) for p in parts]}
    ).astype({"bucket": "int64", "shard": "int64"})


class _Strings:
    """Distinct strings under repeated names in a shard, and where they stand.

    Under a hot name each window is a string of its own and goes to the bucket of its own hash:
    equal windows have equal names, so they are cut in all shards and still meet.
    """

    def __init__(self, shard: _Shard, repeated: pd.DataFrame, buckets: int):
        keys = [
            (np.uint64(b) << np.uint64(32)) | _unpress(e, "<u4")[0].astype(np.uint64)
            for b, e in zip(repeated["bucket"].tolist(), repeated["entries"])
        ]
        wanted = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        wanted, is_hot = wanted >> np.uint64(1), (wanted & np.uint64(1)) > 0
        number: dict[bytes, int] = {}
        bucket_of: list[np.ndarray] = []
        #: Per slice: first document, bytes, offsets, and of each occurrence string, document, start.
        self.found = []
        least, most, windows = [], [], []
        for first, data, offsets, name, doc, start, count, _ in shard.runs():
            bucket, rest = _bucket(name, buckets)
            key = (bucket << np.uint64(31)) | rest.astype(np.uint64)
            at = np.searchsorted(wanted, key)
            hit = np.flatnonzero(wanted[np.minimum(at, wanted.size - 1)] == key) if wanted.size else np.zeros(0, int)
            raw = data.tobytes()
            doc, start, count, bucket = doc[hit], start[hit], count[hit], bucket[hit]
            hot = is_hot[at[hit]]
            if hot.any():
                apart = count[hot]
                step = np.arange(int(apart.sum())) - np.repeat(np.cumsum(apart) - apart, apart)
                places = np.repeat(start[hot], apart) + step
                own = mix(span_hashes(*prefix_hashes(data), places, places + LENGTH)) % np.uint64(buckets)
                doc = np.concatenate([doc[~hot], np.repeat(doc[hot], apart)])
                start, count = np.concatenate([start[~hot], places]), np.concatenate([count[~hot], np.ones(places.size, count.dtype)])
                bucket = np.concatenate([bucket[~hot], own])
            texts = [raw[a : a + n + LENGTH - 1] for a, n in zip(start.tolist(), count.tolist())]
            known = len(number)
            numbers = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
            fresh, at = np.unique(numbers, return_index=True)
            new = at[fresh >= known]
            bucket_of.append(bucket[new])
            windows.append(count[new])
            self.found.append((first, data, offsets, numbers, doc, start))
        self.texts = list(number)
        self.bucket = np.concatenate(bucket_of) if bucket_of else np.zeros(0, np.uint64)
        self.windows = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        self.least = np.full(len(number), _NEVER)
        self.most = np.full(len(number), _FIRST)
        for _, _, _, numbers, doc, _ in self.found:
            np.minimum.at(self.least, numbers, shard.order_ids[doc])
            np.maximum.at(self.most, numbers, shard.order_ids[doc])


def _strings(key: tuple, docs: pd.DataFrame, repeated: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Strings of a shard per bucket, each with the smallest and largest document that has it."""
    if docs.empty:
        return _by_bucket(0, np.zeros(0, np.int64), bytes)
    found = _Strings(_Shard(docs["docs"].tolist()), repeated, buckets)
    texts = found.texts

    def packed(at: np.ndarray) -> bytes:
        own = [texts[k] for k in at.tolist()]
        size = np.array([len(t) for t in own], "<i8")
        joined = np.frombuffer(b"".join(own), np.uint8)
        return _press(at.astype("<i8"), found.least[at], found.most[at], size, joined)

    return _by_bucket(key[0], found.bucket, packed)


def window_minima(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of each window of each text, over all texts: values and bounds.

    The texts are cut into shards of ``ARRAY_BYTES``. Each gets a suffix array; suffixes that
    have ``LENGTH`` bytes in common with their neighbour are the same window. Shards are then
    merged in pairs: the windows of one are looked up in the sorted windows of the other.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = size - LENGTH + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    ends = np.cumsum(size)
    shard_of = (ends - size) // ARRAY_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(texts)]
    values = np.empty(int(bounds[-1]), np.int64)
    arrays = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        start = np.cumsum(size[a:b]) - size[a:b]
        owner = np.full(data.size, _NEVER)
        before = np.cumsum(count[a:b]) - count[a:b]
        places = np.repeat(start - before, count[a:b]) + np.arange(int(count[a:b].sum()))
        owner[places] = np.repeat(docs[a:b], count[a:b])
        order = suffix_array(data)
        fresh = common_prefixes(data, order) < LENGTH
        fresh[0] = True
        heads = np.flatnonzero(fresh)
        least = np.minimum.reduceat(owner[order], heads)
        group = np.empty(data.size, np.int64)
        group[order] = np.cumsum(fresh) - 1
        real = least < _NEVER
        arrays.append((data, order[heads], least, real, group[places]))
    if len(arrays) > 1:
        tables = [_windows(data, heads[real]) for data, heads, _, real, _ in arrays]
        for x in range(len(arrays)):
            for y in range(x + 1, len(arrays)):
                at = np.searchsorted(tables[x], tables[y])
                hit = np.flatnonzero(tables[x][np.minimum(at, tables[x].size - 1)] == tables[y])
                one, two = (np.flatnonzero(arrays[k][3]) for k in (x, y))
                one, two = one[at[hit]], two[hit]
                both = np.minimum(arrays[x][2][one], arrays[y][2][two])
                arrays[x][2][one] = both
                arrays[y][2][two] = both
    for (a, b), (_, _, least, _, group) in zip(zip(cuts[:-1], cuts[1:]), arrays):
        values[bounds[a] : bounds[b]] = least[group]
    return values, bounds


def _windows(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The windows at ``places`` as byte strings of full length."""
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[places]
    return np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()


def _minima(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Smallest documents of all windows in a bucket, for the shards that have larger ones."""
    number: dict[bytes, int] = {}
    parts = []
    for shard, blob in zip(rows["shard"].tolist(), rows["entries"]):
        local, least, most, size, joined = _unpress(blob, "<i8", "<i8", "<i8", "<i8", "u1")
        raw, ends = joined.tobytes(), np.cumsum(size).tolist()
        own = [raw[e - s : e] for s, e in zip(size.tolist(), ends)]
        at = np.fromiter((number.setdefault(t, len(number)) for t in own), np.int64, len(own))
        parts.append((shard, local, least, most, at))
    docs = np.full(len(number), _NEVER)
    for _, _, least, _, at in parts:
        np.minimum.at(docs, at, least)
    values, bounds = window_minima(list(number), docs)
    lowest = np.minimum.reduceat(values, bounds[:-1])
    shards, blobs = [], []
    for shard, local, _, most, at in parts:
        told = np.flatnonzero(lowest[at] < most)
        if told.size:
            shards.append(shard)
            blobs.append(_press(local[told], np.diff(bounds)[at[told]], spread(values, bounds, at[told])))
    return pd.DataFrame({"shard": shards, "bucket": -1, "entries": blobs}).astype({"shard": "int64", "bucket": "int64"})


def _removed(key: tuple, docs: pd.DataFrame, told: pd.DataFrame, buckets: int, full: bool) -> pd.DataFrame:
    """What is left of the documents of a shard."""
    columns: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "more")}
    if not docs.empty:
        shard = _Shard(docs["docs"].tolist())
        more = shard.more()
        found = _Strings(shard, told[told["bucket"] >= 0], buckets)
        results = [_unpress(b, "<i8", "<i8", "<i8") for b in told.loc[told["bucket"] < 0, "entries"]]
        local, count, values = (np.concatenate(x) if results else np.zeros(0, np.int64) for x in (zip(*results) if results else ((),) * 3))
        row = np.full(len(found.texts) + 1, -1)
        row[local] = np.arange(local.size)
        bounds = np.concatenate([[0], np.cumsum(count)])
        for first, data, offsets, numbers, doc, start in found.found:
            gone = np.zeros(data.size + LENGTH, np.int32)
            use = np.flatnonzero(row[numbers] >= 0)
            at = row[numbers[use]]
            least = spread(values, bounds, at)
            n = count[at]
            before = np.cumsum(n) - n
            places = np.repeat(start[use] - before, n) + np.arange(int(n.sum()))
            gone[LENGTH:][places[least < np.repeat(shard.order_ids[doc[use]], n)]] = 1
            reach = np.cumsum(gone)
            cover = reach[LENGTH:] > reach[:-LENGTH]
            edge = cover.copy()
            edge[1:] &= ~cover[:-1]
            begins = offsets[:-1][offsets[:-1] < data.size]
            edge[begins] = cover[begins]
            total, edges = np.concatenate([[0], np.cumsum(cover)]), np.concatenate([[0], np.cumsum(edge)])
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                left = data[a:b][~cover[a:b]].tobytes() if total[b] > total[a] else data[a:b].tobytes()
                row_id = int(shard.ids[first + k]) if shard.known[first + k] else None
                kept = left.decode("utf-8", "ignore") if full else None
                facts = (row_id, b - a, int(total[b] - total[a]), int(edges[b] - edges[a]), hashlib.sha256(left).hexdigest(), kept, more[first + k])
                for c, value in zip(columns, facts):
                    columns[c].append(value)
    out = pd.DataFrame(columns)
    return out.astype({"doc_id": "Int64"})


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True, more: Sequence[str] = ()
) -> DataFrame:
    """Texts without strings that an earlier document has: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    A byte goes if a string of 50 bytes around it, inside its document, also starts in a document
    with a smaller id. Texts are UTF-8; ``kept`` (NULL unless ``full``) is what is left, without
    characters that a cut splits; the digest is that of the bytes. The columns in ``more`` are
    returned with each row.

    1. Documents are dealt into shards of about ``SHARD_BYTES`` and stay compressed until used.
    2. Every window of 50 bytes is named by the smallest hash of its 20-byte grams, so equal
       windows have equal names. A shard tells each name once to the name's bucket; names of
       several documents come back.
    3. Stretches under such names, once per shard, go to their bucket; where those of a name may
       exceed ``HOT_BYTES`` in all, each window goes to the bucket of its own hash instead. There a suffix array per
       ``ARRAY_BYTES``, common prefixes and lookups between arrays give each window's smallest document.
    4. The shards get these minima for their stretches and cut their documents.

    Names are exchanged once per shard, and so are equal stretches, whatever the number of their
    copies. A task holds one shard or bucket. Equal strings in rows with the same id don't count,
    and a NULL id comes before all others; all rows are returned. NULL text is empty. Other
    columns are ignored; an empty table gives no rows.
    """
    carried = F.to_json(F.struct(*more), {"ignoreNullFields": "false"}) if more else F.lit("")
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("binary").alias("data"),
        carried.alias("more"),
    )
    size = own.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = buckets = 1 + size // SHARD_BYTES
    numbered = own.select("doc_id", "data", F.pmod(F.xxhash64("doc_id", "data"), F.lit(shards)).alias("shard"), "more")
    dealt = numbered.mapInArrow(_dealt, "shard long, docs binary")
    entries = "bucket long, shard long, entries binary"
    back = "shard long, bucket long, entries binary"
    names = dealt.groupBy("shard").applyInPandas(lambda key, rows: _names(key, rows, buckets), entries)
    again = names.groupBy("bucket").applyInPandas(_repeated, back)
    by_shard = dealt.groupBy("shard")
    strings = by_shard.cogroup(again.groupBy("shard")).applyInPandas(
        lambda key, mine, back: _strings(key, mine, back, buckets), entries
    )
    minima = strings.groupBy("bucket").applyInPandas(_minima, back)
    told = again.unionByName(minima)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, more string"
    done = by_shard.cogroup(told.groupBy("shard")).applyInPandas(
        lambda key, mine, back: _removed(key, mine, back, buckets, full), schema
    )
    if not more:
        return done.drop("more")
    kinds = docs.select(*more).schema
    parsed = done.withColumn("more", F.from_json("more", kinds))
    return parsed.select(*done.columns[:-1], *[F.col(f"more.{c}").alias(c) for c in more])
