"""Toxicity by a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.textbytes import mix, prefix_hashes, slices, span_hashes

#: Words of a window, and words from one window to the next.
WINDOW, STEP = 32, 16
#: Windows that go through the network together; their states stay in the cache.
BATCH = 512
#: Units of each direction.
HIDDEN = 8
#: Labelled rows that the model is fitted to, at most, and their bytes: toxic ones and others.
FIT_ROWS = {1: 2000, 0: 4000}
FIT_BYTES = 24 << 20
EPOCHS = 6
#: Buckets of hashed words and hashed runs of characters.
BUCKETS = 1 << 18
#: Score from which a text counts as toxic.
CUTOFF = 0.3

_GRAMS = (3, 4, 5)
_INPUTS = 6
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- words and their inputs --------------------------------------------------------------------


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of each run of letters and digits."""
    low = _LOWER[data]
    latin = np.flatnonzero(low[:-1] == 0xC3) + 1
    latin = latin[(low[latin] >= 0x80) & (low[latin] <= 0x9E)]
    low[latin] += 32
    inside = _INSIDE[low]
    if not low.size:
        return (low, *(np.zeros(0, np.int64),) * 3)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1][offsets[:-1] < low.size], offsets[1:][offsets[1:] > 0] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    start = np.flatnonzero(first)
    return low, start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def grams_of(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: for every word the number of its distinct one, the bucket of each distinct
    word, and the buckets of its runs of characters, those at its beginning apart, with bounds."""
    sums, down = prefix_hashes(low)
    hashes = span_hashes(sums, down, start, end)
    unique, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    owners, buckets = [], []
    for n in _GRAMS:
        count = np.maximum(end - start - n + 1, 0)
        owner = np.repeat(np.arange(start.size), count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        gram = span_hashes(sums, down, place, place + n)
        owners.append(owner)
        buckets.append(gram % np.uint64(BUCKETS))
        long = np.flatnonzero(count)
        head = mix(span_hashes(sums, down, start[long], start[long] + n) + np.uint64(n))
        owners.append(long)
        buckets.append(head % np.uint64(BUCKETS))
    owners.append(np.arange(start.size))
    buckets.append(mix(unique + np.uint64(1)) % np.uint64(BUCKETS))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    by = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by], np.arange(start.size + 1))
    return number, (unique % np.uint64(BUCKETS)).astype(np.int64), bucket[by], bounds


def inputs_of(tables: dict[str, np.ndarray], word: np.ndarray, bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Inputs of distinct words, from the weights of the word and of its runs of characters."""
    if not word.size:
        return np.zeros((0, _INPUTS), np.float32)
    weight = tables["chars"][bucket]
    size = np.diff(bounds)
    most = np.maximum.reduceat(weight, bounds[:-1])
    mean = np.add.reduceat(weight, bounds[:-1]) / size
    least = np.minimum.reduceat(weight, bounds[:-1])
    own = tables["words"][word]
    return np.stack([most, mean, least, own, np.minimum(size, 40) / 20 - 1, np.ones_like(most)], 1).astype(np.float32)


class Counts:
    """Texts that have each bucket, others and toxic ones apart, and texts in all."""

    def __init__(self) -> None:
        self.texts, self.total = np.zeros((2, BUCKETS), np.int32), np.zeros(2)

    def add(self, buckets: np.ndarray, toxic: int) -> None:
        self.texts[toxic, np.unique(buckets)] += 1
        self.total[toxic] += 1


def log_odds(counted: Counts, without: int | None = None) -> np.ndarray:
    """Weight of each bucket: log ratio of the shares of toxic and other texts that have it.

    ``without`` leaves one text of that kind out: the weights that a text of the fitted sample
    would have if it weren't in it. Buckets of few texts say little.
    """
    counts, total = counted.texts.astype(np.float64), counted.total.copy()
    if without is not None:
        counts[without] = np.maximum(counts[without] - 1, 0)
        total[without] -= 1
    share = (counts + 0.5) / (total[:, None] + 1)
    odds = (np.log(share[1]) - np.log(share[0])) * (1 - np.exp(-counts.sum(0) / 3))
    return odds.astype(np.float32)


def windows_of(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and row of all windows; a row's last window ends with its last word."""
    counts = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STEP), 0) + 1, 0)
    row = np.repeat(np.arange(n_rows), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = begin[row] + k * STEP
    return first, np.minimum(WINDOW, begin[row] + counts[row] - first), row


# --- the network -------------------------------------------------------------------------------


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    h = HIDDEN
    out = {}
    for side in "fb":
        out |= {f"w{side}": draw(_INPUTS, 3 * h), f"u{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
    out |= {"a": draw(2 * h, h), "d": np.zeros(h, np.float32), "v": draw(h), "o": draw(2 * h), "e": np.zeros(1, np.float32)}
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _run(p: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction, step by step; ``x`` is the projected input, steps first."""
    h = HIDDEN
    steps, n, _ = x.shape
    states = np.zeros((steps, n, h), np.float32)
    state = np.zeros((n, h), np.float32)
    u = p[f"u{side}"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        inner = state @ u
        gates = _sigmoid(x[t, :, : 2 * h] + inner[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * inner[:, 2 * h :])
        if keep is not None:
            keep.append((t, state, z, r, new, inner[:, 2 * h :]))
        state = state + mask[t][:, None] * (1 - z) * (new - state)
        states[t] = state
    return states


def forward(p: dict[str, np.ndarray], x: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; ``x`` has the projected inputs of either direction."""
    kept: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([_run(p, s, x[s], mask, kept[s] if keep is not None else None) for s in "fb"], 2)
    hidden = np.tanh(both @ p["a"] + p["d"])
    raw = np.where(mask > 0, hidden @ p["v"], np.float32(-1e9))
    raw = np.exp(raw - raw.max(0))
    share = raw / raw.sum(0)
    pooled = (share[:, :, None] * both).sum(0)
    if keep is not None:
        keep |= {"kept": kept, "both": both, "hidden": hidden, "share": share, "pooled": pooled}
    return pooled @ p["o"] + p["e"]


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients and mean cross entropy of a batch; ``inputs`` is steps x windows x inputs."""
    h = HIDDEN
    keep: dict = {}
    x = {s: inputs @ p[f"w{s}"] + p[f"c{s}"] for s in "fb"}
    logit = forward(p, x, mask, keep)
    n = label.size
    loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
    slope = ((_sigmoid(logit) - label) / n).astype(np.float32)
    both, hidden, share, pooled = (keep[k] for k in ("both", "hidden", "share", "pooled"))
    out = {"o": pooled.T @ slope, "e": slope.sum(keepdims=True)}
    to_pooled = slope[:, None] * p["o"]
    to_both = share[:, :, None] * to_pooled
    to_share = (both * to_pooled).sum(2)
    to_raw = share * (to_share - (share * to_share).sum(0))
    out["v"] = np.einsum("tn,tnh->h", to_raw, hidden)
    to_hidden = to_raw[:, :, None] * p["v"] * (1 - hidden**2)
    out["a"] = np.einsum("tni,tnh->ih", both, to_hidden)
    out["d"] = to_hidden.sum((0, 1))
    to_both = to_both + to_hidden @ p["a"].T
    for k, s in enumerate("fb"):
        u = p[f"u{s}"]
        to_x = np.zeros_like(x[s])
        du = np.zeros_like(u)
        carry = np.zeros((n, h), np.float32)
        for t, before, z, r, new, inner in reversed(keep["kept"][s]):
            carry = carry + to_both[t][:, k * h : (k + 1) * h]
            m = mask[t][:, None]
            to_new = carry * m * (1 - z) * (1 - new**2)
            to_z = carry * m * (before - new) * z * (1 - z)
            to_r = to_new * inner * r * (1 - r)
            to_x[t] = np.concatenate([to_z, to_r, to_new], 1)
            to_inner = np.concatenate([to_z, to_r, to_new * r], 1)
            du += before.T @ to_inner
            carry = carry * (1 - m * (1 - z)) + to_inner @ u.T
        out[f"u{s}"] = du
        out[f"w{s}"] = np.einsum("tni,tnh->ih", inputs, to_x)
        out[f"c{s}"] = to_x.sum((0, 1))
    return out, loss


def _laid_out(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``values`` for every step and window, and the mask of steps that have a word."""
    steps = int(size.max(initial=1))
    at = np.minimum(first + np.arange(steps)[:, None], max(len(values) - 1, 0))
    return values[at], (np.arange(steps)[:, None] < size).astype(np.float32)


def fit(texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    """Weights of the network and of its inputs, from whole labelled texts.

    Weights of words and runs of characters are log ratios over the texts. Of each text the
    window with the largest weights, and of a clean one another window too, trains the network
    with Adam. Without both kinds of texts the model has no weights and scores everything 0.
    """
    if not 0 < sum(labels) < len(labels):
        return {}
    column = pa.array(texts, pa.string())
    counts = {"words": Counts(), "chars": Counts()}
    for first, data, offsets in slices(column, 1 << 20):
        low, start, end, row = words_of(data, offsets)
        number, word, bucket, bounds = grams_of(low, start, end)
        for k in range(offsets.size - 1):
            a, b = np.searchsorted(row, [k, k + 1])
            own = np.unique(number[a:b])
            counts["words"].add(word[own], labels[first + k])
            grams = np.concatenate([bucket[bounds[w] : bounds[w + 1]] for w in own.tolist()] or [bucket[:0]])
            counts["chars"].add(grams, labels[first + k])
    model = {k: log_odds(c) for k, c in counts.items()}
    # A text is trained on as a new one would look: without its own share in the weights.
    without = [{k: log_odds(c, without=kind) for k, c in counts.items()} for kind in (0, 1)]
    random = np.random.default_rng(5)
    parts, marks = [], []
    # Read again rather than kept: the inputs of all words are many times as large as the texts.
    for first, data, offsets in slices(column, 1 << 20):
        low, start, end, row = words_of(data, offsets)
        number, word, bucket, bounds = grams_of(low, start, end)
        n = offsets.size - 1
        both = [inputs_of(tables, word, bucket, bounds) for tables in without]
        begin, size, of = windows_of(row, n)
        totals = [np.concatenate([[0], np.cumsum(np.maximum(x[:, 0] + x[:, 3], 0)[number])]) for x in both]
        for k in range(n):
            inputs, total = both[labels[first + k]], totals[labels[first + k]]
            a, b = np.searchsorted(of, [k, k + 1])
            if a == b:
                continue
            weight = total[begin[a:b] + size[a:b]] - total[begin[a:b]]
            chosen = [a + int(np.argmax(weight))]
            if not labels[first + k]:
                chosen.append(int(random.integers(a, b)))
            for w in chosen:
                own = np.zeros((WINDOW, _INPUTS + 1), np.float32)
                own[: size[w], :_INPUTS] = inputs[number[begin[w] : begin[w] + size[w]]]
                own[: size[w], _INPUTS] = 1
                parts.append(own)
                marks.append(labels[first + k])
    if not parts:
        return {}
    stacked, label = np.stack(parts, 1), np.array(marks, np.float32)
    p = start_weights()
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, batch = 0, 128
    epochs = max(EPOCHS, -(-240 * batch // label.size))
    for _ in range(epochs):
        order = random.permutation(label.size)
        for a in range(0, label.size, batch):
            own = order[a : a + batch]
            slope, _ = gradients(p, stacked[:, own, :_INPUTS], stacked[:, own, _INPUTS], label[own])
            step += 1
            for k, g in slope.items():
                g = np.clip(g, -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.98 * m2[k] + 0.02 * g * g
                p[k] = (p[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)
    return model | p


def score_texts(model: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """Largest score of any window of each text; 0 for texts without words."""
    out = np.zeros(len(column))
    if not model:
        return out
    for first, data, offsets in slices(column):
        low, start, end, row = words_of(data, offsets)
        if not start.size:
            continue
        number, word, bucket, bounds = grams_of(low, start, end)
        inputs = inputs_of(model, word, bucket, bounds)
        ready = {s: inputs @ model[f"w{s}"] + model[f"c{s}"] for s in "fb"}
        begin, size, of = windows_of(row, offsets.size - 1)
        by = np.argsort(size, kind="stable")
        for a in range(0, by.size, BATCH):
            own = by[a : a + BATCH]
            at, mask = _laid_out(number, begin[own], size[own])
            logit = forward(model, {s: ready[s][at] for s in "fb"}, mask)
            np.maximum.at(out, first + of[own], _sigmoid(logit).astype(np.float64))
    return out


# --- jobs --------------------------------------------------------------------------------------


def _scored(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], cutoff: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = score_texts(model, batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(score), pa.array((score >= cutoff).astype(np.int32))],
            names=["doc_id", "score", "predicted"],
        )


def _room(kind: int) -> int:
    """Bytes of the sample for texts of a kind."""
    return FIT_BYTES * FIT_ROWS[kind] // sum(FIT_ROWS.values())


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> dict[str, np.ndarray]:
    """Model fitted to at most ``FIT_ROWS`` labelled rows of each kind and ``FIT_BYTES`` of text.

    Rows are taken in the order of a hash of their id, so the sample is the same each time and
    depends on nothing else. Each kind has its share of the bytes; a text that doesn't fit is
    passed over, and rows with shorter ones still come in. An id gives one row. Conflicting labels
    of one id count as toxic. Only ids and sizes go through the choice; the texts of those chosen
    are then read. It is an error if the table has labelled rows of both kinds but none of one
    kind fits.
    """
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("fit_id"))
        .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
        .withColumn("h", F.xxhash64("fit_id"))
    )
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("fit_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = own.select("fit_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("n"))
    fitting = []
    for kind, most in FIT_ROWS.items():
        # One row of an id, and none that is too long by itself: neither takes the place of another.
        rows = sized.where(F.col("n") <= _room(kind)).groupBy("fit_id").agg(F.min(F.struct("text_hash", "n")).alias("row"))
        found = rows.join(marks.where(F.col("toxic") == kind), "fit_id").select("fit_id", "h", "toxic", "row.*")
        room = _room(kind)
        for r in found.orderBy("h", "fit_id").limit(most).collect():
            if r.n <= room:
                room -= r.n
                fitting.append((r.fit_id, r.text_hash, r.toxic))
    missing = set(FIT_ROWS) - {toxic for *_, toxic in fitting}
    if missing:
        labelled = {r.toxic for r in own.select("fit_id").join(marks, "fit_id").select("toxic").distinct().collect()}
        if labelled == set(FIT_ROWS):
            raise ValueError(f"labelled texts of both kinds, but none of toxic = {sorted(missing)} fits {FIT_BYTES} bytes")
        return {}
    kind = docs.schema[id_col].dataType.simpleString()
    # Bounded by FIT_ROWS, so it may be sent to every task.
    ids = F.broadcast(docs.sparkSession.createDataFrame(fitting, f"fit_id {kind}, text_hash bigint, toxic int"))
    read = own.withColumn("text_hash", F.xxhash64("text")).join(ids, ["fit_id", "text_hash"])
    rows = read.groupBy("fit_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.fit_id, r.text))
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(
    docs: DataFrame,
    labelled: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    cutoff: float = CUTOFF,
) -> DataFrame:
    """Score of every row of ``docs``: ``doc_id, score, predicted``.

    The model is fitted to ``labelled`` rows that have ``labels`` (``fit_on``) and sent with the
    tasks; its size is fixed. A score is the largest of all windows of 32 words, 16 apart, that
    cover the whole text; nothing but the text enters it. Texts without words, NULL included,
    score 0, as everything does where ``labelled`` has one kind of label only. Rows stay as they are, with
    NULL and repeated ids. Other columns are ignored; an empty table gives no rows. No shuffle.
    """
    model = fit_on(labelled, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(lambda batches: _scored(batches, shared.value, cutoff), f"doc_id {kind}, score double, predicted int")
