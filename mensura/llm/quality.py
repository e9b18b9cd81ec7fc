"""Quality: a generalised additive model with pairwise interactions.

Each text has a row of numbers (lengths, shares of character classes, repetition). Each number is
cut into bins, and a lookup table over the bins is learnt for each of them by cyclic boosting: in
turn, a shallow tree over one feature's bins is fitted to the gradients and a part of it is added
to that feature's table. Then the pairs of features whose joint bins explain most of what is left
get tables over their coarser joint bins, learnt alike. A score is the sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import LETTER, give_back, labelled_texts, mix, raw, run_hashes, runs, slices, word_hashes

#: Labelled rows to learn from (the documented bound).
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

FEATURES = (
    "log_words", "word_length", "upper", "digit", "punct", "symbol", "pipe", "exclaim", "newline", "wide", "letters",
    "distinct_words", "same_as_before", "distinct_grams", "distinct_lines", "upper_words", "symbol_words", "stop_share",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:'\"()?-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "$#%&*@^~<>{}[]=+_\\/"]] = True


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each owner has."""
    if not len(values):
        return np.zeros(n)
    key = np.sort(mix(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | owner.astype(np.uint64) << np.uint64(40))
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n)[:n].astype(float)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The feature rows of a batch of texts; an empty text has all zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    size = np.maximum(1, np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    many = np.maximum(1, count)
    owner = np.repeat(np.arange(n), count)
    starts, ends = runs(~np.isin(data, (9, 10, 11, 12, 13, 32)), offsets)
    up, sym = _UPPER[data], _SYMBOL[data]
    ups, syms = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (up, sym))
    by_word = lambda flags: np.bincount(owner, flags, n) / many
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.where(count > 0, np.bincount(owner, ends - starts, n) / many, 0)
    for k, mask in ((2, up), (3, _DIGIT[data]), (4, _PUNCT[data]), (5, sym), (6, data == 124), (7, data == 33), (8, data == 10), (9, data >= 0x80), (10, LETTER[data])):
        out[:, k] = share(mask)
    out[:, 11] = _distinct(words, owner, n) / many
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out[:, 12] = by_word(same)
    if len(words) >= 3:
        grams = mix(words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(7))
        whole = owner[:-2] == owner[2:]
        out[:, 13] = np.where(count >= 3, _distinct(grams[whole], owner[:-2][whole], n) / np.maximum(1, count - 2), 1)
    line_starts, line_ends = runs(data != 10, offsets)
    lines = run_hashes(data, line_starts, line_ends)
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    n_lines = np.bincount(line_owner, minlength=n)
    out[:, 14] = np.where(n_lines > 0, _distinct(lines, line_owner, n) / np.maximum(1, n_lines), 1)
    out[:, 15] = by_word((ups[ends] - ups[starts]) * 2 > ends - starts)
    out[:, 16] = by_word(syms[ends] > syms[starts])
    out[:, 17] = by_word(ends - starts <= 3)
    out[offsets[1:] == offsets[:-1]] = 0
    return out


@dataclass
class Additive:
    """Cut points and tables; ``pairs`` are (feature, feature, table over coarse joint bins)."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sums of looked-up values, through the logistic function."""
        z = np.full(len(x), self.bias)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, k], "right")]
        if self.pairs:
            low = [np.searchsorted(cuts, x[:, k], "right") for k, cuts in enumerate(self.coarse)]
            for a, b, table in self.pairs:
                z += table[low[a], low[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points at the quantiles, each halfway between two values that occur."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 3.0, ridge: float = 1.0) -> np.ndarray:
    """A shallow tree over the bins of one feature: the step of each bin."""
    out = np.full(len(g), -g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
    gain[(hl < least * 0.01) | (hr < least * 0.01)] = -1
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, least, ridge), _tree(g[k:], h[k:], depth - 1, least, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best cross of one cut on either feature (four leaves), and its gain."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, cut = -1.0, None
    quads = lambda S, i, j: (S[i, j], S[i, -1] - S[i, j], S[-1, j] - S[i, j], S[-1, -1] - S[i, -1] - S[-1, j] + S[i, j])
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gain = sum(a * a / (b + ridge) for a, b in zip(quads(G, i, j), quads(H, i, j)))
            if gain > best:
                best, cut = gain, (i, j)
    out = np.zeros_like(g)
    if cut:
        i, j = cut
        a, b, c, d = (-x / (y + ridge) for x, y in zip(quads(G, i, j), quads(H, i, j)))
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = a, b, c, d
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits the model on feature rows and 0/1 labels."""
    share = float(y.mean()) if len(y) else 0.5
    model = Additive(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not len(y) or y.min() == y.max():
        return model
    d = x.shape[1]
    model.cuts = [_cuts(x[:, k], BINS) for k in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(d)]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(d):
            if len(model.tables[k]) > 1:
                g, h = slopes()
                m = len(model.tables[k])
                step = RATE * _tree(np.bincount(bins[k], g, m), np.bincount(bins[k], h, m), 2)
                model.tables[k] += step
                z += step[bins[k]]
    low = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.coarse)]
    sizes = [len(c) + 1 for c in model.coarse]

    def joint(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(low[a] * sizes[b] + low[b], values, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = sorted(((_pair_tree(joint(a, b, g), joint(a, b, h))[1], a, b) for a in range(d) for b in range(a) if sizes[a] > 1 and sizes[b] > 1), reverse=True)
    tables = {(a, b): np.zeros((sizes[a], sizes[b])) for _, a, b in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in tables.items():
            g, h = slopes()
            step = RATE * _pair_tree(joint(a, b, g), joint(a, b, h))[0]
            table += step
            z += step[low[a], low[b]]
    model.pairs = [(a, b, table) for (a, b), table in tables.items()]
    return model


def train(sample: DataFrame) -> Additive:
    """Fits on columns _text and _y of a bounded sample; a feature row for each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _measured(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.select("_text", "_y").mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    order = np.lexsort([*x.T, rows["y"].to_numpy()])  # the fit doesn't depend on the order of arrival
    return fit(x[order], rows["y"].to_numpy(float)[order])


def _measured(column: pa.Array) -> np.ndarray:
    data, offsets = raw(column)
    parts = [measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def scored(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score (0 to 1) of its whole text.

    Null and empty texts have the feature row of zeros and its score. Rows are scored one by one:
    ties, repeated rows, null ids and an empty table need no care; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_measured(batch.column(1))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Additive, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns unchanged, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        give_back()
        return pa.array(shared.value.score(_measured(column)))

    return docs.where(score(F.col(text_col)) >= least)


def quality(docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from ``learn_docs`` and ``labels`` and scores ``docs``."""
    return scored(docs, train(labelled_texts(learn_docs, labels, label, sample_rows, id_col, text_col)), id_col, text_col)
