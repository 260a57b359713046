"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in every round each feature in turn gets a shallow tree on its bins, whose leaves are added to the
feature's lookup table; after the single features, the pairs that reduce the loss most get tables of two crossed cuts.
A score is the logistic of the intercept plus one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.llm.blocks import frugal, pieces, word_keys


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows learnt from, at most; they are those with the smallest hashes of their keys
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 120
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.15
    least_rows: int = 5  # in a leaf
    smoothing: float = 2.0  # added to a leaf's second derivative
    seed: int = 11


FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "mark_share", "sign_share", "blank_share", "line_share",
    "wide_share", "distinct_share", "repeat_share", "top_share", "sign_word_share", "pair_share", "cap_word_share",
)

_UPPER, _DIGIT, _MARK, _SIGN, _WIDE = (np.zeros(256, np.uint8) for _ in range(5))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[ord(c) for c in ".,;:'\"?-()"]] = 1
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum() and not _MARK[b]]] = 1
_WIDE[128:] = 1


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Row x feature of whole texts; an empty text has zeros."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offs)
    if not len(data):
        return out

    def per_row(flag: np.ndarray) -> np.ndarray:
        count = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return np.diff(count[offs])

    starts, ends, first, keys = word_keys(data, offs)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    word_bytes = np.bincount(row, weights=ends - starts, minlength=n)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(words), word_bytes / many
    for k, kind in ((3, _UPPER), (4, _DIGIT), (5, _MARK), (6, _SIGN), (9, _WIDE)):
        out[:, k] = per_row(kind[data]) / some
    out[:, 7] = (size - word_bytes) / some
    out[:, 8] = per_row(data == 10) / some
    if len(keys):
        distinct, top = _distinct(keys, row, n)
        out[:, 10], out[:, 12] = distinct / many, top / many
        same = np.zeros(len(keys))
        same[1:] = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
        out[:, 11] = np.bincount(row, weights=same, minlength=n) / many
        out[:, 13] = np.bincount(row, weights=_SIGN[data[ends - 1]], minlength=n) / many
        two = (keys[:-1] * np.uint64(3) ^ keys[1:])[row[1:] == row[:-1]]
        out[:, 14] = _distinct(two, row[1:][row[1:] == row[:-1]], n)[0] / many
        out[:, 15] = np.bincount(row, weights=_UPPER[data[starts]], minlength=n) / many
    return out


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys in each row, and how often the most frequent one stands there (44 bits of a key count)."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    width = np.uint64(max(1, int(n - 1).bit_length()))
    both = np.sort(((keys >> width) << width) | row.astype(np.uint64))
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    at = (both[new] & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, at, np.diff(np.append(new, len(both))))
    return np.bincount(at, minlength=n), top


@dataclass(frozen=True)
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]  # bin -> coarser bin, for pairs
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for table, at in zip(self.tables, b, strict=True):
            z += table[at]
        for i, j, table in self.pairs:
            z += table[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return 1 / (1 + np.exp(-z))


def _gain(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return g * g / (h + s.smoothing)


def _cut(g: np.ndarray, h: np.ndarray, c: np.ndarray, lo: int, hi: int, s: Settings) -> tuple[float, int]:
    """The best place to cut the bins lo to hi-1, and what the cut gains."""
    if hi - lo < 2:
        return 0.0, lo
    G, H, C = (np.cumsum(v[lo:hi]) for v in (g, h, c))
    gain = _gain(G[:-1], H[:-1], s) + _gain(G[-1] - G[:-1], H[-1] - H[:-1], s) - _gain(G[-1], H[-1], s)
    gain[(C[:-1] < s.least_rows) | (C[-1] - C[:-1] < s.least_rows)] = 0
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray, s: Settings) -> np.ndarray:
    """Leaf values per bin of a tree with at most three leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = max(((*_cut(g, h, c, lo, hi, s), lo, hi) for lo, hi in leaves), key=lambda t: t[0])
        if best[0] <= 0:
            break
        leaves = [x for x in leaves if x != (best[2], best[3])] + [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(g))
    if len(leaves) > 1:
        for lo, hi in leaves:
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + s.smoothing)
    return out


def _crossed(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """The best table of one cut in each direction (four leaves), and what it gains."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for v in (G, H):
        a, right, low, all_ = v[:-1, :-1], v[:-1, -1:], v[-1:, :-1], v[-1, -1]
        parts.append((a, right - a, low - a, all_ - right - low + a))
    gain = sum(_gain(x, y, s) for x, y in zip(*parts, strict=True)) - _gain(G[-1, -1], H[-1, -1], s)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for rows, r in ((slice(None, i + 1), 0), (slice(i + 1, None), 1)):
        for cols, c in ((slice(None, j + 1), 0), (slice(j + 1, None), 1)):
            q = 2 * r + c
            out[rows, cols] = parts[0][q][i, j] / (parts[1][q][i, j] + s.smoothing)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Boost single features cyclically, then the best pairs on what they leave."""
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, s.bins + 1)[1:-1])) for v in x.T]
    b = [np.searchsorted(e, v, "right") for e, v in zip(edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.arange(n) * min(n, s.pair_bins) // n for n in sizes]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(share / (1 - share)))
    z = np.full(len(y), intercept)
    tables = [np.zeros(n) for n in sizes]
    counts = [np.bincount(v, minlength=n) for v, n in zip(b, sizes, strict=True)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(s.rounds):
        for k, n in enumerate(sizes):
            g, h = slopes()
            step = s.rate * _tree(np.bincount(b[k], weights=g, minlength=n), np.bincount(b[k], weights=h, minlength=n), counts[k], s)
            tables[k] += step
            z += step[b[k]]

    rough = [c[v] for c, v in zip(coarse, b, strict=True)]
    width = [int(c[-1]) + 1 for c in coarse]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = rough[i] * width[j] + rough[j], width[i] * width[j]
        return tuple(np.bincount(at, weights=v, minlength=n).reshape(width[i], width[j]) for v in slopes())

    usable = [k for k in range(len(sizes)) if width[k] > 1]
    ranked = sorted(((-_crossed(*grid(i, j), s)[0], i, j) for i, j in combinations(usable, 2)))
    pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in ranked[: s.pairs]]
    for _ in range(s.pair_rounds):
        for i, j, table in pairs:
            step = s.rate * _crossed(*grid(i, j), s)[1]
            table += step
            z += step[rough[i], rough[j]]
    return Model(edges, coarse, tables, pairs, intercept)


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep and the features of each text (array of doubles, in the order of FEATURES)."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(len(keep))):
                x = features(data, offs)
                column = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.record_batch([*[batch.column(k).slice(lo, hi - lo) for k in range(len(keep))], column], names=schema.names)

    return docs.select(*keep, text).mapInArrow(frugal(run), schema)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> Model | None:
    """Learn from labelled rows, a sample bounded by settings.sample_rows; None without rows of both labels.

    may_learn is a condition on the labels' key. Rows with a null label take no part; of a document that is labelled
    twice each label counts.
    """
    s = settings
    chosen = (
        labels.where(may_learn & F.col(label).isNotNull())
        .select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), F.xxhash64(F.col(key).cast("string"), F.lit(s.seed)).alias("_h"))
        .orderBy("_h", "_key", "_y")
        .limit(s.sample_rows)
    )
    found = docs.select(F.col(key).alias("_d"), text).join(F.broadcast(chosen), F.col("_d") == F.col("_key"))
    rows = measure(found, ["_h", "_y"], text).orderBy("_h", "_y", "features").limit(s.sample_rows).toArrow()
    if not rows.num_rows:
        return None
    y = rows["_y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = rows["features"].combine_chunks().values.to_numpy().reshape(len(y), len(FEATURES))
    return fit(x, y, s)


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """keep and the score (a column called `name`), 0 to 1: the likelihood of label 1. Null and empty texts have the score of zero features.

    Without a model (nothing to learn from) every score is 0.5. Each row is scored by itself, repeated ones too.
    """
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    columns = [*keep, *[c for c in [text] if c not in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(columns.index(text))):
                p = model.score(features(data, offs)) if model else np.full(hi - lo, 0.5)
                yield pa.record_batch([*[batch.column(k).slice(lo, hi - lo) for k in range(len(keep))], pa.array(p)], names=schema.names)

    return docs.select(*columns).mapInArrow(frugal(run), schema)
