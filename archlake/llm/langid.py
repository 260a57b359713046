"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of its subwords' embeddings; a subword is a run of two, three or four bytes of the lower-cased text
that starts in a word, hashed to a bucket. Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows; a temperature and a rejection threshold are set on a part of it that was not
trained on. For scoring, embedding and softmax collapse into one small table of logits per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.llm.blocks import SPACE, frugal, pieces

#: Label of texts without a letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 13
    width: int = 8  # of an embedding
    sample_rows: int = 3000  # labelled rows trained on, at most: half of them by the rows of a language, half evenly by language
    calibration_share: int = 5  # every fifth of them is for the temperature and the threshold
    epochs: int = 8
    batch: int = 64
    rate: float = 0.1  # of the first epoch; each weight's steps shrink with its gradients so far
    kept_share: float = 0.999  # of calibration rows that are right, the share that the threshold keeps, at least
    noise_share: float = 0.99  # of bags of random subwords, the share that it rejects, unless kept_share comes in the way
    seed: int = 7


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[SPACE] = 32
#: Digits and ASCII signs say nothing about a language, so that they count as blanks.
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _hashes(data: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte position, bucket) of all subwords, one length after the other. A subword starts at a letter's byte."""
    word = _WORD[data]
    sign = np.where(word, _LOWER[data], np.uint32(32))
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    h = sign * np.uint32(0x9E3779B1)
    for length in (2, 3, 4):
        if len(data) < length:
            return
        h = (h[: len(data) - length + 1] + sign[length - 1 :]) * np.uint32(0x85EBCA6B) + np.uint32(length)
        at = np.flatnonzero(word[: len(h)])
        yield at, ((h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    count = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    found = np.diff(count[offs]) > 0
    raw = None
    for i in np.flatnonzero(~found & (offs[:-1] < offs[1:])):
        raw = raw or data.tobytes()
        found[i] = any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"))
    return found


def bags(docs: DataFrame, keep: list[str], text: str, buckets: int) -> DataFrame:
    """The columns of keep, and the subword counts of each text: buckets (int array) and counts (float array)."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(len(keep))):
                ids, counts = [], []
                found = list(_hashes(data, buckets))
                for i in range(hi - lo):
                    c = np.zeros(buckets, np.float32)
                    for at, bucket in found:
                        a, b = np.searchsorted(at, (offs[i], offs[i + 1]))
                        c += np.bincount(bucket[a:b], minlength=buckets)
                    on = np.flatnonzero(c)
                    ids.append(on.astype(np.int32))
                    counts.append(c[on])
                yield pa.record_batch(
                    [*[batch.column(k).slice(lo, hi - lo) for k in range(len(keep))], pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                    names=schema.names,
                )

    return docs.select(*keep, text).mapInArrow(frugal(run), schema)


@dataclass(frozen=True)
class Model:
    labels: list[str]
    logits: np.ndarray  # bucket x label, float32
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities, row x label."""
        total = np.zeros((len(offs) - 1, len(self.labels)))
        count = np.zeros(len(offs) - 1)
        for at, bucket in _hashes(data, len(self.logits)):
            edge = np.searchsorted(at, offs)
            full = edge[:-1] < edge[1:]
            if full.any():
                for k in range(len(self.labels)):  # column by column: no row x label matrix for every byte
                    total[full, k] += np.add.reduceat(self.logits[:, k][bucket], edge[:-1][full], dtype=np.float64)
            count += np.diff(edge)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True)


def _sgd(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 0.1, (s.buckets, s.width))
    out, bias = rng.normal(0, 0.1, (s.width, labels)), np.zeros(labels)
    seen_emb, seen_out, seen_bias = (np.full_like(x, 1e-12) for x in (emb, out, bias))
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), s.batch):
            batch = order[k : k + s.batch]
            ids = np.concatenate([rows[i][0] for i in batch])
            weight = np.concatenate([rows[i][1] for i in batch])
            sizes = np.array([len(rows[i][0]) for i in batch])
            at = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(emb[ids] * weight[:, None], at)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = np.repeat(p @ out.T, sizes, 0) * weight[:, None]
            grad_out, grad_bias = hidden.T @ p, p.sum(0)
            seen_out += grad_out**2
            seen_bias += grad_bias**2
            out -= rate * grad_out / np.sqrt(seen_out)
            bias -= rate * grad_bias / np.sqrt(seen_bias)
            both, same = np.unique(ids, return_inverse=True)
            step = np.empty((len(both), s.width))
            for c in range(s.width):
                step[:, c] = np.bincount(same, weights=back[:, c], minlength=len(both))
            seen_emb[both] += step**2
            emb[both] -= rate * step / np.sqrt(seen_emb[both])
    return emb, out, bias


def train(docs: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Learn from rows with a label and at least one subword; None if there are none.

    The sample is bounded by settings.sample_rows; each of its texts goes to the driver as at most settings.buckets counts. Rows
    are those with the smallest hashes of their keys, divided by their language's weight, so that rare languages are in it.
    """
    s = settings
    few = docs.where(may_learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label).withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(s.seed)))
    sizes = few.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    every = few.agg(F.count(F.lit(1)), F.count_distinct(label)).first()
    if not every[0]:
        return None
    weight = 0.5 / every[0] + 0.5 / (every[1] * F.col("_n"))
    ranked = few.select(key, label, "_h").join(sizes, F.col(label) == F.col("_l")).withColumn("_at", (F.col("_h") / 2.0**64 + 0.5) / weight)
    chosen = ranked.orderBy("_at", "_h", key).limit(s.sample_rows).select(F.col("_h").alias("_c")).distinct()
    got = bags(few.join(F.broadcast(chosen), F.col("_h") == F.col("_c")), [label, "_h"], text, s.buckets).where(F.size("buckets") > 0)
    table = got.orderBy("_h", label, "buckets", "counts").limit(s.sample_rows).toArrow()  # a hash that many rows share can't make it larger
    if not table.num_rows:
        return None
    names = table[label].to_pylist()
    labels = sorted(set(names))
    y = np.array([labels.index(n) for n in names])
    ids, counts = table["buckets"].combine_chunks(), table["counts"].combine_chunks()
    rows = []
    for i in range(len(names)):
        c = counts[i].values.to_numpy()
        rows.append((ids[i].values.to_numpy(), c / c.sum()))
    held = np.arange(len(rows)) % s.calibration_share == 0
    if held.all() or len(set(y[~held])) < len(labels):
        held[:] = False
    emb, out, bias = _sgd([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(labels), s)
    logits = (emb @ out).astype(np.float32)
    on = held if held.any() else ~held
    z = np.array([r[1] @ logits[r[0]] + bias for r, h in zip(rows, on, strict=True) if h])
    rng = np.random.default_rng(s.seed)
    spread = [(rng.integers(0, s.buckets, len(r[0])), r[1]) for r, h in zip(rows, on, strict=True) if h]
    noise = np.array([w @ logits[ids] + bias for ids, w in spread])
    temperature, threshold = _calibrate(z, y[on], noise, s)
    return Model(labels, logits, bias, temperature, threshold)


def _calibrate(z: np.ndarray, y: np.ndarray, noise: np.ndarray, s: Settings) -> tuple[float, float]:
    """The temperature of least log loss, and the threshold: as high as it takes to reject noise_share of the noise, bags as
    long as the calibration texts with their subwords drawn at random, but never so high that under kept_share of the
    right answers stay."""

    def probabilities(z: np.ndarray, t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(probabilities(z, t)[np.arange(len(y)), y] + 1e-12).mean())

    t = min(np.geomspace(0.2, 5, 33).tolist(), key=loss)
    p = probabilities(z, t)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    kept = float(right[int((1 - s.kept_share) * len(right))]) if len(right) else 0.0
    return t, min(kept, float(np.quantile(probabilities(noise, t).max(1), s.noise_share)))


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """keep, lang_pred, score (0 to 1: the calibrated probability of lang_pred) and accepted, with `prefix` before these names.

    'und' with score 0 for a null text and one without a letter, and for every text if there is no model; these and
    texts whose score is under the model's threshold are not accepted: texts of random letters, and of languages whose subwords
    have not been seen. A language that is spelled like a learnt one is taken for that. Of tied languages the first by name is taken.
    """
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(prefix + "lang_pred", T.StringType()), T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "accepted", T.BooleanType())])

    columns = [*keep, *[c for c in [text] if c not in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.labels if model else []), UNDETERMINED], object)
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(columns.index(text))):
                letters = _has_letter(data, offs)
                best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                if model:
                    p = model.score(data, offs)
                    best, score = p.argmax(1), p.max(1)
                best = np.where(letters, best, len(names) - 1)
                score = np.where(best == len(names) - 1, 0.0, score)
                accepted = (score >= model.threshold) & letters if model else np.zeros(hi - lo, bool)
                yield pa.record_batch(
                    [*[batch.column(k).slice(lo, hi - lo) for k in range(len(keep))], pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted)], names=schema.names
                )

    return docs.select(*columns).mapInArrow(frugal(run), schema)
