"""Language-model scores: a unigram base, and a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf). Every frequent word is a class of its own;
the others share classes by their last two bytes. P(class | history) is a softmax whose features are the class alone, with the
class before (bigram), with the one before that (skip) and with both (trigram). A class of many words is a tree of DEPTH binary
softmaxes down to its leaves, by the bits of a word's key; their features are a node with the word before (bigram), with the one
before that (skip) and with both (trigram), added to what the leaves' counts say. All features are hashed into vectors of weights.
P(word | leaf) is a smoothed frequency; leaves hold few words.

Weights are trained by gradient updates: each pass, Spark tasks sum the log likelihood's gradient and its curvature (observed and
expected counts) over all training data, and the weights take a damped step. The class softmax reads counts of (two classes, next class), the trees read
the texts.

Word counts are joined in two parts: those of the most frequent words go to all tasks as one table of a fixed size, the
other words of each document are shuffled to their counts. So no task holds the vocabulary, and frequent words aren't moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.llm.blocks import mix, pieces, word_keys
from archlake.llm.store import cut

#: Classes of the rarer words: the last five bits of a word's key.
SUFFIXES = 32
#: Classes of one word each; the last of them is the end of a text.
OWN = 64
CLASSES = OWN + SUFFIXES
END_CLASS, START = OWN - 1, CLASSES  # START stands before a text, as a history only
HISTORIES = (CLASSES + 1) ** 2

#: Words whose counts every task gets.
HEAD_WORDS = 1 << 17

#: Hashed weights of the class softmax, passes over its cells, and the length of a step.
WEIGHTS = 1 << 17
PASSES = 10
RATE = 1.5
#: Added to the expected count of a weight; a step of a weight is at most LONGEST.
PRIOR, LONGEST = 1.0, 1.0

#: Binary softmaxes from a class to a leaf, their hashed weights, passes over the texts, length of a step, and the inverse variance of a weight.
DEPTH = 6
TREE_WEIGHTS = 1 << 20
TREE_PASSES = 1
TREE_RATE = 0.8
TREE_PRIOR = 2.0
LEAVES = SUFFIXES << DEPTH

# Odd numbers that hashes are multiplied with.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

#: Weights that a row of gradients holds.
SLICE = 1 << 14

END_KEY = np.uint64(0x5DEECE66D << 5)


def token_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words (59 bits of a hash, then the class of the last two bytes), and each row's first word."""
    starts, ends, first, keys = word_keys(data, offs)
    last = data[ends - 1].astype(np.uint32)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    small = lambda b: b + 32 * ((b >= 65) & (b < 91)).astype(np.uint32)
    suffix = ((small(before) * np.uint32(0x9E3779B1) + small(last) * np.uint32(0x85EBCA6B)) >> np.uint32(13)) % np.uint32(SUFFIXES)
    return (keys & ~np.uint64(SUFFIXES - 1)) | suffix.astype(np.uint64), first


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """h (a word's key as bigint) and c, over all texts; every text has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.full(batch.num_rows, END_KEY)]
            for _, _, data, offs in pieces(batch.column(0)):
                keys.append(token_keys(data, offs)[0])
            h, c = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return docs.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts of the most frequent words, and totals of the whole vocabulary."""

    keys: np.ndarray  # ascending
    counts: np.ndarray
    own: np.ndarray  # class of a word that has one, else -1
    tokens: int
    words: int
    mass: np.ndarray  # of each leaf, by the low bits of a key: smoothed tokens, without words that are classes of their own

    @staticmethod
    def of(counts: DataFrame) -> Lexicon:
        top = counts.orderBy(F.desc("c"), "h").limit(HEAD_WORDS).toArrow()
        keys, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
        if len(keys) and END_KEY not in keys:  # texts so long that their ends are rare
            ends = counts.where(F.col("h") == int(END_KEY.view(np.int64))).first()["c"]
            keys, c = np.append(keys, END_KEY), np.append(c, ends)
        sums = {r["k"]: (r["t"], r["w"]) for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(LEAVES - 1)).alias("k")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("w")).collect()}
        tokens = np.array([sums.get(k, (0, 0))[0] for k in range(LEAVES)], np.int64)
        words = np.array([sums.get(k, (0, 0))[1] for k in range(LEAVES)], np.int64)
        total, distinct = int(tokens.sum()), int(words.sum())
        own = np.full(len(keys), -1, np.int64)
        names = np.flatnonzero(keys != END_KEY)[: OWN - 1]
        own[names] = np.arange(len(names))
        own[keys == END_KEY] = END_CLASS
        for k in np.flatnonzero(own >= 0):
            tokens[int(keys[k]) % LEAVES] -= c[k]
            words[int(keys[k]) % LEAVES] -= 1
        order = np.argsort(keys)
        return Lexicon(keys[order], c[order], own[order], total, distinct, np.maximum(tokens, 0) + 0.5 * (words + 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count or -1 if it isn't a frequent word, whether the word is its own class)."""
        suffix = OWN + (keys & np.uint64(SUFFIXES - 1)).astype(np.int64)
        if not len(self.keys):
            return suffix, np.full(len(keys), -1), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        own = np.where(hit, self.own[at], -1)
        return np.where(own >= 0, own, suffix), np.where(hit, self.counts[at], -1), own >= 0


def _sequence(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with each row's end, their histories (class before * (CLASSES+1) + the one before that), rows' starts."""
    rows = len(first) - 1
    start = first[:-1] + np.arange(rows)
    seq = np.full(len(classes) + rows, END_CLASS, np.int64)
    seq[np.arange(len(classes)) + np.repeat(np.arange(rows), np.diff(first))] = classes
    one, two = np.empty_like(seq), np.empty_like(seq)
    one[1:], two[2:] = seq[:-1], seq[:-2]
    one[start] = two[start] = START
    two[np.minimum(start + 1, len(seq) - 1)] = START
    return seq, one * (CLASSES + 1) + two, start


def count_cells(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """history, class and n: how often each class follows each history, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(HISTORIES * CLASSES, np.int64)
        for batch in batches:
            for _, _, data, offs in pieces(batch.column(0)):
                keys, first = token_keys(data, offs)
                seq, history, _ = _sequence(lexicon.find(keys)[0], first)
                cell, c = np.unique(history * CLASSES + seq, return_counts=True)
                n[cell] += c
        cell = np.flatnonzero(n)
        yield pa.record_batch([pa.array((cell // CLASSES).astype(np.int32)), pa.array((cell % CLASSES).astype(np.int32)), pa.array(n[cell])], names=["history", "class", "n"])

    return docs.select(text).mapInArrow(run, "history int, class int, n long").groupBy("history", "class").agg(F.sum("n").alias("n"))


def _features(history: np.ndarray) -> np.ndarray:
    """Weight indices, history x class x feature."""
    one, two = history // (CLASSES + 1), history % (CLASSES + 1)
    t = np.arange(CLASSES)
    kinds = [np.zeros_like(history), one + 1, two + 1 + (CLASSES + 1), history + 1 + 2 * (CLASSES + 1)]
    return np.stack([(mix((k[:, None] * CLASSES + t).astype(np.uint64)) % np.uint64(WEIGHTS)).astype(np.int64) for k in kinds], 2)


def _log_softmax(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = weights[at].sum(2)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def gradient(history: np.ndarray, target: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of each weight over the cells; their difference is the log likelihood's gradient."""
    own, row = np.unique(history, return_inverse=True)
    observed, expected = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for lo in range(0, len(own), 1024):  # histories at a time
        part = own[lo : lo + 1024]
        at = _features(part)
        p = np.exp(_log_softmax(weights, at))
        here = (row >= lo) & (row < lo + len(part))
        seen = np.zeros((len(part), CLASSES))
        np.add.at(seen, (row[here] - lo, target[here]), n[here])
        total = seen.sum(1, keepdims=True)
        for k in range(at.shape[2]):
            flat = at[:, :, k].ravel()
            observed += np.bincount(flat, weights=seen.ravel(), minlength=WEIGHTS)
            expected += np.bincount(flat, weights=(total * p).ravel(), minlength=WEIGHTS)
    return observed, expected


def train(cells: DataFrame) -> np.ndarray:
    """Weights after PASSES distributed updates; zero weights (a uniform model) without cells."""
    weights = np.zeros(WEIGHTS)
    for _ in range(PASSES):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            got = [[b.column(k).to_numpy() for k in range(3)] for b in batches]
            if got:
                both = np.stack(gradient(*(np.concatenate(v) for v in zip(*got, strict=True)), weights)).astype(np.float32)
                yield pa.record_batch([pa.array([both.tobytes()], pa.binary())], names=["sums"])

        sums = [np.frombuffer(r["sums"], np.float32).reshape(2, -1).astype(float) for r in cells.mapInArrow(run, "sums binary").toLocalIterator()]
        if not sums:
            break
        observed, expected = sum(sums)
        # four weights make a logit, so that each one takes about a quarter of the step; expected counts bound the curvature
        weights = weights + RATE / 4 * np.clip((observed - expected) / (expected + PRIOR), -LONGEST, LONGEST)
    return weights.astype(np.float32)


def _before(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the keys of the word before and of the one before that, 0 where there is none."""
    start = first[:-1][np.diff(first) > 0]
    one, two = np.zeros_like(keys), np.zeros_like(keys)
    one[1:] = keys[:-1]
    one[start] = 0
    two[1:] = one[:-1]
    two[start] = 0
    return one, two


def tree_steps(mass: np.ndarray, keys: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step down the tree: weight indices (feature x word), the log odds that the leaves' masses give, the bit taken (0 or 1)."""
    suffix_bits, shift = SUFFIXES.bit_length() - 1, np.uint64(65 - TREE_WEIGHTS.bit_length())
    # keys are hashes, so that a product with an odd number and its upper bits will do
    histories = np.stack([one * _ODD[0], two * _ODD[1] + _ODD[2], (one + two * _ODD[0]) * _ODD[3]])
    for d in range(DEPTH):
        bits = suffix_bits + d
        node = keys & np.uint64((1 << bits) - 1)
        below = mass.reshape(-1, 1 << (bits + 1)).sum(0)  # by the bits so far and the next one
        odds = np.log(below[1 << bits :] / below[: 1 << bits])[node.astype(np.int64)]
        at = histories ^ ((node + np.uint64(1 << bits)) * _ODD[4])
        at *= _ODD[5]
        at >>= shift
        yield at.view(np.int64), odds, ((keys >> np.uint64(bits)) & np.uint64(1)).astype(float)


def tree_log(mass: np.ndarray, weights: np.ndarray, keys: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log P(leaf | class, history) of each word."""
    out = np.zeros(len(keys))
    for at, odds, bit in tree_steps(mass, keys, one, two):
        z = odds + weights[at].sum(0)
        out -= np.logaddexp(0, np.where(bit > 0, -z, z))
    return out


def tree_gradient(mass: np.ndarray, weights: np.ndarray, keys: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the log likelihood by each weight, and its curvature (without the prior)."""
    g, h = np.zeros(TREE_WEIGHTS), np.zeros(TREE_WEIGHTS)
    for at, odds, bit in tree_steps(mass, keys, one, two):
        p = 1 / (1 + np.exp(-(odds + weights[at].sum(0))))
        flat = at.ravel()
        g += np.bincount(flat, weights=np.tile(bit - p, len(at)), minlength=TREE_WEIGHTS)
        h += np.bincount(flat, weights=np.tile(p * (1 - p), len(at)), minlength=TREE_WEIGHTS)
    return g, h


def train_trees(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> np.ndarray:
    """Weights of all trees after TREE_PASSES distributed updates; zero weights without words."""
    weights = np.zeros(TREE_WEIGHTS, np.float32)
    slices = TREE_WEIGHTS // SLICE
    for _ in range(TREE_PASSES):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            both = np.zeros((2, TREE_WEIGHTS))
            for batch in batches:
                for _, _, data, offs in pieces(batch.column(0)):
                    keys, first = token_keys(data, offs)
                    one, two = _before(keys, first)
                    on = ~lexicon.find(keys)[2]
                    both += tree_gradient(lexicon.mass, weights, keys[on], one[on], two[on])
            parts = both.reshape(2, slices, SLICE).transpose(1, 0, 2).astype(np.float32)
            yield pa.record_batch([pa.array(np.arange(slices, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[k] = total.get(k, 0) + np.frombuffer(sums, np.float32).astype(float)
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["slice", "sums"])

        shape = "slice int, sums binary"
        got = docs.select(text).mapInArrow(run, shape).repartition(slices, "slice").mapInArrow(add, shape).toArrow()  # a number for each weight
        both = np.zeros((2, slices, SLICE))
        for k, sums in zip(got["slice"].to_pylist(), got["sums"].to_pylist(), strict=True):
            both[:, k] = np.frombuffer(sums, np.float32).reshape(2, SLICE)
        g, h = both.reshape(2, -1)
        weights = (weights + TREE_RATE * (g - TREE_PRIOR * weights) / (h + TREE_PRIOR)).astype(np.float32)
    return weights


@dataclass
class Table:
    """log10 P(class | history), worked out for the histories that a worker meets."""

    weights: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.zeros(HISTORIES, bool))
    log10: np.ndarray = field(default_factory=lambda: np.zeros((HISTORIES, CLASSES), np.float32))

    def get(self, history: np.ndarray, target: np.ndarray) -> np.ndarray:
        new = np.unique(history[~self.known[history]])
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            self.log10[part] = _log_softmax(self.weights.astype(float), _features(part)) / np.log(10)
            self.known[part] = True
        return self.log10[history, target]


def score(docs: DataFrame, may_learn: Column, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    A null or empty text is its end alone. Nothing learnt (no training rows) gives a base score of 0 and a uniform model.
    Repeated rows and repeated or null keys are scored row by row. A null may_learn counts as true.
    """
    learn = docs.where(F.coalesce(may_learn, F.lit(True))).select(text)
    counts = cut(count_words(learn, text))
    lexicon = Lexicon.of(counts)
    weights, trees = train(cut(count_cells(learn, lexicon, text))), train_trees(learn, lexicon, text)
    base_all = np.log10(lexicon.tokens + 0.5 * (lexicon.words + 1))
    leaf_all = np.log10(lexicon.mass)

    rows = docs.select(*[v.alias(k) for k, v in keep.items()], F.col(text).alias("_text"))
    width = len(keep)
    schema = T.StructType(
        [*rows.schema.fields[:width], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")]]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
        + [T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(weights)
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(width)):
                yield pa.record_batch([*[batch.column(k).slice(lo, hi - lo) for k in range(width)], *_score_block(data, offs, table)], names=schema.names)

    def _score_block(data: np.ndarray, offs: np.ndarray, table: Table) -> list[pa.Array]:
        n = len(offs) - 1
        keys, first = token_keys(data, offs)
        classes, c, own = lexicon.find(keys)
        row = np.repeat(np.arange(n), np.diff(first))
        tokens = np.diff(first) + 1
        seq, history, start = _sequence(classes, first)
        model = np.add.reduceat(table.get(history, seq).astype(float), start)
        end = lexicon.counts[lexicon.keys == END_KEY]
        end = int(end[0]) if len(end) else 0
        logs = np.log10(np.maximum(c, 0) + 0.5)
        logs[c < 0] = 0  # rare words' counts come from the join
        base = np.bincount(row, weights=logs, minlength=n) + np.log10(end + 0.5) - tokens * base_all
        inner, many = np.zeros(len(keys)), ~own
        one, two = _before(keys, first)
        inner[many] = logs[many] - leaf_all[(keys[many] & np.uint64(LEAVES - 1)).astype(np.int64)] + tree_log(lexicon.mass, trees, keys[many], one[many], two[many]) / np.log(10)
        model += np.bincount(row, weights=inner, minlength=n)
        known = np.bincount(row, weights=c > 0, minlength=n).astype(np.int64) + (end > 0)
        rare = c < 0
        order = np.lexsort((keys[rare], row[rare]))
        k, r = keys[rare][order], row[rare][order]
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))) if len(k) else np.empty(0, np.int64)
        edge = pa.array(np.searchsorted(r[new], np.arange(n + 1)).astype(np.int32))
        return [
            pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(model),
            pa.ListArray.from_arrays(edge, pa.array(k[new].view(np.int64))),
            pa.ListArray.from_arrays(edge, pa.array(np.diff(np.append(new, len(k))).astype(np.int32))),
        ]

    done = cut(rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    rare = done.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("_z")).select("_row", F.col("_z.rare").alias("h"), F.col("_z.times").alias("n"))
    more = (
        rare.join(counts, "h", "left")
        .groupBy(F.col("_row").alias("_r"))
        .agg(F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("_log"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("_n"))
    )
    log, seen = F.coalesce("_log", F.lit(0.0)), F.coalesce("_n", F.lit(0))
    return done.join(more, F.col("_row") == F.col("_r"), "left").select(
        *[F.col(c) for c in keep],
        "n_tokens",
        (F.col("n_known") + seen).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
