"""Packing of documents into token sequences by non-negative least squares over the histogram of piece lengths.

1. Every text is encoded once and cut into pieces of the window's length; what remains is a shorter last piece.
2. Shallow combinations (one, two or three lengths that fill the window) get repeat counts that fit the histogram in the
   least-squares sense; counts are rounded down to what the histogram holds.
3. The rest of the histogram is packed greedily, longest first into the least room that takes it.
4. Each piece's rank among the pieces of its length picks its slot in the plan.

The plan works on counts per length, at most `window` numbers, at any input size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.llm import bpe
from archlake.llm.blocks import frugal
from archlake.llm.blocks import pieces as text_blocks
from archlake.llm.store import cut

#: Bytes of text encoded at once; a worker needs some sixty times as much.
ENCODE_BYTES = 1 << 18

#: Of the triples that fill a window, every 16th takes part in the fit; each length still is in dozens of them.
TRIPLE_STEP = 16

#: Steps of the projected gradient descent.
FIT_STEPS = 400


def encode_pieces(
    docs: DataFrame, tokenizer: str, window: int, end_id: int, key: str = "doc_id", text: str = "text", order: tuple[str, ...] = ()
) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens and the columns in order: each text's ids and the end id, cut at multiples of the window."""
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType([docs.schema[key], *longs, *[docs.schema[c] for c in order]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(tokenizer)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for lo, hi, data, offs in text_blocks(column, ENCODE_BYTES):
                ids, at = model.encode(data, offs)
                counts = np.diff(at) + 1
                rows = np.repeat(np.arange(hi - lo), -(-counts // window))
                first = np.concatenate(([0], np.cumsum(-(-counts // window))))[:-1]
                start = (np.arange(len(rows)) - first[rows]) * window
                length = np.minimum(window, counts[rows] - start)
                whole = np.insert(ids, at[1:], end_id).astype("<u4")  # one end id after each text
                begin = at[:-1][rows] + rows + start
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                taken, *more = (c.slice(lo, hi - lo).take(pa.array(rows)) for c in (keys, *batch.columns[2:]))
                yield pa.record_batch([taken, *[pa.array(x, pa.int64()) for x in (start, length, crc, counts[rows])], *more], names=schema.names)

    return docs.select(key, text, *order).mapInArrow(frugal(run), schema)


def combinations(window: int) -> list[np.ndarray]:
    """Shallow combinations of lengths that fill the window: one, two and (every TRIPLE_STEP-th) three lengths."""
    one = np.array([[window]])
    a = np.arange(1, window // 2 + 1)
    two = np.stack([a, window - a], 1)
    x, y = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    z = window - x - y
    ok = (x <= y) & (y <= z) & ((7 * x + 13 * y) % TRIPLE_STEP == 0)
    return [one, two, np.stack([x[ok], y[ok], z[ok]], 1)]


def fit(histogram: np.ndarray, combos: list[np.ndarray]) -> list[np.ndarray]:
    """Repeat counts >= 0 of the combinations that minimise the squared distance to the histogram (index: length)."""
    size = len(histogram)

    def used(x: list[np.ndarray]) -> np.ndarray:
        return sum(np.bincount(c[:, k], weights=v, minlength=size) for c, v in zip(combos, x, strict=True) for k in range(c.shape[1]))

    def back(r: np.ndarray) -> list[np.ndarray]:
        return [r[c].sum(1) for c in combos]

    probe = [np.ones(len(c)) for c in combos]
    for _ in range(12):  # the largest eigenvalue bounds the step
        top = float(np.sqrt(sum(float(v @ v) for v in probe))) or 1.0
        probe = back(used([v / top for v in probe]))
    step = 1 / (1.05 * max(1.0, float(np.sqrt(sum(float(v @ v) for v in probe)))))
    x = [np.zeros(len(c)) for c in combos]
    ahead, momentum = x, 1.0
    for _ in range(FIT_STEPS):
        grad = back(used(ahead) - histogram)
        new = [np.maximum(0, a - step * g) for a, g in zip(ahead, grad, strict=True)]
        grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = [n + (momentum - 1) / grown * (n - o) for n, o in zip(new, x, strict=True)]
        x, momentum = new, grown
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) for exactly the pieces of the histogram; index: length, 0 to window."""
    left = histogram.astype(np.int64).copy()
    if left[0]:
        raise ValueError("pieces have at least one token")
    combos = combinations(window)
    chosen: list[tuple[tuple[int, ...], int]] = []
    fitted = fit(histogram.astype(float), combos)
    ranked = sorted(
        ((tuple(map(int, c[i])), float(v[i])) for c, v in zip(combos, fitted, strict=True) for i in np.flatnonzero(v > 0.05)),
        key=lambda t: (-t[1], t[0]),
    )
    for rounding in (0.0, 0.5):  # whole repeats first, then the rest by rounding
        for lengths, value in ranked:
            need = {n: lengths.count(n) for n in lengths}
            n = int(value) if rounding == 0 else int(value - int(value) + rounding)
            n = min(n, *(int(left[k]) // m for k, m in need.items()))
            if n > 0:
                chosen.append((lengths, n))
                for k, m in need.items():
                    left[k] -= n * m
    return chosen + greedy(left, window)


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest pieces first, on counts of equal pieces and of equally filled sequences."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(window, 0, -1):
        count, space = int(left[length]), length
        while count and space <= window:
            groups = room.get(space)
            if not groups:
                space += 1
                continue
            lengths, n = groups.pop()
            fill = min(space // length, count)  # pieces of this length in each of these sequences
            take = min(n, count // fill)
            if take < n:
                groups.append((lengths, n - take))
            room.setdefault(space - fill * length, []).append((lengths + (length,) * fill, take))
            count -= take * fill
        if count:
            fill = window // length
            for lengths, n in (((length,) * fill, count // fill), ((length,) * (count % fill), 1 if count % fill else 0)):
                if n:
                    room.setdefault(window - sum(lengths), []).append((lengths, n))
    return [g for groups in room.values() for g in groups]


def _slots(planned: list[tuple[tuple[int, ...], int]], window: int) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: (key = length * 2**40 + first rank, first sequence, offset in the sequence)."""
    rank, rows, base = [0] * (window + 1), [], 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            rows.append(((length << 40) + rank[length], base, offset))
            rank[length] += n
            offset += length
        base += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 3


def pack(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", groups: int = 256, order: tuple[str, ...] = ()
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and padded_length.

    A null or empty text has the end id alone. Repeated rows are packed once each. Keys may be null or repeat; extra
    columns are left out; an empty table gives no rows. padded_length is the window, or the sequence's own length where
    that is a power of two. `groups` splits the pieces of one length when they are ranked, so that a common length
    (copies) is not one task.

    order: columns of docs that are different for any two rows; the first one is a number, never null, that isn't the same
    for many rows. With them the pieces of one length are ranked in this order instead of by key, and sequences are numbered
    by their first piece in this order.
    """
    group = F.col(order[0]) if order else F.pmod(F.xxhash64(key, "start"), F.lit(groups)).cast("int")
    found = cut(encode_pieces(docs, tokenizer, window, end_id, key, text, order)).withColumn("_group", group)
    histogram = np.zeros(window + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # at most `window` rows
        histogram[r["length"]] = r["count"]
    planned = plan(histogram, window)
    slots = _slots(planned, window)
    fills = np.array([sum(x) for x, _ in planned], np.int64)
    ends = np.cumsum(np.array([n for _, n in planned], np.int64))

    before = (
        found.groupBy("length", "_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .selectExpr("length as _l", "_group as _g", "coalesce(sum(_n) over (partition by length order by _group rows between unbounded preceding and 1 preceding), 0) as _before")
    )
    ranked = found.selectExpr("*", f"row_number() over (partition by length, _group order by {', '.join(f'`{c}`' for c in order or (key,))}, start, ids_crc32) - 1 as _rank").join(
        before, (F.col("length") == F.col("_l")) & (F.col("_group") == F.col("_g"))
    )
    bare = ranked.select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_rank")).alias("_rank"), *order)
    made = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "padded_length")]
    schema = T.StructType([*bare.schema.fields[:5], *made, *bare.schema.fields[6:]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offset = slots
        for batch in batches:
            want = (batch.column(2).to_numpy() << 40) + batch.column(5).to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, want, "right") - 1
            sequence = first[run] + (want - keys[run])
            fill = fills[np.searchsorted(ends, sequence, "right")]
            padded = np.where(fill & (fill - 1), window, fill)
            yield pa.record_batch(
                [*batch.columns[:5], *[pa.array(x, pa.int64()) for x in (sequence, offset[run], padded)], *batch.columns[6:]], names=schema.names
            )

    placed = bare.mapInArrow(frugal(place), schema)
    return _in_order(cut(placed), order) if order else placed


def _in_order(placed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Numbers the sequences by their first piece in this order; a range of the first column's values is ranked in one task."""
    heads = cut(placed.groupBy("sequence_id").agg(F.min(F.struct(*order, "start")).alias("_first")).withColumn("_group", F.col("_first")[order[0]]))
    before = (
        heads.groupBy("_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .selectExpr("_group as _g", "coalesce(sum(_n) over (order by _group rows between unbounded preceding and 1 preceding), 0) as _before")
    )
    ranked = heads.selectExpr("sequence_id", "_group", "row_number() over (partition by _group order by _first) - 1 as _rank")
    numbers = ranked.join(F.broadcast(before), F.col("_group") == F.col("_g")).select("sequence_id", (F.col("_before") + F.col("_rank")).cast("long").alias("_number"))
    names = [c for c in placed.columns if c not in order]
    return placed.join(numbers, "sequence_id").select(*[F.col("_number").alias(c) if c == "sequence_id" else c for c in names])
