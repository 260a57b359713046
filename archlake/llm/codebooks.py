"""Product codes of vectors on integers: Lloyd's rounds with adaptive bounds after Drake and Hamerly.

A vector is cut into parts, each part has a codebook. After a round every part of every vector keeps its b closest entries, the
assigned one first, with an upper bound of the distance to that one, lower bounds for the others in ascending order, and one
outer bound for all entries that aren't kept. When entries move, bounds are moved by as much, and only where the upper bound
reaches a lower one are distances worked out again: those to kept entries if the outer bound allows it, else all. These
distances are integers, so that the answer never depends on rounding: bounds are rounded outwards and a tie is always verified.

b adapts: after each round it falls to what nearly all verified parts needed, never rises, and so the stored state shrinks.

The vectors and their state are a table in the shared folder that each round replaces; a round is one pass over it. What comes
to the driver, and goes to the tasks, are codebooks: entries x width numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.llm.skew import attach
from archlake.llm.store import cut, remove, scratch
from archlake.llm.topk import quantise

#: Entries that are kept for a part at first and at least, the assigned one among them.
KEPT, LEAST_KEPT = 8, 2

#: At most this share of the verified parts may need more entries than the next b.
BEYOND = 0.02

#: Distances that are worked out at once.
BLOCK = 1 << 20

ROWS, SUMS, NEEDS = 0, 1, 2


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def _exact(x: np.ndarray, width: int) -> np.ndarray:
    """Integers of a kind in which squared distances of `width` components can't overflow."""
    top = int(np.abs(x).max(initial=0))
    return x if 4 * top * top * max(1, width) < 1 << 62 else x.astype(object)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries."""
    width = x.shape[1]
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, width) < 1 << 52:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = (v if 4 * top * top * max(1, width) < 1 << 62 else v.astype(object) for v in (x, entries))
    return np.stack([((a - e) ** 2).sum(1) for e in b], axis=1) if len(a) else np.empty((0, len(b)), np.int64)


def distances_to(x: np.ndarray, entries: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to its own chosen entries."""
    both = _exact(np.concatenate([x, entries]), x.shape[1])
    a, b = both[: len(x)], both[len(x) :]
    return np.stack([((a - b[chosen[:, i]]) ** 2).sum(1) for i in range(chosen.shape[1])], axis=1)


@dataclass
class Bounds:
    """State of one part of many vectors: kept entries (n, b), upper bounds (n), lower bounds (n, b), the last one outer."""

    kept: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @staticmethod
    def fresh(x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
        """By distances to all entries; of equally close ones the lower index comes first."""
        n, k = len(x), len(entries)
        b = min(b, k)
        out = Bounds(np.empty((n, b), np.uint8), np.empty(n, np.float32), np.empty((n, b), np.float32))
        step = max(1, BLOCK // k)
        for lo in range(0, n, step):
            d = distances(x[lo : lo + step], entries)
            order = np.argsort(d, axis=1, kind="stable")[:, : b + 1]
            near = _root(np.take_along_axis(d, order, axis=1))
            at = slice(lo, lo + len(d))
            out.kept[at], out.upper[at] = order[:, :b], _up(near[:, 0])
            out.lower[at, : order.shape[1] - 1] = _down(near[:, 1:])
            out.lower[at, order.shape[1] - 1 :] = np.inf  # no entries beyond
        return out

    def narrowed(self, b: int) -> Bounds:
        """The same with fewer kept entries; the bound of the first one that goes holds for all that aren't kept."""
        return Bounds(self.kept[:, :b], self.upper, self.lower[:, :b])

    def moved(self, moves: np.ndarray) -> None:
        """After entries have moved by `moves`; lower bounds stay in ascending order, as each holds for all behind it, too."""
        low = self.lower.astype(np.float64)
        low[:, :-1] -= moves[self.kept[:, 1:]]
        low[:, -1] -= moves.max(initial=0.0)
        self.lower = _down(np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1])
        self.upper = _up(self.upper + moves[self.kept[:, 0]])

    def settle(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Make the first kept entry the nearest one. Returns how many parts needed 1 .. b kept entries, or all (last)."""
        b = self.kept.shape[1]
        needs = np.zeros(b + 1, np.int64)
        open_ = np.flatnonzero(self.upper >= self.lower[:, 0])
        if len(open_):
            self.upper[open_] = _up(_root(distances_to(x[open_], entries, self.kept[open_, :1])[:, 0]))
            open_ = open_[self.upper[open_] >= self.lower[open_, 0]]
        if not len(open_):
            return needs
        reach = (self.lower[open_] <= self.upper[open_, None]).sum(1)  # entries behind the first that may be nearer; b: any
        inside, outside = open_[reach < b], open_[reach == b]
        if len(inside):
            kept = self.kept[inside]
            d = distances_to(x[inside], entries, kept)
            order = _sorted(d, kept) if d.dtype == object else np.lexsort((kept, d), axis=1)
            near = _root(np.take_along_axis(d, order, axis=1))
            self.kept[inside], self.upper[inside] = np.take_along_axis(kept, order, axis=1), _up(near[:, 0])
            low = np.concatenate([_down(near[:, 1:]), self.lower[inside, -1:]], axis=1)
            self.lower[inside] = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
            needs[1:] += np.bincount(reach[reach < b], minlength=b)[:b]
        if len(outside):
            new = Bounds.fresh(x[outside], entries, b)
            self.kept[outside], self.upper[outside], self.lower[outside] = new.kept, new.upper, new.lower
            needs[0] += len(outside)
        return needs


def _sorted(d: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Order by distance, then index, of numbers too large for machine words."""
    return np.array([sorted(range(len(row)), key=lambda i: (row[i], ids[i])) for row, ids in zip(d, kept.tolist(), strict=True)])


def _binary(rows: np.ndarray) -> pa.Array:
    raw, each = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * each).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(raw)])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class Round:
    """One pass: assign the parts to `books`, whose entries have moved by `moves` since the state was stored (None: no state)."""

    books: list[np.ndarray]
    moves: list[np.ndarray] | None
    stored: int = KEPT
    kept: int = KEPT

    def settled(self, batch: pa.RecordBatch, names: dict[str, int], x: np.ndarray) -> tuple[list[Bounds], list[np.ndarray]]:
        parts, needs = [], []
        size = x.shape[1] // len(self.books)
        if self.moves is not None:
            near = _matrix(batch.column(names["near"]), np.uint8, len(self.books) * self.stored)
            far = _matrix(batch.column(names["bounds"]), np.float32, len(self.books) * (1 + self.stored))
        for p, entries in enumerate(self.books):
            own = x[:, p * size : (p + 1) * size]
            if self.moves is None:
                state = Bounds.fresh(own, entries, self.kept)
                needs.append(np.zeros(self.kept + 1, np.int64))
            else:
                lo, hi = p * self.stored, p * (1 + self.stored)
                state = Bounds(near[:, lo : lo + self.stored], far[:, hi], far[:, hi + 1 : hi + 1 + self.stored]).narrowed(self.kept)
                state.moved(self.moves[p])
                needs.append(state.settle(own, entries))
            parts.append(state)
        return parts, needs


def _pass(step: Round, carried: list[str], last: bool):
    """The function of a pass for mapInArrow. Rows of the carried columns and q come in, with near and bounds if there's a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, entries = len(step.books), len(step.books[0])
        size = step.books[0].shape[1]
        width = count * size
        n = np.zeros((count, entries), np.int64)
        sums = np.zeros((count, entries, size), np.int64)
        needs = np.zeros((count, step.kept + 1), np.int64)
        weight = 0
        schema: list[pa.Field] = []

        def figures() -> Iterator[pa.RecordBatch]:
            made = [(SUMS, p, e, int(n[p, e]), sums[p, e].tolist()) for p in range(count) for e in np.flatnonzero(n[p]).tolist()]
            made += [(NEEDS, p, r, int(needs[p, r]), None) for p in range(count) for r in np.flatnonzero(needs[p]).tolist()]
            if made:
                kind, part, entry, many, total = zip(*made, strict=True)
                given = {"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(many, pa.int64()), "sums": pa.array(total, pa.list_(pa.int64()))}
                yield pa.record_batch([given.get(f.name, pa.nulls(len(made), f.type)) for f in schema], names=[f.name for f in schema])
            n[:], sums[:], needs[:] = 0, 0, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            names = {c: i for i, c in enumerate(batch.schema.names)}
            x = _vectors(batch.column(names["q"]), width)
            parts, used = step.settled(batch, names, x)
            rest = [batch.column(names[c]) for c in carried]
            if last:
                code = np.stack([s.kept[:, 0] for s in parts], axis=1)
                error = sum(distances_to(x[:, p * size : (p + 1) * size], step.books[p], s.kept[:, :1])[:, 0] for p, s in enumerate(parts))
                yield pa.record_batch([*rest, pa.array([c.tobytes().hex() for c in code]), pa.array(error.tolist(), pa.int64())], names=[*carried, "code", "error"])
                continue
            top = int(np.abs(x).max(initial=0)) * len(x)
            if schema and weight + top >= 1 << 62:  # before the sums could overflow
                yield from figures()
                weight = 0
            weight += top
            for p, s in enumerate(parts):
                to, own = s.kept[:, 0], x[:, p * size : (p + 1) * size]
                order = np.argsort(to, kind="stable")
                used_entries, starts = np.unique(to[order], return_index=True)
                n[p] += np.bincount(to, minlength=entries)
                if size:
                    sums[p, used_entries] += np.add.reduceat(own[order], starts, axis=0)
                needs[p] += used[p]
            rows = {
                **dict(zip(carried, rest, strict=True)),
                "q": batch.column(names["q"]),
                "near": _binary(np.concatenate([s.kept for s in parts], axis=1)),
                "bounds": _binary(np.concatenate([np.concatenate([s.upper[:, None], s.lower], axis=1) for s in parts], axis=1)),
                "kind": pa.repeat(pa.scalar(ROWS, pa.int32()), len(x)),
                "part": pa.nulls(len(x), pa.int32()), "entry": pa.nulls(len(x), pa.int32()), "n": pa.nulls(len(x), pa.int64()), "sums": pa.nulls(len(x), pa.list_(pa.int64())),
            }
            schema = [pa.field(k, v.type) for k, v in rows.items()]
            yield pa.record_batch(list(rows.values()), names=list(rows))
        if schema:
            yield from figures()

    return run


@dataclass
class Codec:
    """Trained codebooks: an array of entries for each part. kept: b of each round."""

    books: list[np.ndarray]
    kept: list[int] = field(default_factory=list)

    def text(self) -> str:
        """All components by part, entry and position, as decimal numbers."""
        return ",".join(str(v) for book in self.books for entry in book.tolist() for v in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        return [v for book, e in zip(self.books, bytes.fromhex(code), strict=True) for v in book[e].tolist()]


def _prepared(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int, scale: int) -> tuple[DataFrame, int]:
    """k, label and q of the vectors that take part, stored, and the width of q."""
    chosen = vectors.select(
        F.col(key).alias("k"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), quantise(F.col(vector), scale).alias("q")
    ).where("q is not null")
    large = F.exists("q", lambda v: F.abs(v) >= 1 << 53)
    stored = cut(chosen.withColumn("q", F.when(large, F.raise_error(F.lit("a component is too large: 2**53 and more after scaling"))).otherwise(F.col("q"))))
    longest = stored.agg(F.max(F.size("q"))).first()[0] or 1
    width = -(-longest // parts) * parts
    return stored.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))), width


def _first(stored: DataFrame, parts: int, entries: int, width: int) -> list[np.ndarray]:
    rows = stored.orderBy(F.col("k").asc_nulls_last(), "q").limit(entries).select("q").collect()
    x = np.array([r["q"] for r in rows], np.int64).reshape(len(rows), width)
    size = width // parts
    return [x[:, p * size : (p + 1) * size].copy() for p in range(parts)]


def _next_b(needs: dict[int, int], b: int) -> int:
    """The fewest kept entries beyond which at most BEYOND of the verified parts went. needs: parts by entries, 0 for all."""
    total = sum(needs.values())
    found = b
    while found > LEAST_KEPT and needs.get(0, 0) + sum(n for r, n in needs.items() if r > found - 1) <= BEYOND * total:
        found -= 1
    return found


def _moved(books: list[np.ndarray], rows: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries at the floors of their parts' means, and by how much each has moved, rounded up."""
    new = [b.copy() for b in books]
    for r in rows:
        new[r["part"]][r["entry"], r["pos"]] = int(r["total"]) // int(r["n"])
    gaps = [_exact(np.concatenate([a, b]), a.shape[1]) for a, b in zip(books, new, strict=True)]
    return new, [np.nextafter(_root(((g[: len(a)] - g[len(a) :]) ** 2).sum(1)), np.inf) * (1 + 1e-12) for g, a in zip(gaps, books, strict=True)]


def _trained(stored: DataFrame, books: list[np.ndarray], rounds: int, carried: list[str]) -> tuple[DataFrame, Codec, Round]:
    """The last stored state, the codebooks, and the pass that assigns the parts for the last time."""
    spark, state, moves, path = stored.sparkSession, stored, None, None
    b = stored_b = min(KEPT, len(books[0]))
    codec = Codec(books)
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in carried], "q array<bigint>, near binary, bounds binary, kind int, part int, entry int, n long, sums array<bigint>"])
    for _ in range(rounds):
        step = Round(codec.books, moves, stored_b, b)
        after = scratch(spark, "codes")
        state.mapInArrow(_pass(step, carried, False), shape).write.partitionBy("kind").option("compression", "zstd").parquet(after)
        read = spark.read.schema(shape).parquet(after)
        totals = read.where(F.col("kind") == SUMS).select("part", "entry", "n", F.posexplode("sums").alias("pos", "v"))
        rows = totals.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).collect()
        found = {r[0]: r[1] for r in read.where(F.col("kind") == NEEDS).groupBy("entry").agg(F.sum("n")).collect()}
        codec.kept.append(b)
        codec.books, moves = _moved(codec.books, rows)
        if path:
            remove(spark, path)
        path, state = after, read.where(F.col("kind") == ROWS).select(*carried, "q", "near", "bounds")
        stored_b, b = b, _next_b(found, b) if found else b
    return state, codec, Round(codec.books, moves, stored_b, b)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, Codec]:
    """(rows, codec): key, code, error and label_error of every vector that takes part, and the trained codebooks.

    Components become floor(scale * x). Codebooks start as the parts of the `entries` (256 at most) smallest keys; each round
    assigns all parts and moves entries to the floors of their parts' means, unused ones stay; then parts are assigned again.
    code has two hex digits a part; error is the exact squared distance; label_error is its sum over rows of an equal label.

    A vector that is null, or holds a null or a non-finite component, takes no part. Shorter vectors are filled with zeros up
    to the longest one, as is a length that isn't a multiple of `parts`. Of rows with one key the smaller vector comes first; a
    null key comes last. A null label is a label. Fewer vectors than entries make a smaller codebook. Components of 2**53 and
    more after scaling stop the job, as do errors beyond a bigint. Extra columns, under any name, are left out. An empty
    table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    stored, width = _prepared(vectors, key, vector, label, parts, scale)
    books = _first(stored, parts, entries, width)
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    shape = f"k {kinds['k']}, label {kinds['label']}, code string, error long"
    if not len(books[0]):
        codec, coded = Codec(books), stored.sparkSession.createDataFrame([], shape)
    else:
        state, codec, final = _trained(stored, books, rounds, ["k", "label"])
        coded = cut(state.mapInArrow(_pass(final, ["k", "label"], True), shape))
    totals = cut(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")))
    named = attach(coded, totals, ["label"], "n", F.monotonically_increasing_id())
    return named.select(F.col("k").alias(key), "code", "error", "label_error"), codec


def entries_of(spark: SparkSession, codec: Codec) -> DataFrame:
    """part, entry and components of the codebooks, as a table of parts x entries rows."""
    rows = [(p, e, v) for p, book in enumerate(codec.books) for e, v in enumerate(book.tolist())]
    return spark.createDataFrame(rows, "part int, entry int, components array<bigint>")
