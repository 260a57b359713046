"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are integers per component. Each shard of the table holds postings (vector and component, value) by descending size of
their quantised impact, in segments. Queries meet a shard in small blocks; segments are processed from the highest impact down.
After each segment the remaining postings bound what a vector's score can still change; a query stops as soon as few enough
vectors can still be among its k best, which is the proof, and these are scored exactly from the whole vectors.

The index is moved once, to its shards. Every query goes to every shard, as an exact search asks for: that is one vector for
tens of thousands of products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.llm.store import cut

#: Vectors of a shard, at least and at most, about; a table is dealt to as many shards as there are cores between these.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 16

#: Scores that a block of queries holds at once.
BLOCK_SCORES = 1 << 22

#: An impact of n binary digits is in segment (n - SHALLOW) / DIGITS, rounded up; the last segment has those of SHALLOW digits and fewer.
SHALLOW, DIGITS = 3, 2


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as bigint, x as double; null if the vector is unusable."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Shard:
    """Impact-ordered posting segments of one shard's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        rows, width = x.shape
        flat = x.ravel()
        place = np.flatnonzero(flat)
        value = flat[place].astype(float)
        level = np.maximum(0, -(-(np.frexp(np.abs(value))[1] - SHALLOW) // DIGITS))
        order = np.argsort(-level, kind="stable")
        self.place, self.value, level = place[order].astype(np.int64), value[order], level[order]
        self.ends = np.append(np.flatnonzero(level[1:] != level[:-1]) + 1, len(level))
        self.rest, left = [], (x.astype(float) ** 2).sum(1)
        for a, b in self.segments():  # what is left of a vector after a segment, as a length
            left = left - np.bincount(self.place[a:b] // width, weights=self.value[a:b] ** 2, minlength=rows)
            self.rest.append(np.sqrt(np.maximum(left, 0)))

    def segments(self) -> list[tuple[int, int]]:
        return list(zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of each query's k best, without the query's own id."""
        each = max(1, BLOCK_SCORES // len(self.ids))
        out = [self._block(query_ids[lo : lo + each], queries[lo : lo + each], k, lo) for lo in range(0, len(queries), each)]
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def _block(self, query_ids: np.ndarray, queries: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = queries.astype(float)
        length = np.sqrt((q * q).sum(1))
        whole = np.sqrt((self.x.astype(float) ** 2).sum(1))
        got = np.zeros((len(q), len(self.ids)))
        own = query_ids[:, None] == self.ids[None, :]
        open_, found = np.arange(len(q)), []
        kept = min(k, len(self.ids))
        scratch = np.zeros(self.x.size)
        spans = self.segments()
        for (a, b), rest, last in zip(spans, self.rest, [*[False] * (len(spans) - 1), True], strict=True):
            scratch[:] = 0
            scratch[self.place[a:b]] = self.value[a:b]
            got[open_] += q[open_] @ scratch.reshape(self.x.shape).T
            # a little room for rounding: the scores are exact integers, the lengths aren't
            slack = length[open_, None] * (rest * (1 + 1e-9) + whole * 1e-12)[None, :] + 0.5
            low = np.where(own[open_], -np.inf, got[open_] - slack)
            at_least = np.partition(low, -kept, axis=1)[:, -kept]
            able = ~own[open_] & (got[open_] + slack >= at_least[:, None])
            done = last | (able.sum(1) <= 8 * k)
            found += zip(open_[done].tolist(), [np.flatnonzero(row) for row in able[done]], strict=True)
            open_ = open_[~done]
            if not len(open_):
                break
        if not spans:  # all components are 0
            found = [(i, np.flatnonzero(~own[i])) for i in open_.tolist()]
        out = []
        for i, members in found:
            score = self.x[members] @ queries[i]
            order = np.lexsort((self.ids[members], -score))[:k]
            out.append((np.full(len(order), base + i), self.ids[members][order], score[order]))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (w, n, asks, id, q), by shard (w, n) and there first those of the index, then the queries; a shard at a time."""
    shard, name, index, waiting = None, None, [], []

    def matrix(parts: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([p.column(3).to_numpy() for p in parts])
        return ids, np.concatenate([p.column(4).flatten().to_numpy() for p in parts]).reshape(len(ids), width)

    for batch in batches:
        w, n, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        edges = [0, *(np.flatnonzero((w[1:] != w[:-1]) | (n[1:] != n[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(w)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if (w[lo], n[lo]) != name:
                name, shard, index = (w[lo], n[lo]), None, []
            part = batch.slice(lo, hi - lo)
            if not asks[lo]:
                index.append(part)
                continue
            if shard is None:
                if not index:
                    continue
                shard, index = Shard(*matrix(index, int(w[lo]))), []
            ids, q = matrix([part], int(w[lo]))
            at, found, score = shard.best(ids, q, k)
            yield pa.record_batch([pa.array(ids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest integer inner products, ties to the smaller id.

    Queries are the rows for which is_query holds, candidates all rows with another id. A vector that is null, or holds a
    null or a non-finite component, takes no part, nor does an empty one or a row with a null id. Vectors of other lengths than
    a query's are no candidates for it. A repeated id with several vectors has each of them scored. Ids are whole numbers, or
    text that can be cast to them; extra columns, under any name, are left out. An empty table gives no rows. Scores are exact
    while they fit a bigint.

    Rows are dealt to shards by a hash, so that equal vectors spread; only k rows for each query leave a shard.
    """
    spark = vectors.sparkSession
    usable = cut(
        vectors.where(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), quantise(F.col(vector), scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(F.col("q").isNotNull() & (F.size("q") > 0))
        .withColumn("w", F.size("q"))
    )
    rows = usable.count()
    shards = -(-rows // min(MOST_ROWS, max(LEAST_ROWS, -(-rows // spark.sparkContext.defaultParallelism)))) or 1
    index = usable.select("w", F.pmod(F.xxhash64("id", "q"), F.lit(shards)).cast("int").alias("n"), F.lit(False).alias("asks"), "id", "q")
    asked = usable.where("asks").select("w", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("n"), "asks", "id", "q")
    dealt = index.unionByName(asked).repartition(shards, "w", "n").sortWithinPartitions("w", "n", "asks")
    found = dealt.mapInArrow(lambda batches: search(batches, k), "query_id long, vec_id long, score long")
    return found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)
