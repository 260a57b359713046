"""Near-duplicate groups by an exact Jaccard join of word shingles, with a token-group matrix.

1. Documents with equal shingle sets are one: their smallest id stands for them.
2. Similar sets are put into groups: sets whose most frequent shingle is the same and whose sizes are about the same, at most
   about PACK in a group. Any other set is a group of its own. Of all sets with one most frequent shingle, the one with the largest share of frequent shingles
   is compared with the others first, so that most of a family of near copies is connected early.
3. The token-group matrix has a row for each group and each token of its members' signatures. A signature is so many of a
   set's rarest shingles that two sets can only reach the threshold with `BOUND` of them in common. Pairs of groups that share
   fewer tokens, or whose sizes are too far apart, are never opened.
4. In a pair of groups that is opened, all members that aren't connected yet are held against each other: sizes and parity
   sketches (a bound from below on the symmetric difference) first; of those left the whole texts' sets are compared.
5. Groups of near copies are the connected components of all links found. Pairs of sets that are connected already need no
   comparison.

Tables that grow with the corpus are merged, also where one would be small enough to be sent to all tasks, so that plans are
the same at every size.

The order of shingles by frequency (known of frequent shingles, else by their words) steers the cost only; any order that all
documents share gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.llm.blocks import frugal, mix, pieces, shingle_keys, utf8, word_keys
from archlake.llm.components import components
from archlake.llm.store import cut

#: Shared signature tokens without which a pair of groups isn't opened.
BOUND = 2

#: Members of a group, about; ids that are sent to all tasks, at most; the label of a group whose members have several.
PACK, BROADCAST_IDS, NO_LABEL = 64, 200_000, -(1 << 63)

#: Classes of more equal sets than LARGE are sent to all tasks, if they are MANY_LARGE at most.
LARGE, MANY_LARGE = 1024, 1 << 16

#: Sets that meet one row of a head, about.
HEARD = 4096

#: Bytes of a group's member in a row besides its sketch.
MEMBER_BYTES = 48

#: Texts that one text is held against in a row, about.
MET = 32

#: Frequent shingles, and frequent words, that every task knows, at most; and how often one must occur among the rows of an Arrow batch.
FREQUENT, FREQUENT_IN_BATCH = 1 << 17, 3

#: The sizes in a group differ by a factor of at most e ** (1 / SIZE_STEPS).
SIZE_STEPS = 20

#: Pairs of groups that a task holds before it adds them up.
HELD_PAIRS = 1 << 20

#: Ids from here on get others, so that there's room for the texts of repeated ids.
ROOM = 1 << 61

#: Steps of a word's cost in a bit.
COST_SCALE = 64


@dataclass(frozen=True)
class Rule:
    """Two sets link when den * |intersection| >= num * |union|; shingles have `words` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def least(self, n: np.ndarray) -> np.ndarray:
        """The smallest intersection with which a set of n can link."""
        return -(-n * self.num // self.den)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest symmetric difference with which sets of a and b can link."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def sets_of(data: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle keys of each row, ascending."""
    _, _, first, keys = word_keys(data, offs)
    shingles, at = shingle_keys(keys, first, words)
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@dataclass(frozen=True)
class Frequency:
    """What is known of the corpus: keys (ascending) and counts of frequent shingles, keys and costs of frequent words.

    A word's cost is COST_SCALE times the binary logarithm of one over its share of all words.
    """

    shingles: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    costs: np.ndarray

    def ranks(self, data: np.ndarray, offs: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each row its distinct shingles, ascending, their ranks (rarer ones are smaller) and their counts.

        A shingle's rank depends on its words alone, so it is the same in every row: frequent shingles come last, by their
        count, the others by the product of their words' shares. Costs are integers, so that sums are exact.
        """
        _, _, first, keys = word_keys(data, offs)
        shingles, at = shingle_keys(keys, first, n)
        unknown = int(self.costs.max()) + COST_SCALE if len(self.costs) else 1
        cost = np.concatenate(([0], np.cumsum(_found(keys, self.words, self.costs, unknown))))
        have = np.diff(first)
        start = np.repeat(first[:-1] - at[:-1], np.diff(at)) + np.arange(len(shingles))
        paid = cost[start + np.minimum(np.repeat(have, np.diff(at)), n)] - cost[start]
        counts = _found(shingles, self.shingles, self.counts, 0)
        rank = np.where(counts > 0, counts, -paid - 1)
        out: tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]] = ([], [], [])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            s, one = np.unique(shingles[lo:hi], return_index=True)
            for to, part in zip(out, (s, rank[lo:hi][one], counts[lo:hi][one]), strict=True):
                to.append(part)
        return out


def _found(x: np.ndarray, keys: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), other, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], other)


def _often(keys: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur at least so often, ascending, and how often; empties the list, so that only one copy is held."""
    whole = np.concatenate([np.empty(0, np.uint64), *keys])
    keys.clear()
    whole.sort()
    often = np.unique(whole[least - 1 :][whole[least - 1 :] == whole[: len(whole) - least + 1]]) if len(whole) >= least else whole[:0]
    return often, np.searchsorted(whole, often, "right") - np.searchsorted(whole, often, "left")


def frequencies(docs: DataFrame, rule: Rule, text: str) -> Frequency:
    """The most frequent shingles (a batch counts equal sets once) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, seen, total = [], set(), []  # shingles of each set, marks of the sets, distinct words of each block with their counts
            for _, _, data, offs in pieces(batch.column(0)):
                _, _, first, words = word_keys(data, offs)
                shingles, at = shingle_keys(words, first, rule.words)
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    s = np.unique(shingles[lo:hi])
                    mark = (len(s), int(s.sum()) if len(s) else 0)
                    if mark not in seen:
                        seen.add(mark)
                        found.append(s)
                total.append(np.unique(words, return_counts=True))
            keys, at = np.unique(np.concatenate([np.empty(0, np.uint64), *[k for k, _ in total]]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.empty(0), *[n for _, n in total]]), minlength=len(keys))
            on = n >= FREQUENT_IN_BATCH
            for word, (keys, n) in ((False, _often(found, FREQUENT_IN_BATCH)), (True, (keys[on], n[on]))):
                yield pa.record_batch([pa.array(np.full(len(keys), word)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "h", "n"])

    counted = cut(docs.select(text).mapInArrow(frugal(run), "word boolean, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n")))
    tops = []
    for word in (False, True):
        top = counted.where(F.col("word") == word).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
        keys, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
        order = np.argsort(keys)
        tops += [keys[order], n[order]]
    shares = tops[3] / max(1, tops[3].sum())
    return Frequency(tops[0], tops[1], tops[2], np.rint(-COST_SCALE * np.log2(shares)).astype(np.int64))


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the number of keys per bit, about three bits a key."""
    bits = max(6, int(3 * max(1, len(s)) - 1).bit_length())
    odd = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the sketched sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.unpackbits(y)
    while len(y) > 8 * len(x):  # neighbours fold together, as the leading bits of a hash choose the bit
        y = y[0::2] ^ y[1::2]
    return int((np.unpackbits(x) ^ y).sum())


def _differ_all(a: bytes, others: list[bytes]) -> np.ndarray:
    """_differ of one sketch and many."""
    out = np.zeros(len(others), np.int64)
    equal = [k for k, b in enumerate(others) if len(b) == len(a)]
    if equal:
        rows = np.frombuffer(b"".join(others[k] for k in equal), np.uint8).reshape(len(equal), len(a))
        out[equal] = np.bitwise_count(rows ^ np.frombuffer(a, np.uint8)).sum(1)
    for k, b in enumerate(others):
        if len(b) != len(a):
            out[k] = _differ(a, b)
    return out


def describe(docs: DataFrame, rule: Rule, known: Frequency, key: str, text: str) -> DataFrame:
    """id, n, d1, d2 (a digest of the set), common (the most frequent shingle or null), share (of frequent ones), sketch, tokens
    (the signature: the set's rarest shingles, as 64-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(1)):
                out = []
                for s, rank, c in zip(*known.ranks(data, offs, rule.words), strict=True):
                    n = len(s)
                    if not n:
                        out.append((0, 0, 0, None, 0.0, _sketch(s), b""))
                        continue
                    best = int(s[c.argmax()].view(np.int64)) if c.max() else None
                    d1, d2 = int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(9))).view(np.int64))
                    rarest = s[np.argsort(rank, kind="stable")[: n - int(rule.least(np.int64(n))) + BOUND]]
                    out.append((n, d1, d2, best, float((c > 0).mean()), _sketch(s), rarest.tobytes()))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    names=["id", "n", "d1", "d2", "common", "share", "sketch", "tokens"],
                )

    bare = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return bare.mapInArrow(frugal(run), "id long, n long, d1 long, d2 long, common long, share double, sketch binary, tokens binary")


def possible(met: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) with sizes n_a, n_b and sketches s_a, s_b that these don't rule out."""
    sized = met.where((F.col("n_a") * rule.den >= F.col("n_b") * rule.num) & (F.col("n_b") * rule.den >= F.col("n_a") * rule.num))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, s_a, n_b, s_b = (batch.column(k) for k in (2, 3, 4, 5))
            most = rule.apart(n_a.to_numpy(), n_b.to_numpy())
            able = np.array([_differ(x.as_py(), y.as_py()) <= m for x, y, m in zip(s_a, s_b, most.tolist(), strict=True)], bool)
            on = pa.array(np.flatnonzero(able))
            yield pa.record_batch([batch.column(0).take(on), batch.column(1).take(on)], names=["a", "b"])

    return sized.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(frugal(run), "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """_id and _text of the documents in ids (one bigint column id, without repeats, already stored).

    Up to BROADCAST_IDS of them are sent to all tasks so that other texts aren't shuffled; more are joined by a shuffle.
    """
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(wanted, F.col("_id") == F.col("id"), "left_semi")


def linked(pairs: DataFrame, docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts link, as edges (u, v).

    The texts that one a meets come in rows of about MET, so that its own text is neither repeated for each nor a hot key.
    """
    pairs = cut(pairs)
    texts = texts_of(docs, cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), key, text)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MET).alias("parts")).where("parts > 1")
    dealt = pairs.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))))
    first = dealt.hint("merge").join(texts, F.col("b") == F.col("_id")).groupBy("a", "part").agg(F.collect_list(F.struct("b", F.col("_text").alias("t"))).alias("others"))
    both = first.join(texts, F.col("a") == F.col("_id")).select("a", F.col("_text").alias("t_a"), "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column(1)):
                left, met = sets_of(data, offs, rule.words), batch.column(2).slice(lo, hi - lo)
                owner, flat, on = np.repeat(np.arange(hi - lo), met.value_lengths().to_numpy()), met.flatten(), []
                for start, end, data, offs in pieces(flat.field("t")):
                    for x, y in zip(owner[start:end].tolist(), sets_of(data, offs, rule.words), strict=True):
                        shared = len(np.intersect1d(left[x], y, assume_unique=True))
                        on.append(bool(shared) and rule.den * shared >= rule.num * (len(left[x]) + len(y) - shared))
                at = np.flatnonzero(np.array(on, bool))
                yield pa.record_batch([batch.column(0).take(pa.array(lo + owner[at])), flat.field("b").take(pa.array(at))], names=["u", "v"])

    return both.mapInArrow(frugal(run), "u long, v long")


def matrix(sets: DataFrame, moved: DataFrame, rule: Rule) -> DataFrame:
    """The token-group matrix: token, grp, apart (the label of all members if it is one, else NO_LABEL, minus grp), and sizes (the
    least size of members with the token times 2**32, and the greatest one).

    sets: id, n, tokens. moved: id, grp, label for sets that aren't alone in their group, with a null grp for copies that
    another set stands for.
    """
    met = sets.select("id", "n", "tokens").join(moved.select("id", "grp", "label", F.lit(True).alias("hit")).hint("merge"), "id", "left").where("hit is null or grp is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, label, n = (batch.column(k).to_numpy() for k in range(3))
            data, offs = utf8(batch.column(3))
            take = np.diff(offs) // 8
            token, g, label, n = np.frombuffer(data.tobytes(), np.int64), np.repeat(g, take), np.repeat(label, take), np.repeat(n, take)
            if not len(token):
                continue
            order = np.lexsort((n, g, token))  # one row for a token and group
            token, g, label, n = token[order], g[order], label[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (g[1:] != g[:-1]))))
            last = np.append(new[1:], len(token)) - 1
            # narrow rows: a label is told from its group, as most are the same, and two sizes are one number
            yield pa.record_batch([pa.array(v) for v in (token[new], g[new], label[new] - g[new], (n[new] << 32) | n[last])], names=["token", "grp", "apart", "sizes"])

    bare = met.select(F.when(F.col("hit").isNull(), F.col("id")).otherwise(F.col("grp")).alias("grp"), F.when(F.col("hit").isNull(), F.col("id")).otherwise(F.col("label")).alias("label"), "n", "tokens")
    return bare.mapInArrow(frugal(run), "token long, grp long, apart long, sizes long")


def qualifying(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of groups, a < b, that share BOUND tokens of the matrix and have sizes that can link.

    Groups whose members are all connected with each other (the same label, not NO_LABEL) don't meet. A task adds up what
    its tokens say of a pair before it gives the pair out.
    """

    def added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return a[new], b[new], np.minimum(np.add.reduceat(n, new), BOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(4)] for b in batches]
        if not got:
            return
        token, g, apart, sizes = (np.concatenate(v) for v in zip(*got, strict=True))
        label, low, high = g + apart, sizes >> 32, sizes & 0xFFFFFFFF
        order = np.lexsort((label, token))
        token, g, label, low, high = (v[order] for v in (token, g, label, low, high))
        # a token whose groups are all connected says nothing: labels are sorted, so that its first and last one are equal
        new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        last = np.append(new[1:], len(token)) - 1
        keep = np.repeat((label[new] != label[last]) | (label[new] == NO_LABEL), last - new + 1)
        order = np.flatnonzero(keep)[np.lexsort((g[keep], token[keep]))]
        token, g, label, low, high = (v[order] for v in (token, g, label, low, high))
        tiny = rule.least(low) < BOUND  # such a set links with fewer shared tokens than BOUND
        start, step = np.flatnonzero(token[1:] == token[:-1]), 1  # rows with a next one of the same token
        held, rows_held = [], 0
        while len(start):
            for k in range(0, len(start), HELD_PAIRS):
                i = start[k : k + HELD_PAIRS]
                j = i + step
                able = (g[i] != g[j]) & (high[i] * rule.den >= low[j] * rule.num) & (high[j] * rule.den >= low[i] * rule.num) & ((label[i] != label[j]) | (label[i] == NO_LABEL))
                i, j = i[able], j[able]
                if len(i):
                    held.append((g[i], g[j], np.where(tiny[i] & tiny[j], BOUND, 1)))
                    rows_held += len(i)
                if rows_held >= HELD_PAIRS:
                    held = [added(*(np.concatenate(v) for v in zip(*held, strict=True)))]
                    rows_held = len(held[0][0])
                    if rows_held >= HELD_PAIRS // 2:
                        yield pa.record_batch([pa.array(v) for v in held[0]], names=["a", "b", "n"])
                        held, rows_held = [], 0
            step += 1
            start = start[start + step < len(token)]
            start = start[token[start] == token[start + step]]
        if held:
            yield pa.record_batch([pa.array(v) for v in added(*(np.concatenate(v) for v in zip(*held, strict=True)))], names=["a", "b", "n"])

    dealt = rows.repartition("token").mapInArrow(frugal(run), "a long, b long, n long")
    return dealt.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= BOUND).select("a", "b")


def open_groups(opened: DataFrame, member: DataFrame, about: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of members of opened pairs of groups, and of one group, that sizes and sketches don't rule out.

    member: id, grp, label. about: id, n, sketch. Sketches are read for members of opened groups only. A group's members, about
    PACK of them, are one row; pairs that are ruled out, and those that are connected already, never become rows.
    """
    needed = opened.select(F.col("a").alias("grp")).union(opened.select("b")).distinct()
    large = member.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
    wanted = cut(member.join(needed.union(large).distinct(), "grp"))
    packed = cut(wanted.hint("merge").join(about.select("id", "n", "sketch"), "id").groupBy("grp").agg(F.collect_list(F.struct("id", "n", "label", "sketch")).alias("rows"), F.sum(F.length("sketch") + MEMBER_BYTES).alias("weight")))
    # the lighter group of a pair goes to the heavier one
    weights = packed.select("grp", "weight")
    sided = opened.join(weights.toDF("a", "w_a"), "a").join(weights.toDF("b", "w_b"), "b")
    turned = sided.select(*[F.when(F.col("w_a") <= F.col("w_b"), x).otherwise(y).alias(to) for to, x, y in (("a", F.col("a"), F.col("b")), ("b", F.col("b"), F.col("a")))])
    left, right = packed.select(F.col("grp").alias("a"), F.col("rows").alias("rows_a")), packed.select(F.col("grp").alias("b"), F.col("rows").alias("rows_b"))
    itself = packed.join(large, "grp").select(F.col("rows").alias("rows_a"), F.col("rows").alias("rows_b"))
    met = turned.join(left, "a").join(right, "b").select("rows_a", "rows_b").unionByName(itself)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                one, two = batch.column(0)[i].values, batch.column(1)[i].values
                ids, n, label = (two.field(c).to_numpy() for c in ("id", "n", "label"))
                sketches = two.field("sketch").to_pylist()
                for q, size, mark, sketch in zip(*(one.field(c).to_pylist() for c in ("id", "n", "label", "sketch")), strict=True):
                    on = np.flatnonzero((label != mark) & (ids != q) & (n * rule.den >= size * rule.num) & (n * rule.num <= size * rule.den))
                    if len(on):
                        on = on[_differ_all(sketch, [sketches[k] for k in on.tolist()]) <= rule.apart(n[on], np.int64(size))]
                        out_a.extend([q] * len(on))
                        out_b.extend(ids[on].tolist())
            a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.mapInArrow(frugal(run), "a long, b long").distinct()


def text_hash(text: str) -> Column:
    """A hash that tells the texts of one key apart; null and empty are the same."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (id, text) with an id of its own for each text of an id that has several, and these: id, doc, h; None without any.

    New ids are larger than all others.
    """
    named = docs.where("id is not null")
    several = cut(named.groupBy("id").agg(F.min(text_hash("text")).alias("low"), F.max(text_hash("text")).alias("high")).where("low <> high").select("id"))
    if several.isEmpty():
        return docs, None
    top = named.agg(F.max("id")).first()[0]
    texts = named.join(several, "id", "left_semi").select(F.col("id").alias("doc"), text_hash("text").alias("h")).distinct()
    own = cut(texts.withColumn("new", F.lit(top) + 1 + F.monotonically_increasing_id()))
    met = docs.join(own, (F.col("id") == F.col("doc")) & (text_hash("text") == F.col("h")), "left").select(F.coalesce("new", "id").alias("id"), "text")
    return met, own.select(F.col("new").alias("id"), "doc", "h")


def _narrowed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (id, text) with ids that leave room above them, and these as small and wide; None where the ids do so already.

    New ids are in the order of the old ones.
    """
    if (docs.agg(F.max("id")).first()[0] or 0) < ROOM:
        return docs, None
    ids = docs.where("id is not null").select(F.col("id").alias("wide")).distinct().repartitionByRange("wide").sortWithinPartitions("wide")
    names = cut(ids.withColumn("small", F.monotonically_increasing_id()))
    return docs.join(names, F.col("id") == F.col("wide"), "left").select(F.col("small").alias("id"), "text"), names


def _widened(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    for c in columns if names is not None else ():
        rows = rows.withColumnRenamed(c, "_narrow").join(names, F.col("_narrow") == F.col("small"), "left").drop("_narrow", "small").withColumnRenamed("wide", c)
    return rows


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles (size of the set) and component_id (the smallest key reachable by links, or the own key).

    A null or empty text, and one without words, has an empty set and links with nothing. A text with fewer words than a
    shingle is one shingle. Rows with a null key have a null component and link with nothing; rows with the same key are
    one document with all their links, whatever their texts. Keys are whole numbers, or text that can be cast to them. Extra
    columns, under any name, are left out; an empty table gives no rows.
    """
    docs, names = _narrowed(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    found, own = _components(docs, rule, True)
    doc = F.col("id")
    if own is not None:
        found, doc = found.join(own.select("id", "doc"), "id", "left"), F.coalesce("doc", "id")
    wide = _widened(found.select(doc.alias("_doc"), "n_shingles", "component_id"), names, "_doc", "component_id")
    return wide.select(F.col("_doc").alias(key), "n_shingles", "component_id")


def copies(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and h of the documents that aren't the first of their group, each once.

    The first one has the smallest key among the keys with one text, if there are any in the group. Texts of one key are documents
    of their own: h is the text's text_hash then, else null.
    """
    docs, names = _narrowed(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    found, own = _components(docs, rule, False)
    gone = found.where(F.col("id") != F.col("component_id")).select("id").distinct()
    if own is None:
        return _widened(gone, names, "id").select(F.col("id").alias(key), F.lit(None).cast("long").alias("h"))
    return _widened(gone.join(own, "id", "left").select(F.coalesce("doc", "id").alias("id"), "h"), names, "id").select(F.col("id").alias(key), "h")


def _components(docs: DataFrame, rule: Rule, together: bool) -> tuple[DataFrame, DataFrame | None]:
    """id, n_shingles and component_id of docs (id, text) after _keyed, and its table of new ids.

    together: the texts of one id are connected, by edges to that id.
    """
    key, text = "id", "text"
    docs, own = _keyed(docs)
    named = docs.where(F.col(key).isNotNull())
    about = cut(describe(docs, rule, frequencies(named, rule, text), key, text))
    sets = about.where(F.col("id").isNotNull() & (F.col("n") > 0))
    digest = ["n", "d1", "d2"]
    firsts = cut(sets.groupBy(*digest).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    large = cut(firsts.where(F.col("rows") > LARGE).select(*digest, F.col("first").alias("large")))
    met = sets.select("id", *digest).join(F.broadcast(large) if large.count() <= MANY_LARGE else large, digest, "left")
    few = met.where("large is null").join(firsts.where(F.col("rows") <= LARGE).hint("merge"), digest, "left").select("id", F.coalesce("first", "id").alias("first"))
    same = cut(few.unionByName(met.where("large is not null").select("id", F.col("large").alias("first"))))
    equal = same.where(F.col("id") != F.col("first")).select(F.col("first").alias("u"), F.col("id").alias("v"))
    single = same.where(F.col("id") == F.col("first")).select("id").distinct()
    chosen = cut(sets.drop("tokens").join(single.hint("merge"), "id").dropDuplicates(["id"]))

    # of all sets with one most frequent shingle, the one with the largest share of frequent ones meets the others
    heads = chosen.where(F.col("common").isNotNull()).groupBy(F.col("common").alias("c")).agg(F.max(F.struct("share", (-F.col("id")).alias("m"))).alias("h"), F.count(F.lit(1)).alias("k"), F.min("id").alias("least"))
    heads = F.broadcast(heads.where(F.col("k") > 1))  # of FREQUENT shingles at most, so at most as many rows
    several = chosen.select("id", "n", "sketch", "common").join(heads, F.col("common") == F.col("c"))
    # a head that meets many sets has a row for each HEARD of them; the sets bring their own sketches
    parts = F.ceil(F.col("k") / HEARD)
    each = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    lead = cut(chosen.join(heads, F.col("id") == -F.col("h.m")).select(F.col("id").alias("a"), each, F.col("n").alias("n_a"), F.col("sketch").alias("s_a")))
    star = several.select((-F.col("h.m")).alias("a"), F.pmod(F.xxhash64("id"), parts).alias("part"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    first_links = cut(linked(possible(star.where(F.col("a") != F.col("b")).join(lead, ["a", "part"]), rule), named, rule, key, text))

    # groups of about PACK sets, those connected by now apart from the others; their names are the ids of their first members
    heard = first_links.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("head"))
    near = (F.col("head").isNotNull() | (F.col("id") == -F.col("h.m"))).alias("near")
    sized = several.withColumn("step", F.floor(F.log("n") * SIZE_STEPS))
    crowds = sized.groupBy("c", "step").agg(F.count(F.lit(1)).alias("crowd"))
    met = sized.join(crowds.hint("merge"), ["c", "step"]).join(heard.hint("merge"), "id", "left")
    dealt = met.select("id", "c", "step", near, F.coalesce("head", "id").alias("label"), F.pmod(F.xxhash64("id"), F.ceil(F.col("crowd") / PACK)).alias("chunk"))
    names = dealt.groupBy("c", "step", "near", "chunk").agg(F.min("id").alias("grp"), F.min("label").alias("low"), F.max("label").alias("high"))
    grouped = cut(dealt.join(names, ["c", "step", "near", "chunk"]).select("id", "grp", "label", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(NO_LABEL)).alias("all_label")))
    copies = same.where(F.col("id") != F.col("first")).select("id").distinct().join(chosen.select("id"), "id", "left_anti")
    empty = about.where("id is not null and n = 0").select("id").distinct().join(chosen.select("id"), "id", "left_anti")
    none = F.lit(None).cast("long")
    moved = cut(grouped.select("id", "grp", F.col("all_label").alias("label")).union(copies.union(empty).distinct().select("id", none, none)))

    opened = cut(qualifying(matrix(sets, moved, rule), rule))
    alone = chosen.select("id").join(grouped.select("id"), "id", "left_anti").select("id", F.col("id").alias("grp"), F.col("id").alias("label"))
    member = grouped.select("id", "grp", "label").unionByName(alone)
    second_links = cut(linked(open_groups(opened, member, chosen, rule), named, rule, key, text))
    all_links = reduce(DataFrame.unionByName, [first_links, second_links, equal])
    if own is not None and together:
        all_links = all_links.unionByName(own.select(F.col("doc").alias("u"), F.col("id").alias("v")))
    final = components(all_links)
    counts = about.select("id", F.col("n").alias("n_shingles"))
    return counts.join(final, F.col("id") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")), own
