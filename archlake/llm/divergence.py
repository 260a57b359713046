"""How far the sources of a language are apart in their words, by a frequent-pattern tree of term rows.

A term's row is the list of sources that use it, each with its smoothed share, in the order of sources; rows that are alike are
one row with a multiplicity. Sorted rows form a tree: rows that begin alike share a path. The distance of two sources over all
terms of the vocabulary is what it would be if neither used any term, plus a correction for each term that one uses, plus one
for each term that both use. The last ones are pairs of a node and an ancestor in the tree, and each such pair is worked out
once, times the rows below the node, however many terms share it. Everything is whole numbers, so that sums are exact.

Rows are dealt to tasks by ranges of their order: each task has trees of its own, one for a batch of rows, a path at a border
is in two of them. Which tree a row is in changes how often a pair is met, but not the sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.llm.skew import attach
from archlake.llm.store import cut

#: What a term is made of: no control sign, blank, digit or punctuation of ASCII.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Characters of a text that are split at once; counts and pairs of sources that a task holds before it passes them on.
BLOCK, HELD_TERMS, HELD_PAIRS = 1 << 20, 600_000, 1 << 22

#: A share is 1 + floor(UNIT * (count + EXTRA) / (all + EXTRA * terms)).
UNIT, EXTRA = 1_000_000_000, 5


def terms(text: str) -> Iterator[list[str]]:
    """The terms of a text, block by block; no term is cut."""
    lo = 0
    while lo < len(text):
        hi = lo + BLOCK
        if hi < len(text):
            end = NO_TERM.search(text, hi)
            hi = end.start() if end else len(text)
        block = text[lo:hi]
        yield TERM.findall(block.lower() if block.isascii() else block.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))
        lo = hi


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, occurrences, documents) of a task's texts; a row without a term for each lang and source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in held.items():
            n = len(occurrences) + 1
            columns = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array([None, *occurrences], pa.string()), pa.array([0, *occurrences.values()], pa.int64()), pa.array([0, *[documents[t] for t in occurrences]], pa.int64())]
            yield pa.record_batch(columns, names=["lang", "source", "term", "occurrences", "documents"])
        held.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            lang, source, text = (batch.column(c)[i].as_py() for c in range(3))
            occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[str] = set()
            size -= len(occurrences)
            for found in terms(text):
                occurrences.update(found)
                seen.update(found)
            documents.update(seen)
            size += len(occurrences)
            if size >= HELD_TERMS:
                yield from rows()
                size = 0
    yield from rows()


def tree_pairs(place: np.ndarray, share: np.ndarray, none: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and the sum of corrections of all pairs of a node and an ancestor in the frequent-pattern tree of sorted paths.

    Path r is the elements starts[r] to starts[r + 1] (place: sources in ascending order; share: that of this term there; none:
    that of a term without occurrences), for rows[r] terms. It shares its first nodes with the path before and adds the others;
    the rows below a node are those up to the next path that leaves it. The tree is read level by level.
    """
    size = np.diff(starts)
    at = np.repeat(np.arange(len(size)), size)
    depth = np.arange(starts[0], starts[-1]) - starts[at]
    before = np.where((at > 0) & (depth < size[at - 1]), starts[at - 1] + depth, -1)
    mine = np.arange(starts[0], starts[-1])
    apart = (before < 0) | (place[mine] != place[before]) | (share[mine] != share[before])
    shared = size.copy()
    np.minimum.at(shared, at[apart], depth[apart])
    below = np.concatenate([[0], np.cumsum(rows)])
    for d in range(1, int(size.max(initial=0))):
        left = np.flatnonzero(shared <= d)  # here the node of this level is left
        count = np.diff(np.append(below[left], below[-1]))
        deep = size[left] > d
        new, count = left[deep], count[deep]
        for lo in range(0, len(new), max(1, HELD_PAIRS // d)):
            first, n = starts[new[lo : lo + max(1, HELD_PAIRS // d)]], count[lo : lo + max(1, HELD_PAIRS // d), None]
            above = first[:, None] + np.arange(d)
            theirs, zeros = share[above], none[above]
            own, zero = share[first + d][:, None], none[first + d][:, None]
            gain = (np.abs(theirs - own) - np.abs(theirs - zero) - np.abs(zeros - own) + np.abs(zeros - zero)) * n
            yield _summed(place[above].ravel(), np.repeat(place[first + d], d), gain.ravel())


def _summed(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with its sum."""
    order = np.lexsort((i, j))
    i, j, v = i[order], j[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[: len(i)])
    return i[first], j[first], np.add.reduceat(v, first) if len(first) else v


class Tree:
    """Frequent-pattern trees of sorted paths, which come one by one or many at once, and the corrections of their pairs so far."""

    def __init__(self) -> None:
        self.waiting: list[tuple] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def insert(self, place: np.ndarray, share: np.ndarray, none: np.ndarray, rows: int) -> None:
        self.waiting.append((place, share, none, rows))

    def leave(self, _: int) -> None:
        """Leave all nodes: the paths inserted so far are a tree."""
        if self.waiting:
            *columns, rows = zip(*self.waiting, strict=True)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in columns[0]])])
            self.waiting = []
            self.read(*[np.concatenate(c) for c in columns], starts, np.array(rows, np.int64))

    def read(self, place: np.ndarray, share: np.ndarray, none: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
        """A tree of many paths (see tree_pairs)."""
        for pairs in tree_pairs(place, share, none, starts, rows):
            self.held.append(pairs)
            self.size += len(pairs[0])
            if self.size >= HELD_PAIRS:
                self.held = [_summed(*[np.concatenate(x) for x in zip(*self.held, strict=True)])]
                self.size = 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i, j and the sum of corrections of the pairs met so far, which are forgotten."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        i, j, v = _summed(*[np.concatenate(x) for x in zip(*self.held, strict=True)])
        self.held, self.size = [], 0
        return i[v != 0], j[v != 0], v[v != 0]


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, i, j, v), i below j, from sorted rows (lang, path of (place, share, none), n); each batch and language is a tree."""
    tree, lang = Tree(), None

    def found() -> Iterator[pa.RecordBatch]:
        i, j, v = tree.pairs()
        if len(i):
            yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(i)), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.int64())], names=["lang", "i", "j", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        langs, counts = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
        paths = batch.column(1)
        starts = paths.offsets.to_numpy().astype(np.int64) - paths.offsets[0].as_py()
        place, share, none = (x.to_numpy(zero_copy_only=False) for x in paths.flatten().flatten())
        borders = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
        for lo, hi in zip(borders, borders[1:], strict=False):
            if langs[lo] != lang:
                yield from found()
                lang = langs[lo]
            tree.read(place, share, none, starts[lo : hi + 1], counts[lo:hi])
        if tree.size >= HELD_PAIRS // 4:
            yield from found()
    yield from found()


def _single(used, others):  # pandas frames; tasks load pandas, the driver does without
    """Corrections of one source towards each other one, for terms that it uses and the other doesn't.

    used: share and n of its terms, none of itself; others: j and zero, the share of an unused term there. The sums over
    shares below and above `zero` come from running totals.
    """
    import pandas as pd

    if not len(used) or not len(others):
        return pd.DataFrame({"lang": pd.Series([], dtype=object), "i": [], "j": [], "v": []})
    used = used.sort_values("share")
    share, n = used["share"].to_numpy(np.int64), used["n"].to_numpy(np.int64)
    none = int(used["none"].iloc[0])
    zero = others["zero"].to_numpy(np.int64)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * share)])
    at = np.searchsorted(share, zero)
    apart = zero * count[at] - total[at] + (total[-1] - total[at]) - zero * (count[-1] - count[at])
    v = apart - np.abs(none - zero) * count[-1]
    return pd.DataFrame({"lang": pd.Series(others["lang"].tolist(), dtype=object), "i": others["i"].to_numpy(), "j": others["j"].to_numpy(), "v": v})


def _share(count: str, total: str) -> str:
    """Exact for any bigint: the product has 29 digits at most."""
    return f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + {EXTRA} as decimal(19,0))) div cast({total} + {EXTRA} * vocabulary as decimal(19,0))"


def audit(docs: DataFrame, least_documents: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters (and of anything beyond ASCII), A-Z lower-cased; a language keeps those in at least
    `least_documents` of its rows. Shares are 1 + floor(1e9 * (count + 5) / (all + 5 * terms)). Part 'pair': each other source
    of the language and the sum over kept terms of the difference of shares; part 'term': the `top` terms that the source
    uses and whose share is above the language's, with the difference. Ranks are by value, the greatest first, then by item.

    Null text, lang and source count as ''. Rows are documents of their own, also if they repeat. A language without kept terms
    has pairs of value 0; a language with one source has no pairs. An empty table gives no rows; extra columns, under any
    name, are left out. The result has a row for each ordered pair of sources of a language, so that thousands of sources a
    language are fine, and millions aren't.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    seen = plain.mapInArrow(count_terms, "lang string, source string, term string, occurrences long, documents long")
    counts = cut(seen.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("n"), F.sum("documents").alias("documents")))
    together = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("each"))
    rows = cut(together.where(F.col("documents") >= least_documents).select("lang", "term", "all_n", F.explode("each").alias("e")).select("lang", "term", "all_n", "e.*"))

    langs = rows.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("lang_n"))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("source_n"))
    order = Window.partitionBy("lang").orderBy(F.desc("terms"), "source")  # a row for each source
    groups = (
        counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["terms", "source_n", "vocabulary", "lang_n"]).withColumn("place", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("none", F.expr(f"case when vocabulary > 0 then {_share('0', 'source_n')} else 0 end"))
    )
    groups = cut(groups)
    shares = attach(rows, groups, ["lang", "source"], "terms", F.xxhash64("term")).select(
        "lang", "source", "term", "place", "none", F.expr(_share("n", "source_n")).alias("share"), F.expr(_share("all_n", "lang_n")).alias("lang_share")
    )
    shares = cut(shares)

    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "share", "none"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = paths.mapInArrow(shared_terms, "lang string, i long, j long, v long")
    left = groups.select("lang", F.col("source"), F.col("place").alias("i"), F.col("none").alias("own"), "vocabulary")
    right = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("j"), F.col("none").alias("zero"))
    pairs = cut(left.join(right, "lang").where("i <> j"))  # as many rows as the result has
    used = shares.groupBy("lang", F.col("place").alias("i"), "share", "none").agg(F.count(F.lit(1)).alias("n"))
    single = used.groupBy("lang", "i").cogroup(pairs.select("lang", "i", "j", "zero").groupBy("lang", "i")).applyInPandas(_single, "lang string, i long, j long, v long")
    found = both.unionByName(single)
    found = found.unionByName(found.select("lang", F.col("i").alias("j"), F.col("j").alias("i"), "v")).groupBy("lang", "i", "j").agg(F.sum("v").alias("v"))
    value = F.col("vocabulary") * F.abs(F.col("own") - F.col("zero")) + F.coalesce("v", F.lit(0))
    apart = pairs.join(found, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    words = shares.where("share > lang_share").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    return apart.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= top))
