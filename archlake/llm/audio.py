"""Chroma audio fingerprints of a media column, and their alignment.

A recording is cut into overlapping frames; the energies of a frame's spectrum are summed by pitch class. Filters compare
sums over rectangles of (frame, pitch class), read off an integral image; each gives two bits, sixteen make a packed
integer for every frame.

Recordings are dealt to shards, each an index by value; queries come to every shard. Integers meet by value; counted by offset
they make the offset histogram. Each offset with as many equal integers as a match needs, which a match cannot do without, is then judged by the bits that differ there: the stretch of frames with
the fewest errors for its length must be long enough and within the limit. Copies are one class before anything meets.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.llm.store import cut

PITCHES = 12


@dataclass(frozen=True)
class Settings:
    """Of the frames; filters span 2 to SPAN frames, so that a recording has (frames - SPAN + 1) integers."""

    rate: int = 8000  # of samples without a header
    frame: int = 256
    hop: int = 32
    low: float = 60.0  # Hz
    high: float = 3800.0
    span: int = 16
    step: float = 0.15  # between the outer and the middle bounds of a filter's two bits
    block: int = 1 << 19  # samples worked on at once, of a longer recording too

    @property
    def per_second(self) -> float:
        """Integers of a second."""
        return self.rate / self.hop


@dataclass(frozen=True)
class Match:
    votes: int = 4  # equal integers of a stretch, at least; an offset with fewer can't have one
    seconds: float = 1.0  # of a stretch, at least; or half of the shorter recording
    integers: int = 24  # of a stretch, at least, whatever the recordings' lengths
    bit_errors: float = 0.2  # share of bits that differ in a stretch, at most
    shard: int = 1 << 22  # integers of a shard, about; fewer where there are more cores than shards
    least_shard: int = 1 << 18


def _filters(s: Settings) -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames): 16 rectangles, by rule. Kinds: 0 halves in time, 1 halves in pitch, 2 crossed,
    3 the middle third of the frames against the rest."""
    return [(k % 4, (5 * k) % PITCHES, 2 + 2 * (k % 3), max(3, s.span * (1 + (k * 7) % 4) // 4)) for k in range(16)]


def samples(media: bytes, s: Settings) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and their rate: of a WAV file with 8 to 32 bits, else of raw unsigned bytes at s.rate.

    A WAV file that can't be read counts as raw bytes.
    """
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        try:
            with wave.open(io.BytesIO(media)) as f:
                raw, width, channels, rate = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = raw[: len(raw) // (width * channels) * width * channels]
            if width == 1:
                x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
            else:  # the upper bytes of a little-endian 32-bit number
                wide = np.zeros((len(raw) // width, 4), np.uint8)
                wide[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
                x = wide.view("<i4")[:, 0].astype(np.float32) / np.float32(1 << 31)
            return x.reshape(-1, channels).mean(1), rate
        except (wave.Error, EOFError):
            pass
    return (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128, s.rate


_made: dict[tuple, np.ndarray] = {}


def _classes(rate: int, s: Settings) -> np.ndarray:
    """Spectrum bin x pitch class, 1 where the bin's frequency is of the class."""
    if (rate, s) not in _made:
        hz = np.fft.rfftfreq(s.frame, 1 / rate)
        on = (hz >= s.low) & (hz <= min(s.high, rate / 2))
        at = np.zeros((len(hz), PITCHES), np.float32)
        at[np.flatnonzero(on), np.round(PITCHES * np.log2(hz[on] / 440)).astype(int) % PITCHES] = 1
        _made[rate, s] = at
    return _made[rate, s]


def chroma(x: np.ndarray, rate: int, s: Settings) -> np.ndarray:
    """Frame x pitch class, each frame's energies as shares."""
    if len(x) < s.frame:
        return np.zeros((0, PITCHES))
    window = np.hanning(s.frame).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
    out = np.empty((len(frames), PITCHES))
    for lo in range(0, len(frames), s.block // s.frame):
        spectrum = np.abs(np.fft.rfft(frames[lo : lo + s.block // s.frame] * window)).astype(np.float32)
        out[lo : lo + len(spectrum)] = (spectrum * spectrum) @ _classes(rate, s)
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.full_like(out, 1 / PITCHES), where=total > 1e-9)


def fingerprint(media: bytes, s: Settings = Settings()) -> np.ndarray:
    """Packed integers (uint32), one for each frame that has a whole span after it."""
    x, rate = samples(media, s)
    n = (len(x) - s.frame) // s.hop + 1 - s.span + 1
    if n < 1:
        return np.empty(0, np.uint32)
    each = s.block // s.hop
    return np.concatenate([_integers(x[lo * s.hop : (min(n, lo + each) + s.span - 2) * s.hop + s.frame], rate, s) for lo in range(0, n, each)])


def _integers(x: np.ndarray, rate: int, s: Settings) -> np.ndarray:
    frames = chroma(x, rate, s)
    n = len(frames) - s.span + 1
    image = np.zeros((len(frames) + 1, 2 * PITCHES + 1))  # the pitch circle twice, so that a rectangle can pass its end
    np.cumsum(np.cumsum(np.hstack([frames, frames]), 0), 1, out=image[1:, 1:])
    start = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[start + t1, p1] - image[start + t0, p1] - image[start + t1, p0] + image[start + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, height, width in _filters(s):
        half, mid = width // 2, p + height // 2
        if kind == 0:
            a, b = area(0, half, p, p + height), area(half, 2 * half, p, p + height)
        elif kind == 1:
            a, b = area(0, width, p, mid), area(0, width, mid, p + 2 * (height // 2))
        elif kind == 2:
            a = area(0, half, p, mid) + area(half, 2 * half, mid, p + height)
            b = area(half, 2 * half, p, mid) + area(0, half, mid, p + height)
        else:
            third = width // 3
            a = area(third, 2 * third, p, p + height)
            b = (area(0, third, p, p + height) + area(2 * third, 3 * third, p, p + height)) / 2
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (value > -s.step).astype(np.uint32) + (value > 0) + (value > s.step)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)  # neighbouring levels differ in one bit
    return out


def fingerprints(table: DataFrame, keep: list[str], media: str, s: Settings = Settings()) -> DataFrame:
    """keep, items (the packed integers, little-endian), n_items and content (a digest of media too short for integers).

    Null media is empty, and the content of empty media too.
    """
    made = [T.StructField("items", T.BinaryType()), T.StructField("n_items", T.LongType()), T.StructField("content", T.BinaryType())]
    schema = T.StructType([*[table.schema[c] for c in keep], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got, content = [], []
                for v in part.column(len(keep)).cast(pa.large_binary()):
                    raw = v.as_buffer().to_pybytes() if v.is_valid else b""
                    got.append(fingerprint(raw, s))
                    content.append(hashlib.sha256(raw).digest() if raw and not len(got[-1]) else b"")
                items = pa.array([g.astype("<u4").tobytes() for g in got], pa.binary())
                yield pa.record_batch(
                    [*part.columns[: len(keep)], items, pa.array([len(g) for g in got], pa.int64()), pa.array(content, pa.binary())], names=schema.names
                )

    return table.select(*keep, F.col(media).cast("binary")).mapInArrow(run, schema)


def turns(items: np.ndarray) -> np.ndarray:
    """Places of integers that differ from the one before; only these vote, so that silence and held notes don't."""
    return np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))) if len(items) else np.empty(0, np.int64)


def stretches(query: np.ndarray, items: np.ndarray, offsets: list[int], s: Settings, m: Match) -> list[tuple[int, int, int, int, int]]:
    """(offset, start in the query, votes, overlap, bit errors) of the aligned stretches, the best one first.

    At each offset the stretch is taken whose errors stay the furthest below the limit. Of stretches that overlap in the query the
    better one stays; of equal ones that with the smaller offset in size, then the negative one.
    """
    turn = np.zeros(len(query), bool)
    turn[turns(query)] = True
    least = max(m.integers, min(m.seconds * s.per_second, min(len(query), len(items)) / 2))
    limit, found = round(m.bit_errors * 32 * GAIN), []
    for offset in offsets:
        a, b = max(0, -offset), max(0, offset)
        n = min(len(query) - a, len(items) - b)
        if n < least:
            continue
        wrong = np.bitwise_count(query[a : a + n] ^ items[b : b + n])
        gain = np.concatenate(([0], np.cumsum(limit - GAIN * wrong.astype(np.int64))))
        end = int(np.argmax(gain - np.minimum.accumulate(gain)))
        start = int(np.argmin(gain[: end + 1]))
        votes = int((turn[a + start : a + end] & (wrong[start:end] == 0)).sum())
        if end - start >= least and votes >= m.votes:
            found.append((gain[end] - gain[start], offset, a + start, votes, end - start, int(wrong[start:end].sum())))
    out: list[tuple[int, int, int, int, int]] = []
    for _, *one in sorted(found, key=lambda x: (-x[0], abs(x[1]), x[1])):
        if all(one[1] >= o[1] + o[3] or o[1] >= one[1] + one[3] for o in out):
            out.append(tuple(one))
    return out


#: Parts of a bit in which gains are counted, so that they are whole numbers.
GAIN = 1000

#: Votes, or counters of votes, that a task holds at once; integers of overlaps that are judged at once.
HELD_VOTES, HELD_OVERLAP = 1 << 22, 1 << 21


class Shard:
    """Recordings, and where each of their turns stands, by value."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.items = ids, items
        places = [turns(x) for x in items]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in places])))  # of the postings by owner
        self.raw_place = np.concatenate(places)
        self.raw_value = np.concatenate([x[at] for x, at in zip(items, places, strict=True)])
        order = np.argsort(self.raw_value, kind="stable")
        self.value, self.place = self.raw_value[order], self.raw_place[order]
        self.owner = np.repeat(np.arange(len(items), dtype=np.int64), np.diff(self.first))[order]
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in items])))
        self.all = np.concatenate(items)

    def align(self, own: int, query: np.ndarray, s: Settings, m: Match) -> Iterator[tuple]:
        """(other, offset, start, votes, overlap, bit errors) of all stretches with recordings of another id."""
        at = turns(query)
        value = query[at]
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        least = np.maximum(m.integers, np.minimum(m.seconds * s.per_second, np.minimum(len(query), np.diff(self.start)) / 2))
        met = self._few(at, lo, hi, m) if int((hi - lo).sum()) <= HELD_VOTES else self._many(at, value, len(query), m)
        for owner, offset in met:
            keep = self._long(query, owner, offset, least, m)
            owner, offset = owner[keep], offset[keep]
            edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                k = int(owner[a])
                if self.ids[k] != own:
                    for one in stretches(query, self.items[k], offset[a:b].tolist(), s, m):
                        yield self.ids[k], *one

    def _few(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: Match) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(owners, offsets) with enough votes, by owner and offset; all votes are held at once."""
        n = hi - lo
        into = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shift, width = np.int64(1 << 31), np.int64(1 << 32)
        names = np.sort(self.owner[into] * width + self.place[into] - np.repeat(at, n) + shift)
        same = m.votes - 1  # as many names further on there's the same name
        enough = names[same:][names[same:] == names[: len(names) - same]] if len(names) > same else names[:0]
        enough = enough[np.concatenate(([True], enough[1:] != enough[:-1]))] if len(enough) else enough
        yield enough // width, enough % width - shift

    def _many(self, at: np.ndarray, value: np.ndarray, size: int, m: Match) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for a query with very many votes: a few owners at a time, whose offsets have a counter each."""
        lengths = np.diff(self.start)
        k = 0
        while k < len(self.items):
            upto = max(k + 1, int(np.searchsorted(np.cumsum(lengths[k:] + size), HELD_VOTES, "right")) + k)
            part = slice(int(self.first[k]), int(self.first[upto]))
            order = np.argsort(self.raw_value[part], kind="stable")
            own_value = self.raw_value[part][order]
            base = np.concatenate(([0], np.cumsum(lengths[k:upto] + size)))  # of an owner's counters: place - at + size
            slot = (self.raw_place[part] + np.repeat(base[:-1], np.diff(self.first[k : upto + 1])) + size)[order]
            counts = np.zeros(int(base[-1]) + 1, np.int64)
            lo, hi = np.searchsorted(own_value, value, "left"), np.searchsorted(own_value, value, "right")
            for v in np.unique(value[hi > lo]):  # one value's votes are a product of its places
                mine, theirs = at[value == v], slot[np.searchsorted(own_value, v, "left") : np.searchsorted(own_value, v, "right")]
                for a in range(0, len(mine), max(1, HELD_VOTES // len(theirs))):
                    np.add.at(counts, (theirs[None, :] - mine[a : a + max(1, HELD_VOTES // len(theirs)), None]).ravel(), 1)
            enough = np.flatnonzero(counts >= m.votes)
            owner = np.searchsorted(base, enough, "right") - 1
            yield owner + k, enough - base[owner] - size
            k = upto

    def _long(self, query: np.ndarray, owner: np.ndarray, offset: np.ndarray, least: np.ndarray, m: Match) -> np.ndarray:
        """Which offsets have a best stretch that is long enough: what stretches() asks first, for many offsets at once."""
        a, b = np.maximum(0, -offset), np.maximum(0, offset)
        n = np.minimum(len(query) - a, np.diff(self.start)[owner] - b)
        keep = n >= least[owner]
        todo = np.flatnonzero(keep)
        ends = np.cumsum(n[todo])
        limit = round(m.bit_errors * 32 * GAIN)
        done = 0
        while done < len(todo):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HELD_OVERLAP, "right")))
            some = todo[done:upto]
            size = n[some]
            first = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(first, size)
            wrong = np.bitwise_count(query[np.repeat(a[some], size) + step] ^ self.all[np.repeat(self.start[owner[some]] + b[some], size) + step])
            # sums before each place and at the end of each overlap, overlap below overlap, so that no minimum comes from the one before
            each = np.concatenate(([0], np.cumsum(limit - GAIN * wrong.astype(np.int64))))
            row = np.repeat(np.arange(len(some)), size + 1)
            into = np.arange(len(row)) - row
            deep = np.int64((limit + 32 * GAIN) * (int(size.max()) + 1))
            gain = each[into] - np.repeat(each[first], size + 1) - row * 2 * deep
            rise = gain - np.minimum.accumulate(gain)
            at = first + np.arange(len(some))
            top = np.maximum.reduceat(rise, at)
            end = np.flatnonzero(rise == np.repeat(top, size + 1))
            end = end[np.concatenate(([True], row[end][1:] != row[end][:-1]))]  # the first place of the greatest rise
            low = gain[end] - top
            # the first place of the minimum up to the end
            is_low = (gain == np.repeat(low, size + 1)) & (np.arange(len(row)) <= np.repeat(end, size + 1))
            start = np.flatnonzero(is_low)
            start = start[np.concatenate(([True], row[start][1:] != row[start][:-1]))]
            keep[some] = end - start >= least[owner[some]]
            done = upto
        return keep


def aligned(heads: DataFrame, s: Settings, m: Match) -> DataFrame:
    """The stretches of all queries among heads (id, items, n_items, asked) with all other heads, as rows of kind 'match'.

    Recordings go to shards of a bounded number of integers (one longer recording is a shard's, too); a query is sent to every shard.
    """
    total = heads.agg(F.coalesce(F.sum("n_items"), F.lit(0))).first()[0]
    each = min(m.shard, max(m.least_shard, -(-total // heads.sparkSession.sparkContext.defaultParallelism)))
    shards = max(1, -(-total // each))
    index = heads.select(F.pmod(F.xxhash64("id", "items"), F.lit(shards)).cast("int").alias("n"), F.lit(False).alias("asks"), "id", "items")
    asked = heads.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("n"), F.lit(True).alias("asks"), "id", "items")
    dealt = index.unionByName(asked).repartition(shards, "n").sortWithinPartitions("n", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, ids, held = None, None, [], []
        for batch in batches:
            out = []
            for n, asks, own, items in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if n != name:
                    name, shard, ids, held = n, None, [], []
                items = np.frombuffer(items, "<u4")
                if not asks:
                    ids.append(own)
                    held.append(items)
                elif ids:
                    shard = shard or Shard(ids, held)
                    out += [(own, other, len(items), *rest) for other, *rest in shard.align(own, items, s, m)]
            if out:
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.record_batch([pa.array(["match"] * len(out)), *cols], names=["kind", "id", "other", "items", *MEASURES])

    return dealt.mapInArrow(run, "kind string, id long, other long, items long, " + ", ".join(f"{c} long" for c in MEASURES))


MEASURES = ("offset", "start", "votes", "overlap", "bit_errors")

#: Classes of more rows than LARGE are sent to all tasks, if they are MANY_LARGE at most.
LARGE, MANY_LARGE = 1024, 1 << 16


def align(table: DataFrame, is_query: str | Column, key: str, media: str, s: Settings = Settings(), m: Match = Match()) -> DataFrame:
    """Fingerprint all recordings and align those of rows with is_query (a condition on the table's columns) with all others.

    kind 'recording': a row of the table: id, other (the smallest id of the rows with the same integers, or without any the same bytes: the
    class it is in), items (their number); other columns null. kind 'match': id (class of a query row), other (another class), items
    (the query's), offset (the other's place minus the query's), start (of the stretch, in the query), votes, overlap (integers of the
    stretch), bit_errors. Classes stand for all their rows, so that copies aren't multiplied; every aligned pair of classes is there,
    in both directions where both have query rows, and with each of its stretches.

    Recordings that are too short for integers match nothing, and exact copies of them are a class; null and empty ones are another
    class. Recordings with fewer than `integers` integers match nothing, too. Rows with a null key take no part; of a repeated key
    each row is listed, and of one with several media each is aligned. Keys are whole numbers, or text that can be cast to them.
    Extra columns, under any name, are left out. An empty table gives no rows.
    """
    asks = F.expr(is_query) if isinstance(is_query, str) else is_query
    named = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(media).alias("media"))
    made = fingerprints(named, ["id", "asks"], "media", s).withColumns({"h": F.xxhash64("items", "content"), "h2": F.crc32(F.concat("items", "content"))})
    made = cut(made.drop("content"))
    same = ["n_items", "h", "h2"]
    first = cut(made.groupBy(*same).agg(F.min("id").alias("first"), F.max("asks").alias("asked"), F.count(F.lit(1)).alias("rows")))
    large = cut(first.where(F.col("rows") > LARGE).select(*same, F.col("first").alias("large")))
    bare = made.select("id", *same).join(F.broadcast(large) if large.count() <= MANY_LARGE else large, same, "left")
    rows = bare.where("large is not null").selectExpr("id", "large as other", "n_items")
    rest = first.where(F.col("rows") <= LARGE).select(*same, "first")
    rows = rows.unionByName(bare.where("large is null").join(rest, same).selectExpr("id", "first as other", "n_items"))
    none = [F.lit(None).cast("long").alias(c) for c in MEASURES]
    listed = rows.select(F.lit("recording").alias("kind"), "id", "other", F.col("n_items").alias("items"), *none)
    heads = made.join(first.where("n_items > 0").select("first", F.col("h").alias("hh"), F.col("h2").alias("hh2"), "asked"), (F.col("id") == F.col("first")) & (F.col("h") == F.col("hh")) & (F.col("h2") == F.col("hh2")))
    heads = cut(heads.dropDuplicates(["id", "h", "h2"]).select("id", "items", "n_items", "asked"))
    return listed.unionByName(aligned(heads, s, m))
