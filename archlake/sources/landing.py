"""Inventory, landing and verification of archives: ZIP files of CSV members below a root that Spark can read.

Archives are listed without their contents. Landing opens the wanted ones in tasks, by path, and reads members as a stream: a
block of text at a time is decompressed, cut into lines and cells by Arrow, and handed on, so that a task's memory doesn't grow
with an archive. Where Python has no file system for a path, Spark reads the file whole instead, up to Spark's limit of 2 GB.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.functions import exprs as E

#: Rows between two chunk borders of an archive; ordered checks run chunk by chunk.
CHUNK_ROWS = 1 << 18

RAW_SCHEMA = (
    "path string, member string, member_idx int, member_size long, row_number long, ordinal long, chunk_id long, cells array<string>, csv_members int, error string"
)

#: Bytes of text that are cut into lines at once, and the longest line.
BLOCK, LONGEST_LINE = 4 << 20, 64 << 20

#: Rows of a batch where quotes make lines depend on each other.
_BATCH_ROWS = 65_536

#: Rows from which a batch isn't put together with others.
_SMALL_ROWS = 4096

#: Archives that one task opens, in bytes and in files; opening one counts as 4 MB.
TASK_BYTES, OPEN_COST = 128 << 20, 4 << 20

#: What Spark reads as one value.
WHOLE_LIMIT = (1 << 31) - (1 << 16)


def files(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def relative(path: Column) -> Column:
    """The part of a path from the layout's first folder on."""
    return F.regexp_extract(path, r"(raw/futures/um/.*)$", 1)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, file (its place), length, modified and the parts of the path of all archives; contents aren't read."""
    found = files(spark, root).select(F.col("path").alias("file"), relative(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))
    return found.select("*", *[v.alias(k) for k, v in E.parse_path(F.col("path")).items()])


def _cells(lines: pa.Array) -> pa.Array:
    """The cells of lines without quotes; a blank line has none."""
    cells = pc.split_pattern(lines, ",")
    blank = pc.equal(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    if not blank.any():
        return cells
    kept = cells.filter(pa.array(~blank))
    sizes = np.zeros(len(blank), np.int64)
    sizes[~blank] = np.diff(kept.offsets.to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), kept.flatten())


def _rows(raw: BinaryIO, block: int) -> Iterator[pa.Array]:
    """Cells of a member's rows, about a block of text at a time. Text with quotes is left to the csv module from there on."""
    rest, first = b"", True
    while True:
        got = raw.read(block)
        data, rest = rest + got, b""
        if first:
            data, first = data.removeprefix(b"\xef\xbb\xbf"), False
        if b'"' in data:
            yield from _quoted(data, raw)
            return
        if got:  # only whole lines; a \r at the end may be half of a line's end
            end = max(data.rfind(b"\n"), data.rfind(b"\r", 0, len(data) - 1)) + 1
            data, rest = data[:end], data[end:]
            if len(rest) > LONGEST_LINE:
                raise ValueError("a line is too long")
        if data:
            text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
            lines = pc.split_pattern(pa.array([text.removesuffix("\n")], pa.large_string()), "\n").flatten()
            yield _cells(lines.cast(pa.string()))
        if not got:
            return


class _After(io.RawIOBase):
    """A stream that begins with bytes that were read before."""

    def __init__(self, head: bytes, tail: BinaryIO):
        self.head, self.tail = head, tail

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        if self.head:
            got, self.head = self.head[: len(to)], self.head[len(to) :]
        else:
            got = self.tail.read(len(to))
        to[: len(got)] = got
        return len(got)


def _quoted(head: bytes, tail: BinaryIO) -> Iterator[pa.Array]:
    waiting = []
    kind = pa.list_(pa.string())
    for cells in csv.reader(io.TextIOWrapper(io.BufferedReader(_After(head, tail)), encoding="utf-8", newline="")):
        waiting.append(cells)
        if len(waiting) == _BATCH_ROWS:
            yield pa.array(waiting, kind)
            waiting = []
    if waiting:
        yield pa.array(waiting, kind)


def _blocks(opened: BinaryIO, block: int, texts: tuple[str, ...]) -> Iterator[tuple]:
    """(member, position, size, first row number, rows' cells, CSV members, error) of an archive, block by block.

    Members named in texts come whole, as one row of one cell. What goes wrong is a last row with an error and no cells, after
    the rows that could be read; so is an archive without rows.
    """
    count, any_rows, error = 0, False, None
    try:
        with zipfile.ZipFile(opened) as archive:
            members = [n for n in archive.namelist() if n.lower().endswith(".csv")]
            count = len(members)
            if not members:
                error = "no CSV member"
            for at, name in enumerate(members):
                size, number = archive.getinfo(name).file_size, 1
                with archive.open(name) as raw:
                    for cells in _rows(raw, block):
                        yield name, at, size, number, cells, count, None
                        number, any_rows = number + len(cells), True
            for name in [n for n in archive.namelist() if n in texts]:
                if archive.getinfo(name).file_size > LONGEST_LINE:
                    raise ValueError(f"{name} is too long")
                text = archive.read(name).decode("utf-8")
                yield name, None, len(text), 1, pa.array([[text]], pa.list_(pa.string())), count, None
    except zipfile.BadZipFile as e:
        error = f"bad member: {e}" if count else "not a ZIP file"
    except (OSError, EOFError, ValueError, csv.Error, zlib.error, NotImplementedError, RuntimeError) as e:
        error = f"{type(e).__name__}: {e}"
    if error or not any_rows:
        yield None, None, None, 1, None, count, error


class _Opened(io.RawIOBase):
    """A file of Arrow's as Python's zipfile expects it: a place before the start is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.file.tell() if whence == 1 else 0, self.size)[whence]
        if at < 0:
            raise OSError("a place before the start")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, to) -> int:
        got = self.file.read(len(to))
        to[: len(got)] = got
        return len(got)


def _batches(path: str, opened: pa.NativeFile, block: int, texts: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.string()]
    names = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
    done = 0
    for member, at, size, number, cells, count, error in _blocks(io.BufferedReader(_Opened(opened), 1 << 20), block, texts):
        n = 1 if cells is None else len(cells)
        if cells is None:
            spans = [pa.nulls(1, pa.int64())] * 3
        else:
            spans = [pa.array(np.arange(x, x + n)) for x in (number, done)] + [pa.array(np.arange(done, done + n) // CHUNK_ROWS)]
        made = [path, member, at, size, *spans, pa.nulls(1, kinds[7]) if cells is None else cells, count, error]
        yield pa.record_batch([x if isinstance(x, pa.Array) else pa.repeat(pa.scalar(x, k), n) for x, k in zip(made, kinds, strict=True)], names=names)
        done += 0 if cells is None else n


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with small batches put together, as each batch costs Spark some time."""
    waiting: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _SMALL_ROWS or size >= BLOCK:
            yield from _together(waiting)
            waiting, rows, size = [], 0, 0
    yield from _together(waiting)


def _together(some: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return some if len(some) < 2 else pa.Table.from_batches(some).combine_chunks().to_batches()


def land(archives: DataFrame, block: int = BLOCK, texts: tuple[str, ...] = ()) -> DataFrame:
    """Raw rows of all CSV members (A2) and a row with an error for an archive that can't be read to its end (A4).

    archives: binaryFile rows (path, content). Rows hold the cells as text, the member's position, the row's number in it
    (1-based, headings and blank rows count) and its ordinal in the archive. One archive is one task's work, as its
    compression can't be split; rows leave it in batches. texts: names of members that come whole, as one row without a
    position (member_idx null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(path.as_py(), pa.BufferReader(content.as_buffer() or b""), block, texts)

    return archives.select("path", "content").mapInArrow(lambda batches: _gathered(run(batches)), RAW_SCHEMA)


def opener(file: str) -> tuple[fs.FileSystem, str]:
    """Python's file system for a place as Spark names it, and the path there; ValueError or OSError if there is none."""
    scheme, _, rest = file.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or file).lstrip("/")
    authority, _, inner = rest.removeprefix("//").partition("/")
    found, base = fs.FileSystem.from_uri(f"{scheme}://{quote(authority, safe=':@,.-_')}/x")
    return found, base.removesuffix("x") + inner


def opens(file: str) -> bool:
    """Whether tasks can open files there by themselves."""
    try:
        opener(file)
    except (ValueError, OSError, pa.ArrowException):
        return False
    return True


def land_by_path(chosen: DataFrame, block: int = BLOCK, texts: tuple[str, ...] = ()) -> DataFrame:
    """land() for rows with the place of a `file` that tasks open by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = opener(file)
                with system.open_input_file(path) as opened:
                    yield from _batches(file, opened, block, texts)

    return chosen.select("file").mapInArrow(lambda batches: _gathered(run(batches)), RAW_SCHEMA)


def land_files(spark: SparkSession, chosen: DataFrame, block: int = BLOCK, by_path: bool | None = None) -> DataFrame:
    """land() for inventory rows (file, length), which are opened by path in as many tasks as their bytes ask for (A2).

    by_path: None finds out whether Python can open them; False has Spark read them whole, so that a file beyond
    WHOLE_LIMIT has an error instead of rows.
    """
    total = chosen.agg(F.sum(F.col("length") + OPEN_COST).alias("bytes"), F.first("file").alias("one"), F.count(F.lit(1)).alias("files")).first()
    if total["one"] is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    if opens(total["one"]) if by_path is None else by_path:
        # a few large archives are a task each: by ranges, as hashes would put some of them together
        tasks = max(int(-(-total["bytes"] // TASK_BYTES)), min(total["files"], spark.sparkContext.defaultParallelism))
        return land_by_path(chosen.repartitionByRange(tasks, "file"), block)
    small = [r["file"] for r in chosen.where(F.col("length") <= WHOLE_LIMIT).select("file").collect()]
    shape = [c.split(" ") for c in RAW_SCHEMA.split(", ")]
    given = {"path": F.col("file"), "csv_members": F.lit(0), "error": F.lit("too large for one value")}
    large = chosen.where(F.col("length") > WHOLE_LIMIT).select(*[given.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in shape])
    return land(spark.read.format("binaryFile").load(small), block).unionByName(large) if small else large


def land_lake(spark: SparkSession, root: str, paths: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of the archives below root, or of those among them whose `path` is in paths, with the parts of their paths."""
    found = inventory(spark, root)
    chosen = found if paths is None else found.join(paths.select("path").distinct(), "path", "left_semi")
    return with_keys(land_files(spark, chosen, block))


def with_keys(raw: DataFrame) -> DataFrame:
    named = raw.withColumnRenamed("path", "file").withColumn("path", relative(F.col("file")))
    parts = E.parse_path(F.col("path"))
    return named.select("*", *[v.alias(k) for k, v in parts.items()], F.substring(parts["key"], 1, 7).alias("month"))


def new_file(root: str, path: str) -> pa.NativeFile:
    """A stream that writes a file below root, in folders that it makes."""
    system, place = opener(f"{root.rstrip('/')}/{path}")
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place)


def put(archives: DataFrame, root: str) -> DataFrame:
    """Write archives (path below root, content) where tasks can open files; returns path and length. What a fetch step may do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                with new_file(root, path) as out:
                    out.write(data)
                sizes.append(data.size)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "length"])

    return archives.select("path", "content").mapInArrow(run, "path string, length long")


def copied(paths: DataFrame, source: str, root: str) -> DataFrame:
    """Copy the files of `path` from below source to below root, a part at a time, so that large ones are no task's memory;
    returns path and length. What a fetch step may do where archives are files already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path in batch.column(0).to_pylist():
                system, place = opener(f"{source.rstrip('/')}/{path}")
                with system.open_input_stream(place) as read, new_file(root, path) as out:
                    while data := read.read(BLOCK):
                        out.write(data)
                    sizes.append(out.tell())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "length"])

    return paths.select("path").repartition("path").mapInArrow(run, "path string, length long")


def write_landed(raw: DataFrame, to: str) -> None:
    """Landed rows as Parquet, one folder per family, symbol and month of the archive's key."""
    raw.write.mode("append").partitionBy("dataset", "symbol", "month").parquet(to)


def raw_rows(landed: DataFrame) -> DataFrame:
    return landed.where(F.col("cells").isNotNull() & (F.size("cells") > 0))


def largest_member(landed: DataFrame) -> DataFrame:
    """Rows of each archive's largest CSV member only (A3); of equally large ones the first."""
    best = landed.where("member is not null").groupBy("path").agg(F.max(F.struct("member_size", (-F.col("member_idx")).alias("m"))).alias("best")).select("path", (-F.col("best.m")).alias("member_idx"))
    return landed.join(best, ["path", "member_idx"], "left_semi")


def archive_status(landed: DataFrame) -> DataFrame:
    """Per archive: rows, csv_members, error and valid_zip (A4). An archive without rows is an error, too."""
    seen = landed.groupBy("path").agg(
        F.count_if(F.col("cells").isNotNull() & (F.size("cells") > 0)).alias("rows"), F.max("csv_members").alias("csv_members"), F.max("error").alias("error")
    )
    return seen.select(
        "path",
        "rows",
        "csv_members",
        F.coalesce("error", F.when(F.col("rows") == 0, F.lit("no rows"))).alias("error"),
        (F.coalesce("error", F.lit("")) != "not a ZIP file").alias("valid_zip"),
    )


def digests(archives: DataFrame) -> DataFrame:
    """path, length and sha256 of binaryFile rows (A5)."""
    return archives.select("path", "length", F.sha2("content", 256).alias("sha256"))


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """path of the archive and the digest that its .CHECKSUM file names."""
    found = files(spark, root, "*.CHECKSUM").select(F.regexp_replace("path", r"\.CHECKSUM$", "").alias("path"), F.col("content").cast("string").alias("text"))
    return checksum_texts(found)


def checksum_texts(found: DataFrame) -> DataFrame:
    """path and the digest that the text of its checksum file begins with."""
    return found.select("path", F.lower(F.element_at(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1)).alias("expected"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Archives with 'ok', 'mismatch' or 'checksum missing' (A6, C11)."""
    met = found.join(expected, "path", "left")
    missing = F.col("expected").isNull() | (F.col("expected") == "")
    return met.withColumn("verdict", F.when(missing, "checksum missing").when(F.col("expected") == F.col("sha256"), "ok").otherwise("mismatch"))


def verify_archives(spark: SparkSession, root: str) -> DataFrame:
    """Digest verdict and readability of all archives below root."""
    checked = verify(digests(files(spark, root)), checksums(spark, root)).withColumn("path", relative(F.col("path")))
    return checked.join(archive_status(land_lake(spark, root)), "path", "left")
