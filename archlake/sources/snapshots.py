"""Tables whose partitions are replaced in one step: versions, and a pointer that is switched last.

Below a table's path, `data/batch=<token>` holds the partitions that one commit wrote, `versions/<token>` lists which batch each
partition is in, and `log/<number>` names the version of that number. A commit writes data and list under a new token, then
creates the next number, which fails if another writer has been faster: it then starts again from what that one has left.
Readers take the highest number. A writer that is lost half-way leaves files that nothing names; vacuum() removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from archlake.sources.shared import remove

#: Commits that a writer tries before it gives up.
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has made the same version."""


@dataclass(frozen=True)
class Version:
    """number (0: nothing is there), token of the version's files, and the note of its commit."""

    number: int
    token: str
    note: str


class Snapshot:
    """A table of `schema` at path, whose rows are in partitions by the columns of `keys`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: tuple[str, ...], order: tuple[str, ...] = ()):
        """order: columns by which the rows of a partition are sorted."""
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.schema = spark.createDataFrame([], schema).schema
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self._at("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.hadoop.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        if not self.files.exists(self._at(folder)):
            return []
        return [f.getPath().getName() for f in self.files.listStatus(self._at(folder))]

    def _text(self, number: int) -> str:
        at = self._at("log", f"{number:012d}")
        size = self.files.getFileStatus(at).getLen()
        if not size:
            return ""
        stream = self.files.open(at)
        try:
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    def current(self) -> Version:
        """The newest version that is whole; a number whose writer was lost while it created it doesn't count."""
        for number in sorted((int(n) for n in self._names("log") if n.isdigit()), reverse=True):
            token, end, note = self._text(number).partition("\n")
            if end:
                return Version(number, token, note)
        return Version(0, "", "")

    def _places(self, version: Version) -> DataFrame:
        """The keys of a version's partitions, and the batch that each is in."""
        kinds = [self.schema[k] for k in self.keys]
        shape = StructType([*kinds, StructField("batch", StringType())])
        return self.spark.read.schema(shape).parquet(f"{self.path}/versions/{version.token}") if version.number else self.spark.createDataFrame([], shape)

    def read(self, version: Version | None = None) -> DataFrame:
        """All rows of a version, the newest one if none is given. Only partitions that it names are read."""
        version = version or self.current()
        if not version.number:
            return self.spark.createDataFrame([], self.schema)
        places = self._places(version)
        # one for each commit that partitions are still from; what other writers are about isn't looked at
        batches = [f"{self.path}/data/batch={r['batch']}" for r in places.select("batch").distinct().collect()]
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        shape = StructType([*self.schema.fields, StructField("batch", StringType())])
        data = self.spark.read.schema(shape).option("basePath", f"{self.path}/data").parquet(*batches)
        same = data["batch"] == places["batch"]
        for k in self.keys:
            same = same & data[k].eqNullSafe(places[k])
        return data.join(places, same, "left_semi").select(*self.schema.names)

    def replace(self, rows: Callable[[DataFrame, Version], DataFrame], touched: DataFrame, note: str = "") -> Version:
        """Replace the touched partitions (a table of keys): rows() gets their present rows and the version they are from.

        A touched partition without new rows is gone afterwards. Other partitions stay as they are, whoever wrote them.
        """
        touched = touched.select(*self.keys).distinct()
        for _ in range(ATTEMPTS):
            base = self.current()
            old = self._same(self.read(base), touched, "left_semi")
            token = uuid.uuid4().hex
            made = rows(old, base).select(*self.schema.names)
            made.repartition(*self.keys).sortWithinPartitions(*self.keys, *self.order).write.partitionBy(*self.keys).parquet(f"{self.path}/data/batch={token}")
            written = self._written(token)
            self._same(self._places(base), touched, "left_anti").unionByName(written).coalesce(1).write.parquet(f"{self.path}/versions/{token}")
            try:
                return self._commit(Version(self._next(), token, note), base)
            except Conflict:
                remove(self.spark, f"{self.path}/data/batch={token}")
                remove(self.spark, f"{self.path}/versions/{token}")
        raise Conflict(f"{ATTEMPTS} commits to {self.path} have met other writers")

    def _same(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        on = F.lit(True)
        for k in self.keys:
            on = on & rows[k].eqNullSafe(keys[k])
        return rows.join(keys, on, how)

    def _written(self, token: str) -> DataFrame:
        shape = StructType([self.schema[k] for k in self.keys])
        found = self.spark.read.schema(StructType([*self.schema.fields])).parquet(f"{self.path}/data/batch={token}") if self._holds(token) else self.spark.createDataFrame([], shape)
        return found.select(*self.keys).distinct().withColumn("batch", F.lit(token))

    def _holds(self, token: str) -> bool:
        return any("=" in n for n in self._names(f"data/batch={token}"))

    def _next(self) -> int:
        return max((int(n) for n in self._names("log") if n.isdigit()), default=0) + 1

    def _commit(self, version: Version, base: Version) -> Version:
        """Create the version's number, if nothing whole has come after `base`."""
        if self.current() != base:
            raise Conflict
        try:
            stream = self.files.create(self._at("log", f"{version.number:012d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict from None
            raise
        try:
            stream.write(bytearray(f"{version.token}\n{version.note}".encode()))
        finally:
            stream.close()
        return version

    def vacuum(self) -> int:
        """Remove data and lists that the newest version doesn't name, and numbers before it; returns how many folders went.
        Only for times without writers, and without readers of older versions."""
        now = self.current()
        kept = {r["batch"] for r in self._places(now).select("batch").distinct().collect()}
        gone = [f"data/{n}" for n in self._names("data") if n.removeprefix("batch=") not in kept and n.startswith("batch=")]
        gone += [f"versions/{n}" for n in self._names("versions") if n != now.token]
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")
        for n in self._names("log"):
            if n.isdigit() and int(n) < now.number:
                remove(self.spark, f"{self.path}/log/{n}")
        return len(gone)
