"""Logs of which the newest row of each key counts, as a bucketed base and a small delta.

Ranking a whole log on every read moves all of it. Here the base holds one row for each key, in buckets of a hash of the key,
and rows that came later are a delta. A read reduces the delta, which is small, and joins it to the base by bucket, so that the
base isn't shuffled; when the delta has grown, both become the next base, which isn't shuffled either.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.sources.shared import remove

#: A delta of more than this share of the base, and of more rows than this, becomes part of it.
DELTA_SHARE, DELTA_ROWS = 0.1, 100_000


@dataclass
class CompactedLog:
    """A log at `path` whose rows have the columns of `schema`; the newest by `order` (descending) counts for each value of keys.

    The base is a bucketed table in the session's catalog, stored below the path; a new session makes it known to its own one.
    Null keys are values; of rows that are equal in `order` one counts.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64
    base: str = ""

    def __post_init__(self) -> None:
        """Find the newest base that was written to its end."""
        self.path = self.path.rstrip("/")
        self._hadoop = self.spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        whole = [f for f in self._listed() if f.getPath().getName().startswith("log_") and self._files.exists(self._hadoop.Path(f.getPath(), "_SUCCESS"))]
        if not self.base and whole:
            self.base = max(whole, key=lambda f: f.getModificationTime()).getPath().getName()
        if self.base and not self.spark.catalog.tableExists(self.base):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], self.schema).schema.fields)
            self.spark.sql(f"create table {self.base} (_key string, {columns}) using parquet clustered by (_key) sorted by (_key) into {self.buckets} buckets location '{self.path}/{self.base}'")

    def _listed(self) -> list:
        at = self._hadoop.Path(self.path)
        return list(self._files.listStatus(at)) if self._files.exists(at) else []

    def _key(self) -> Column:
        """One text for the key: equal keys, nulls included, have equal texts, others don't."""
        return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(self.keys)])).alias("_key")

    def _newest(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        order = F.struct(*[F.col(c) for c in self.order])
        return rows.groupBy("_key").agg(F.max_by(F.struct(*self._names()), order).alias(prefix + "row"))

    def _names(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]

    def append(self, rows: DataFrame) -> None:
        rows.select(self._key(), *self._names()).write.mode("append").parquet(f"{self.path}/delta")

    def delta(self) -> DataFrame:
        shape = self.spark.createDataFrame([], self.schema).schema
        empty = self.spark.createDataFrame([], self.schema).select(self._key(), *shape.names)
        if not self._files.exists(self._hadoop.Path(f"{self.path}/delta")):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/delta")

    def latest(self) -> DataFrame:
        """The newest row of each key; the base is read in its buckets, without an exchange."""
        new = self._newest(self.delta(), "new_")
        if not self.base:
            return new.select("new_row.*")
        old = self.spark.table(self.base).select("_key", F.struct(*self._names()).alias("row"))
        met = old.join(new, "_key", "full_outer")
        newer = F.struct(*[F.col("new_row")[c] for c in self.order]) >= F.struct(*[F.col("row")[c] for c in self.order])
        return met.select("_key", F.when(F.col("row").isNull() | (F.col("new_row").isNotNull() & newer), F.col("new_row")).otherwise(F.col("row")).alias("r")).select("r.*")

    def compact(self, always: bool = False) -> bool:
        """Make delta and base the next base if the delta has grown; the old base and the delta are removed after that."""
        count = self.delta().count()
        if not always and count <= max(DELTA_ROWS, DELTA_SHARE * (self.spark.table(self.base).count() if self.base else 0)):
            return False
        name = f"log_{uuid.uuid4().hex}"
        # delta rows that are appended meanwhile must not be removed: only the files that were read are
        taken = self.delta().inputFiles()
        rows = self.latest().select(self._key(), *self._names())
        rows = rows if self.base else rows.repartition(self.buckets, "_key")
        rows.write.bucketBy(self.buckets, "_key").sortBy("_key").option("path", f"{self.path}/{name}").saveAsTable(name)
        old, self.base = self.base, name
        for file in taken:
            remove(self.spark, file)
        if old:
            self.spark.sql(f"drop table {old}")
            remove(self.spark, f"{self.path}/{old}")
        return True
