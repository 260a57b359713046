"""Logs and overlays as Parquet: append, take the latest by key, overwrite by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from archlake.functions import exprs as E
from archlake.sources.landing import largest_member
from archlake.sources.shared import cut
from archlake.sources.snapshots import Snapshot, Version

MANIFEST_KEY = ("dataset", "symbol", "period", "key", "interval")

#: How long a 'missing' probe stays good.
MISSING_TTL_SECONDS = 12 * 3600

# Fixed values.
FETCH_STATUS = ("downloaded", "skipped", "missing", "failed", "cancelled")


def append(rows: DataFrame, path: str) -> None:
    """Append to a log: run history (A14), benchmark history (A15), probes (A16), manifest."""
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(log: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The newest row of each key (null is a key of its own), by the given columns, all descending."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def manifest(log: DataFrame) -> DataFrame:
    return latest(log, MANIFEST_KEY, "updated_at", "seq")


def without_superseded(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Manifest rows without the daily ones of the given (dataset, symbol, interval, month) (A13); interval may be null."""
    gone = months.select(F.col("dataset").alias("d"), F.col("symbol").alias("s"), F.col("interval").alias("i"), F.col("month").alias("m"))
    day = (F.col("period") == "daily") & (F.length("key") == 10)
    return rows.join(gone, day & (F.col("dataset") == F.col("d")) & (F.col("symbol") == F.col("s")) & (F.substring("key", 1, 7) == F.col("m")) & F.col("interval").eqNullSafe(F.col("i")), "left_anti")


def probes(log: DataFrame) -> DataFrame:
    """The rows of a log that say whether a file is there."""
    return log.where(F.col("status").isin("available", "missing"))


def usable_probes(newest: DataFrame, now: Column) -> DataFrame:
    """url, status and bytes of probes that still hold at `now` (A17): the newest of each url (see latest, logs), if it says
    'available', or 'missing' no longer ago than MISSING_TTL_SECONDS. A time that can't be read is expired."""
    at = F.try_to_timestamp("checked_at")
    age = F.unix_micros(now) - F.unix_micros(at)
    fresh = F.coalesce((F.col("status") == "missing") & at.isNotNull() & (age <= MISSING_TTL_SECONDS * 1_000_000), F.lit(False))
    return newest.where((F.col("status") == "available") | fresh).select("url", "status", "bytes")


def partial_bytes(parts: DataFrame, remote: DataFrame) -> DataFrame:
    """path and local_bytes: what is on disk of an unfinished file.

    parts: path of the archive, segment (null for a single part file), length; remote: path, remote_bytes. The larger of the
    single part and the sum of the segments counts, never more than the remote size.
    """
    sums = parts.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("segment").isNull(), F.col("length"))), F.lit(0)).alias("single"),
        F.coalesce(F.sum(F.when(F.col("segment").isNotNull(), F.col("length"))), F.lit(0)).alias("segments"),
    )
    return remote.join(sums, "path").select("path", F.least("remote_bytes", F.greatest("single", "segments")).alias("local_bytes"))


def merge_overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """Overlay rows (or their provenance) of both, the new one where both have a timestamp."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return latest(both, ("symbol", "interval", "day", "timestamp_ms"), "_v").drop("_v")


def _overlay(spark: SparkSession, path: str, schema: StructType) -> Snapshot:
    return Snapshot(spark, path, schema, ("symbol", "interval", "day"), ("timestamp_ms",))


def write_overlay(new: DataFrame, path: str) -> Version:
    """Merge rows into the overlay at path and replace the touched (symbol, interval, day) partitions only.

    In one step: readers see all of it or nothing, and of two writers the second one merges with what the first has left.
    """
    table = _overlay(new.sparkSession, path, new.schema)
    new = cut(new)  # a second attempt has the same rows
    return table.replace(lambda old, _: merge_overlay(old, new), new)


def read_overlay(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest rows of an overlay, none if there is no such table."""
    return _overlay(spark, path, schema).read()


def overlay_codes(provenance: DataFrame) -> DataFrame:
    """timestamp_ms and the original codes of each provenance record that has a readable timestamp (A10)."""
    at = F.col("timestamp_ms").cast("string").try_cast("bigint")
    return provenance.select(at.alias("timestamp_ms"), F.coalesce("original_issue_codes", F.array().cast("array<string>")).alias("original_issue_codes")).where("timestamp_ms is not null")


# Fixed value: the member of an overlay's archive that holds its records.
MANIFEST_MEMBER = "repair_manifest.json"

_MANIFEST = "struct<version:int,method:string,repairs:array<struct<timestamp_ms:bigint,original_issue_codes:array<string>,source_kline_path:string,aggtrades_path:string,matching_volume_fields:array<string>>>>"


def foreign_overlay_records(manifests: DataFrame) -> DataFrame:
    """Provenance records of overlays written as JSON (A9): path, method and one row per repair; unreadable JSON gives none."""
    parsed = manifests.select("path", F.from_json("json", _MANIFEST).alias("m"))
    return parsed.select("path", "m.method", F.explode("m.repairs").alias("r")).select("path", "method", "r.*")


def foreign_overlays(landed: DataFrame) -> DataFrame:
    """Overlays of other writers, whole (A9): path, timestamp_ms, cells, method and original_issue_codes.

    landed: rows of their archives, with MANIFEST_MEMBER as a text (landing.land). Rows are those of the largest CSV member whose
    first cell is a time, the last one of each time, cells trimmed; records come from the manifest and are joined by time, so
    that a row may have no record (codes null) and a record no row (cells null). An archive that can't be read to its end, or
    whose manifest is no JSON, gives nothing; one without a CSV member has records only, one without a manifest rows only.
    """
    landed = cut(landed)
    text = landed.where(F.col("member") == MANIFEST_MEMBER).select("path", F.get("cells", F.lit(0)).alias("json"))
    broken = landed.where("error is not null and error <> 'no CSV member'").select("path").union(text.where(F.try_parse_json("json").isNull()).select("path")).distinct()
    rows = largest_member(landed.where("member_idx is not null")).where("cells is not null and size(cells) > 0").join(broken, "path", "left_anti")
    timed = rows.select("path", "ordinal", E.epoch_ms(F.get("cells", F.lit(0))).alias("timestamp_ms"), F.transform("cells", lambda c: F.trim(c)).alias("cells")).where("timestamp_ms is not null")
    last = timed.groupBy("path", "timestamp_ms").agg(F.max_by("cells", "ordinal").alias("cells"))
    records = foreign_overlay_records(text.join(broken, "path", "left_anti")).where("timestamp_ms is not null")
    records = records.groupBy("path", "timestamp_ms").agg(F.max(F.struct("method", "original_issue_codes")).alias("r"))
    return last.join(records, ["path", "timestamp_ms"], "full_outer").select("path", "timestamp_ms", "cells", "r.method", "r.original_issue_codes")


def recent(log: DataFrame, n: int) -> DataFrame:
    """The newest n rows, at least one."""
    return log.orderBy(F.desc("started_at"), F.desc("id")).limit(max(1, n))


def latest_speed(runs: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """speed_mbps and source of whichever is newer: the latest run's average or the latest benchmark's recommendation.

    A latest row without a positive speed doesn't count, and no older one is taken instead; no rows if neither counts.
    """
    one = lambda log, col, source: recent(log, 1).select("started_at", F.col(col).cast("double").alias("speed_mbps"), F.lit(source).alias("source"))
    # The names of the two sources.
    both = one(runs, "average_mbps", "latest collection average").unionByName(one(benchmarks, "recommended_mbps", "latest Auto Tune")).where("speed_mbps > 0")
    return both.orderBy(F.desc("started_at"), F.desc("source")).limit(1).select("speed_mbps", "source")
