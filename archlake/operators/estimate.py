"""How much is left to fetch, before fetching it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.plans.planning import PLAN, daily_fallbacks


def estimate_files(plan: DataFrame, inventory: DataFrame, probes: DataFrame, partial: DataFrame) -> DataFrame:
    """Plan rows with status, remote_bytes, local_bytes and remaining_bytes.

    probes: path, status ('available' or 'missing'), bytes; partial: path, local_bytes. A monthly file that isn't offered is
    replaced by its days, which aren't replaced again. A file of length 0 isn't there.
    """

    def known(rows: DataFrame) -> DataFrame:
        there = inventory.where("length > 0").select("path", F.col("length").alias("here"))
        probed = probes.select("path", F.col("status").alias("probe"), F.col("bytes").alias("remote"))
        return rows.select(*PLAN).join(there, "path", "left").join(probed, "path", "left")

    first = known(plan)
    absent = (F.col("here").isNull()) & (F.col("probe") == "missing")
    swapped = first.where(absent & (F.col("period") == "monthly")).select(*PLAN)
    days = daily_fallbacks(swapped)
    replaced = days.select("dataset", "symbol", "interval", F.substring("key", 1, 7).alias("key")).distinct()
    keep = first.join(
        replaced.selectExpr("dataset as d", "symbol as s", "interval as i", "key as k"),
        absent & (F.col("period") == "monthly") & (F.col("dataset") == F.col("d")) & (F.col("symbol") == F.col("s")) & F.col("interval").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")),
        "left_anti",
    )
    met = keep.unionByName(known(days)).join(partial.select("path", "local_bytes"), "path", "left")
    local = F.least(F.coalesce("local_bytes", F.lit(0)), F.coalesce("remote", F.lit(0)))
    sized = (F.col("probe") == "available") & F.col("remote").isNotNull()
    status = (
        F.when(F.col("here").isNotNull(), "present").when(sized & (local > 0), "partial").when(sized, "remaining").when(F.col("probe") == "missing", "unavailable").otherwise("unknown")
    )
    open_ = status.isin("partial", "remaining")
    return met.select(
        *PLAN, status.alias("status"),
        F.when(status == "present", F.col("here")).when(open_, F.col("remote")).otherwise(0).alias("remote_bytes"),
        F.when(status == "present", F.col("here")).when(open_, local).otherwise(0).alias("local_bytes"),
        F.when(open_, F.col("remote") - local).otherwise(0).alias("remaining_bytes"),
    )


def estimate_by_dataset(files: DataFrame) -> DataFrame:
    """Per family, and in total (dataset null): files by status and bytes."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return files.rollup("dataset").agg(
        F.count(F.lit(1)).alias("files"), is_("present").alias("present_files"), is_("partial", "remaining").alias("needed_files"), is_("partial").alias("partial_files"),
        is_("unavailable").alias("unavailable_files"), is_("unknown").alias("unknown_files"), F.sum("remaining_bytes").alias("remaining_bytes"),
        F.coalesce(F.sum(F.when(F.col("status") == "present", F.col("local_bytes"))), F.lit(0)).alias("present_bytes"),
        F.coalesce(F.sum(F.when(F.col("status") == "partial", F.col("local_bytes"))), F.lit(0)).alias("partial_bytes"),
    )


def with_eta(total: DataFrame, speed_mbps: float | None, free_bytes: int) -> DataFrame:
    """The total with eta_seconds (null without a speed or anything to fetch) and enough_disk."""
    speed = F.lit(float(speed_mbps or 0))
    eta = F.when((speed > 0) & (F.col("remaining_bytes") > 0), F.col("remaining_bytes") * 8.0 / (speed * 1_000_000))
    return total.withColumns({"speed_mbps": speed, "eta_seconds": eta, "enough_disk": F.lit(free_bytes) >= F.col("remaining_bytes")})
