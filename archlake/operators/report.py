"""What was fetched, repaired and left: summaries over result and scan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.functions import rules as R
from archlake.sources.tables import FETCH_STATUS


def collection_summary(results: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """Counts by status, bytes, segmented files and recovered parts of a results table."""
    transport = F.coalesce("transport", F.lit(""))
    out = results.agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in FETCH_STATUS],
        F.coalesce(F.sum(F.when(F.col("status") == "downloaded", F.col("bytes"))), F.lit(0)).alias("bytes_downloaded"),
        F.count_if(transport.startswith("segmented-")).alias("segmented_files"), F.count_if(transport == "recovered-part").alias("recovered_parts"),
    )
    if elapsed_seconds is None:
        return out
    s = F.lit(float(max(elapsed_seconds, 1e-6)))
    return out.withColumns({"average_mbps": F.col("bytes_downloaded") * 8 / 1_000_000 / s, "files_per_minute": F.col("files") / s * 60})


def status_pivot(results: DataFrame) -> DataFrame:
    """Files per family and status (D11), with the fixed statuses as columns."""
    return results.groupBy("dataset").pivot("status", list(FETCH_STATUS)).count().fillna(0, list(FETCH_STATUS))


def codes_by_day(details: DataFrame) -> DataFrame:
    """request_id, day and its distinct codes in order."""
    return details.select("request_id", "day", F.explode("codes").alias("code")).groupBy("request_id", "day").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def codes_by_day_of(merged: DataFrame, day) -> DataFrame:
    """codes_by_day of all bad candles, from their masks."""
    bad = merged.where("mask <> 0").select("request_id", day.alias("day"), F.explode(R.issue_codes(F.col("mask"))).alias("code"))
    return bad.groupBy("request_id", "day").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def repair_report(before: DataFrame, after: DataFrame, fetched: DataFrame, codes: DataFrame) -> DataFrame:
    """Days that were or are bad, with what remains and a status.

    before and after: by_day tables (request_id, day, missing, invalid); fetched: request_id, day, status of the last attempt
    to fetch that day; codes: codes_by_day of the scan after.
    """
    bad = F.col("missing") + F.col("invalid") > 0
    old = before.where(bad).select("request_id", "day", F.lit(True).alias("was"))
    new = after.where(bad).select("request_id", "day", "missing", "invalid")
    tries = fetched.groupBy("request_id", "day").agg(F.bool_or(F.col("status") == "missing").alias("absent"), F.bool_or(F.col("status") == "failed").alias("failed"))
    met = old.join(new, ["request_id", "day"], "full_outer").join(tries, ["request_id", "day"], "left").join(codes, ["request_id", "day"], "left")
    missing, invalid = F.coalesce("missing", F.lit(0)), F.coalesce("invalid", F.lit(0))
    # The labels of a day.
    label = (
        F.when((missing == 0) & (invalid == 0), "Repaired")
        .when(F.col("absent"), "Daily archive unavailable")
        .when(F.col("failed"), "Repair download failed")
        .when((missing > 0) & (invalid > 0), "Still missing + invalid after repair")
        .when(missing > 0, "Still missing after repair")
        .otherwise("Still invalid after repair")
    )
    names = F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ", ")
    status = F.when(names == "", label).otherwise(F.concat(label, F.lit(" · "), names))
    return met.select("request_id", "day", missing.alias("missing"), invalid.alias("invalid"), status.alias("status"))


def ordered_report(made: DataFrame) -> DataFrame:
    """A report with position, from 1: a request's days in their order."""
    return made.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("day")).cast("long"))


def unresolved_days(after: DataFrame) -> DataFrame:
    """Days with something left."""
    return after.where("missing + invalid > 0").select("request_id", "day").distinct()


def merged_attempts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Days that weren't there or failed in either round of fetching (G7): request_id, day, status."""
    both = first.select("request_id", "day", "status").union(second.select("request_id", "day", "status"))
    return both.where("status in ('missing', 'failed')").distinct()
