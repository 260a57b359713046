"""Rounds of scanning, planning and repair. Fetching is the caller's: a step that takes a plan and leaves files on the lake."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from archlake.functions import exprs as E
from archlake.functions import rules as R
from archlake.operators import klines, reconstruct, report, trades
from archlake.plans import planning
from archlake.sources import landing
from archlake.sources.shared import cut, scratch

#: Takes plan rows, leaves the files below the root and returns the rows with a status.
Fetch = Callable[[DataFrame], DataFrame]


@dataclass
class Lake:
    """Archives below a root, and the rows of those that a scan has asked for.

    An archive is opened when a scan first needs it, and again only if its file has changed since (length or time). Rows are
    stored in batches at `store`, then the batch's files are noted; rows of a batch that isn't noted don't count, so that a
    job that was lost in between does no harm. A store that is kept spares later rounds the same work.
    """

    spark: SparkSession
    root: str
    store: str = ""

    def __post_init__(self) -> None:
        self.store = (self.store or scratch(self.spark, "lake")).rstrip("/")

    def inventory(self) -> DataFrame:
        return cut(landing.inventory(self.spark, self.root))

    def opened(self) -> DataFrame:
        """path, length, modified and batch of every file that has been opened."""
        shape = "path string, length long, modified timestamp, batch int"
        found = self._read("opened", shape)
        return self.spark.createDataFrame([], shape) if found is None else found

    def _read(self, name: str, shape: str | StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(shape).parquet(f"{self.store}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def landed(self, inventory: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted paths that are on the lake: a semi-join on paths, before any content is read."""
        version = ["path", "length", "modified"]
        there = inventory.join(wanted.select("path").distinct(), "path", "left_semi")
        seen = cut(self.opened())
        new = cut(there.join(seen, version, "left_anti"))
        batch = (seen.agg(F.max("batch")).first()[0] or 0) + 1
        rows = landing.with_keys(landing.land_files(self.spark, new))
        if not new.isEmpty():
            rows.write.mode("overwrite").parquet(f"{self.store}/rows/batch={batch}")
            new.select(*version).write.mode("overwrite").parquet(f"{self.store}/opened/batch={batch}")
        now = there.join(self.opened(), version).groupBy("path").agg(F.max("batch").alias("batch"))
        stored = self._read("rows", StructType([*rows.schema.fields, StructField("batch", IntegerType())]))
        return rows if stored is None else stored.join(now, ["path", "batch"], "left_semi").drop("batch")

    def checked(self, inventory: DataFrame, wanted: DataFrame) -> DataFrame:
        """What trades.archive_trades finds in the wanted trade archives that are on the lake.

        As with landed(), an archive is opened once and again only if its file has changed. Nothing but what was found in it is
        stored, with the file's version, so that rows are neither written nor read again.
        """
        version = ["path", "length", "modified"]
        shape = f"path string, length long, modified timestamp, {trades.FOUND}"
        there = inventory.join(wanted.select("path").distinct(), "path", "left_semi")
        seen = self._read("checked", shape)
        new = cut(there if seen is None else there.join(seen, version, "left_anti"))
        if not new.isEmpty():
            found = trades.archive_trades(landing.land_files(self.spark, new)).withColumnRenamed("path", "file")
            new.select("file", *version).join(found, "file").drop("file").write.mode("append").parquet(f"{self.store}/checked")
        seen = self._read("checked", shape)
        if seen is None:
            return self.spark.createDataFrame([], shape).drop("length", "modified")
        return seen.dropDuplicates(version).join(there.select(*version), version, "left_semi").drop("length", "modified")


def _scan(lake: Lake, requests: DataFrame, overlay: DataFrame | None) -> dict[str, DataFrame]:
    """A scan of the archives that the requests ask for; `inventory` and `status` (of these archives) come with its tables."""
    inventory = lake.inventory()
    landed = lake.landed(inventory, planning.archive_order(requests, inventory))
    status = cut(landing.archive_status(landed))
    found = klines.scan_klines(landing.raw_rows(landed), requests, inventory, status, overlay, limit=None)
    return {**found, "inventory": inventory, "status": status}


def _by_request(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """request_id, day and status of the daily files among fetched plan rows."""
    days = fetched.where("period = 'daily'").select("dataset", "symbol", "interval", F.to_date("key").alias("day"), "status")
    return requests.select("request_id", "dataset", "symbol", "interval").join(days, ["dataset", "symbol", "interval"]).select("request_id", "day", "status")


def _came(fetched: DataFrame) -> bool:
    """Whether a fetch step has changed the lake."""
    return not fetched.where("status = 'downloaded'").isEmpty()


def repair_round(lake: Lake, requests: DataFrame, fetch: Fetch, today: Column, overlay: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scan, fetch whole months, scan, fetch days, scan, rebuild from trades, and scan with the rebuilt candles.

    Returns before, after (scan tables), report, verdicts and overlay (rows to write). Nothing is fetched for a request that
    is complete, and nothing is scanned again that no fetch has changed. Each scan sees the lake as it is then: what it needs
    later is stored. Without a candle that trades may mend, verdicts are None and the overlay stays. Only archives of the requests' months
    and days, and trades of the days to prove, are opened, each of them once.
    """
    before = _scan(lake, requests, overlay)
    before_days = cut(before["by_day"])
    bad = before_days.groupBy("request_id").agg(F.sum(F.col("missing") + F.col("invalid")).alias("n")).where("n > 0").select("request_id")
    open_ = cut(requests.join(bad, "request_id", "left_semi"))
    if open_.isEmpty():
        none = before_days.limit(0)
        return {"before": before_days, "after": before_days, "report": none, "verdicts": None, "overlay": overlay}
    months = cut(fetch(cut(planning.monthly_repairs(open_, before_days.where("missing > 0"), before["inventory"], before["status"], today))))
    now = _scan(lake, open_, overlay) if _came(months) else before
    days = now["by_day"].join(open_.select("request_id"), "request_id", "left_semi")
    got = cut(fetch(cut(planning.daily_repairs(open_, days.where("missing > 0"), days.where("invalid > 0")))))
    now = _scan(lake, open_, overlay) if _came(got) else now
    details = now["details"].where(R.repairable(F.col("mask")))
    asked = open_.where("dataset = 'klines'").select("request_id", "symbol", "interval")
    originals = cut(details.join(asked, "request_id").select("symbol", "interval", "open_time", "codes", "cells").distinct())
    if originals.isEmpty():
        # what was complete before hasn't been touched
        rest = before_days.join(open_.select("request_id"), "request_id", "left_anti")
        after = cut(now["by_day"].join(open_.select("request_id"), "request_id", "left_semi").unionByName(rest))
        verdicts, layer, merged = None, overlay, now["merged"]
    else:
        wanted = cut(planning.evidence_plan(originals.select("symbol", E.day_of(F.col("open_time")).alias("day"))))
        fetch(wanted)
        inventory = lake.inventory()
        proof = reconstruct.evidence(landing.largest_member(landing.raw_rows(lake.landed(inventory, wanted))))
        there = inventory.where("dataset = 'aggTrades' and period = 'daily'").select("symbol", F.to_date("key").alias("day"))
        verdicts = reconstruct.reconstruct(originals, proof, there)
        rebuilt = reconstruct.overlay_rows(verdicts)
        layer = rebuilt if overlay is None else overlay.select(*rebuilt.columns).unionByName(rebuilt)
        last = _scan(lake, requests, layer)
        after, merged = last["by_day"], last["merged"]
    codes = report.codes_by_day_of(merged, E.day_of(F.col("open_time")))
    return {"before": before_days, "after": after, "report": report.repair_report(before_days, after, _by_request(open_, got), codes), "verdicts": verdicts, "overlay": layer}


def trade_repair_round(lake: Lake, plan: DataFrame, fetch: Fetch, drop: Callable[[DataFrame], None]) -> dict[str, DataFrame]:
    """Scan trade archives, fetch the bad ones, put months aside that stay bad, fetch their days, scan again.

    plan: plan rows with request_id; drop: removes the given archives from the lake. Returns before and after (scan tables).
    """

    def scan() -> dict[str, DataFrame]:
        inventory = lake.inventory()
        sources = cut(planning.effective_trade_sources(plan, inventory).join(plan.select("request_id", "symbol").distinct(), "symbol"))
        archives = cut(trades.scan_found(lake.checked(inventory, sources), sources)["archives"])  # what was seen, whatever the lake holds later
        return {"archives": archives, "summary": cut(trades.trade_summary(archives))}

    before = scan()
    results = cut(fetch(planning.trade_repairs(before["archives"], plan)))
    middle = scan()["archives"]
    fallbacks = cut(planning.trade_fallbacks(results, middle, plan))
    drop(planning.bad_months(middle, plan))
    fetch(fallbacks)
    return {"before": before, "after": scan()}
