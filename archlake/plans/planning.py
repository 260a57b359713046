"""Archives that requests, repairs and proofs need, as tables of plan rows.

A plan row: dataset, symbol, period, key, interval, path, span_start, span_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.functions import dims
from archlake.functions import exprs as E

IDENTITY = ("dataset", "symbol", "period", "key", "interval")
PLAN = (*IDENTITY, "path", "span_start", "span_end")

#: Where a request starts that names no day.
FIRST_DAY = "2020-01-01"


def same(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> Column:
    """Equality of the columns of two tables, null with null."""
    on = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        on = on & left[c].eqNullSafe(right[c])
    return on


def plan_rows(rows: DataFrame) -> DataFrame:
    path = E.archive_path(F.col("dataset"), F.col("symbol"), F.col("period"), F.col("interval"), F.col("key"))
    return rows.withColumn("path", path).select(*PLAN)


def _days(first: Column, last: Column) -> Column:
    """Days from first to last, none if last is before first (a sequence would go backwards)."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def _months(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def expand_symbols(requests: DataFrame) -> DataFrame:
    """One row per distinct symbol of a request's list in `symbols` (text with commas or blanks)."""
    return requests.withColumn("symbol", F.explode(E.symbols(F.col("symbols")))).drop("symbols")


def validate(requests: DataFrame) -> DataFrame:
    """requests with reject_reason, null for those that can be planned (B3, B6): datasets and intervals are arrays."""
    families = F.array(*[F.lit(f[0]) for f in dims.FAMILIES])
    codes = F.array(*[F.lit(c) for c in dims.INTERVAL_MINUTES])
    reason = (
        F.when(E.symbol(F.col("symbol")).isNull(), F.lit("invalid symbol"))
        .when(F.size(F.array_except("datasets", families)) > 0, F.concat(F.lit("unknown datasets: "), F.array_join(F.array_except("datasets", families), ", ")))
        .when(F.size(F.array_except("intervals", codes)) > 0, F.concat(F.lit("unsupported intervals: "), F.array_join(F.array_except("intervals", codes), ", ")))
    )
    return requests.withColumn("reject_reason", reason)


def validate_scans(requests: DataFrame) -> DataFrame:
    """Scan requests with reject_reason (B5): candle families, intervals of fixed length, days in order."""
    fixed = [c for c, m in dims.INTERVAL_MINUTES.items() if m]
    reason = (
        F.when(E.symbol(F.col("symbol")).isNull(), F.lit("invalid symbol"))
        .when(~F.col("dataset").isin(*dims.CANDLE_FAMILIES), F.lit("not a candle dataset"))
        .when(~F.col("interval").isin(*fixed), F.lit("interval without fixed length"))
        .when(F.col("start").isNull() | F.col("end").isNull(), F.lit("dates are required"))
        .when(F.col("start") > F.col("end"), F.lit("start after end"))
    )
    return requests.withColumn("reject_reason", reason)


def plan_archives(requests: DataFrame) -> DataFrame:
    """The fewest archives that cover the requests (H1).

    requests: symbol, datasets, intervals (arrays), start, end (dates or null), today. Whole past months are one monthly
    file where the family has them; the current month, and families with daily files only, are days up to yesterday.
    Requests that validate() rejects give no rows.
    """
    spark = requests.sparkSession
    good = validate(requests).where("reject_reason is null")
    each = good.select(E.symbol(F.col("symbol")).alias("symbol"), F.explode("datasets").alias("dataset"), "intervals", "start", "end", "today")
    met = each.join(F.broadcast(dims.catalog(spark)), "dataset")
    last = F.date_sub("today", 1)
    ranged = met.select(
        "dataset", "symbol", "monthly", "daily",
        F.explode(F.when(F.col("intervalled"), F.col("intervals")).otherwise(F.array(F.lit(None).cast("string")))).alias("interval"),
        F.coalesce("start", F.lit(FIRST_DAY).cast("date")).alias("start"),
        F.least(F.coalesce("end", last), last).alias("end"),
        F.trunc("today", "MM").alias("current"),
    ).where("start <= end")
    month = ranged.where("monthly").select("*", F.explode(_months(F.trunc("start", "MM"), F.least(F.trunc("end", "MM"), F.add_months("current", -1)))).alias("m"))
    months = month.select(
        "dataset", "symbol", F.lit("monthly").alias("period"), F.date_format("m", "yyyy-MM").alias("key"), "interval",
        F.greatest("start", "m").alias("span_start"), F.least("end", F.last_day("m")).alias("span_end"),
    )
    first = F.when(F.col("monthly"), F.greatest("start", "current")).otherwise(F.col("start"))
    days = days_of(ranged.where("daily").select("*", F.explode(_days(first, F.col("end"))).alias("day")))
    return plan_rows(months.unionByName(days)).distinct()


def days_of(rows: DataFrame) -> DataFrame:
    """Daily plan rows (without path) of dataset, symbol, interval, day."""
    return rows.select(
        "dataset", "symbol", F.lit("daily").alias("period"), F.col("day").cast("string").alias("key"), "interval", F.col("day").alias("span_start"), F.col("day").alias("span_end")
    )


def plan_order(plan: DataFrame) -> DataFrame:
    """Plans in the order in which they are worked off (F1)."""
    return plan.orderBy("symbol", "dataset", F.coalesce("interval", F.lit("")), "span_start", "period")


def plan_positions(plan: DataFrame) -> DataFrame:
    """plan with position, from 1, in that order among a symbol's archives (F1)."""
    order = Window.partitionBy("symbol").orderBy("dataset", F.coalesce("interval", F.lit("")), "span_start", "period")
    return plan.withColumn("position", F.row_number().over(order).cast("long"))


def daily_fallbacks(plan: DataFrame) -> DataFrame:
    """The days of monthly plan rows, within their spans, for families with daily files (H2)."""
    met = plan.where("period = 'monthly'").join(F.broadcast(dims.catalog(plan.sparkSession).where("daily").select("dataset")), "dataset")
    return plan_rows(days_of(met.withColumn("day", F.explode(_days(F.col("span_start"), F.col("span_end")))))).distinct()


def needed_fallbacks(results: DataFrame, plan: DataFrame) -> DataFrame:
    """Days of monthly files that weren't there, unless they are planned already (C2, C3, G4). results: plan rows with status."""
    wanted = daily_fallbacks(results.where("status = 'missing'").select(*PLAN))
    return wanted.join(plan.select(*IDENTITY), same(wanted, plan, IDENTITY), "left_anti")


def superseded_daily(results: DataFrame, inventory: DataFrame) -> DataFrame:
    """Daily aggregate-trade archives of months whose monthly archive has arrived and is there.

    Candle families keep their daily files, since these override single candles of the monthly one.
    """
    arrived = results.where("dataset = 'aggTrades' and period = 'monthly' and status in ('downloaded', 'skipped')").join(inventory.select("path"), "path", "left_semi")
    months = arrived.select("symbol", F.col("key").alias("month")).distinct()
    daily = inventory.where("dataset = 'aggTrades' and period = 'daily'").withColumn("month", F.substring("key", 1, 7))
    return daily.join(months, ["symbol", "month"], "left_semi").select("path", "dataset", "symbol", "key", "month")


def archive_order(requests: DataFrame, archives: DataFrame) -> DataFrame:
    """Archives that take part in each scan request, with their rank: the higher one wins.

    archives: path, dataset, symbol, interval, period, key. The order is by the first day inside the request, then layer,
    then key. An archive takes part if its nominal month or day meets the request.
    """
    days = archives.withColumns({"first_day": E.key_first_day(F.col("key")), "last_day": E.key_last_day(F.col("key"))})
    met = requests.select("request_id", "dataset", "symbol", "interval", "start", "end").join(days, ["dataset", "symbol", "interval"])
    met = met.where((F.col("first_day") <= F.col("end")) & (F.col("last_day") >= F.col("start")))
    layer = F.create_map(*[x for k, v in dims.LAYERS.items() for x in (F.lit(k), F.lit(v))])
    order = Window.partitionBy("request_id").orderBy(F.greatest("start", "first_day"), F.element_at(layer, F.col("period")), "key", "path")
    return met.select("request_id", "path", "period", "key", F.row_number().over(order).alias("archive_rank"))


def monthly_repairs(requests: DataFrame, missing_days: DataFrame, inventory: DataFrame, status: DataFrame, today: Column) -> DataFrame:
    """Whole months to fetch: past months with a missing day whose monthly archive is absent or no ZIP file.

    requests: request_id, dataset, symbol, interval, start, end; missing_days: request_id, day; status: path, valid_zip. A
    valid ZIP file with gaps inside isn't fetched again.
    """
    spark = requests.sparkSession
    offered = requests.join(F.broadcast(dims.catalog(spark).where("monthly").select("dataset")), "dataset")
    months = offered.select("*", F.explode(_months(F.trunc("start", "MM"), F.least(F.trunc("end", "MM"), F.add_months(F.trunc(today, "MM"), -1)))).alias("m"))
    hit = missing_days.select("request_id", F.trunc("day", "MM").alias("m")).distinct()
    rows = months.join(hit, ["request_id", "m"], "left_semi").select(
        "dataset", "symbol", F.lit("monthly").alias("period"), F.date_format("m", "yyyy-MM").alias("key"), "interval",
        F.greatest("start", "m").alias("span_start"), F.least("end", F.last_day("m")).alias("span_end"),
    )
    healthy = inventory.select("path").join(status.where("not valid_zip").select("path"), "path", "left_anti")
    return plan_rows(rows).distinct().join(healthy, "path", "left_anti").select(*PLAN)


def daily_repairs(requests: DataFrame, missing_days: DataFrame, invalid_days: DataFrame) -> DataFrame:
    """Days that are missing or invalid (H7, G1), for families with daily files."""
    days = missing_days.select("request_id", "day").union(invalid_days.select("request_id", "day")).distinct()
    met = requests.join(F.broadcast(dims.catalog(requests.sparkSession).where("daily").select("dataset")), "dataset").join(days, "request_id")
    return plan_rows(days_of(met)).distinct()


def effective_trade_sources(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """Which files to scan for a planned month of trades (H8): the monthly one if it is there, else all its days if any of
    them is there, else the monthly one, to be reported as missing."""
    there = inventory.select("path").withColumn("there", F.lit(True))
    month = plan.where("period = 'monthly'").join(there, "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    days = daily_fallbacks(plan).join(there, "path", "left")
    some = days.where("there").select("dataset", "symbol", F.substring("key", 1, 7).alias("month")).distinct()
    split = month.where("not there").select(*PLAN, F.col("key").alias("month")).join(some, ["dataset", "symbol", "month"], "left_semi")
    use_days = days.withColumn("month", F.substring("key", 1, 7)).join(split.select("dataset", "symbol", "month"), ["dataset", "symbol", "month"], "left_semi").select(*PLAN)
    stay = month.select(*PLAN).join(split.select("path"), "path", "left_anti").select(*PLAN)
    return stay.unionByName(plan.where("period <> 'monthly'").select(*PLAN)).unionByName(use_days).distinct()


def trade_repairs(scan: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned archives that a trade scan found missing or invalid."""
    keys = scan.where("not exists or not valid").select("dataset", "symbol", "period", "key").distinct()
    return plan.join(keys, ["dataset", "symbol", "period", "key"], "left_semi").select(*PLAN)


def trade_fallbacks(results: DataFrame, middle: DataFrame, plan: DataFrame) -> DataFrame:
    """Days to fetch instead of months that weren't there or are still invalid after fetching."""
    absent = results.where("status = 'missing' and period = 'monthly'").select(*PLAN)
    bad = bad_months(middle, plan)
    return daily_fallbacks(absent.unionByName(bad)).dropDuplicates(["path"])


def bad_months(middle: DataFrame, plan: DataFrame) -> DataFrame:
    """Monthly trade archives to put aside: there, but invalid."""
    keys = middle.where("exists and not valid and period = 'monthly'").select("dataset", "symbol", "period", "key")
    return plan.join(keys, ["dataset", "symbol", "period", "key"], "left_semi").select(*PLAN)


def evidence_plan(repairable_days: DataFrame) -> DataFrame:
    """Daily trade archives for days with candles that trades may mend (H11). repairable_days: symbol, day."""
    rows = repairable_days.select(F.lit("aggTrades").alias("dataset"), "symbol", F.lit(None).cast("string").alias("interval"), "day").distinct()
    return plan_rows(days_of(rows))
