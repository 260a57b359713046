"""Landed trades laid out so that a proof reads what it needs: by symbol and month, each file a range of time, sorted.

The few candles to prove name partitions and ranges of time. Both reach the scan as filters: other symbols and months aren't
opened, and of an opened file only row groups whose times meet a range are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.functions import exprs as E
from archlake.operators.klines import interval_length

COLUMNS = "agg_id long, ms long, price decimal(18,8), quantity decimal(18,8), first_id long, last_id long, maker boolean, symbol string, month string"

#: Rows of a file, and of a row group in it, at most about.
FILE_ROWS, GROUP_BYTES = 4_000_000, 8 << 20

#: Ranges of time, and partitions, that a filter spells out. More ranges are joined where the gaps are smallest; with more
#: partitions than this, only the range of months is spelled out, and Spark prunes by the join.
MOST_RANGES, MOST_PARTITIONS = 100, 1000


def month_of(ms: Column) -> Column:
    return F.date_format(E.day_of(ms), "yyyy-MM")


def write_evidence(trades: DataFrame, path: str, parts: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Append evidence() rows; a symbol with most trades is dealt to many tasks, by ranges of time."""
    rows = trades.withColumn("month", month_of(F.col("ms"))).select(*[c.split()[0] for c in COLUMNS.split(", ")])
    order = ["symbol", "month", "ms", "agg_id"]
    dealt = rows.repartitionByRange(parts, *order[:3]) if parts else rows.repartitionByRange(*order[:3])
    dealt.sortWithinPartitions(*order).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.size", group_bytes).partitionBy("symbol", "month").parquet(path)


def ranges(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Closed ranges that hold all the spans: what overlaps is one, and the smallest gaps are filled until there are at most `most`."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1], reverse=True)
    starts = sorted([0, *gaps[: max(0, most - 1)]]) if joined else []
    ends = [*starts[1:], len(joined)] if joined else []
    return [(joined[a][0], joined[b - 1][1]) for a, b in zip(starts, ends, strict=True)]


def read_evidence(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """Trades that may be in the target candles (symbol, interval, open_time), for reconstruct(): C6, D9, H12.

    What comes to the driver is one span for each symbol and day, by symbol and month if these are over a million.
    """
    stored = spark.read.schema(COLUMNS).parquet(path)
    last = F.col("open_time") + interval_length(F.col("interval")) - 1
    part = targets.select("symbol", month_of(F.col("open_time")).alias("month"), E.day_of(F.col("open_time")).alias("day"), F.col("open_time").alias("a"), last.alias("b"))
    # a candle may go on into the next month
    part = part.unionByName(part.withColumn("month", month_of(F.col("b")))).groupBy("symbol", "month", "day").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    if part.count() > 1_000_000:
        part = part.groupBy("symbol", "month").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    found = part.select("symbol", "month", "a", "b").collect()
    if not found:
        return stored.limit(0)
    either = lambda conditions: reduce(lambda x, y: x | y, conditions)
    times = either([F.col("ms").between(a, b) for a, b in ranges([(r["a"], r["b"]) for r in found], MOST_RANGES)])
    places = sorted({(r["symbol"], r["month"]) for r in found})
    if len(places) > MOST_PARTITIONS:
        months = sorted(m for _, m in places)
        stored = stored.where(F.col("month").between(months[0], months[-1])).join(part.select("symbol", "month").distinct(), ["symbol", "month"], "left_semi")
        return stored.where(times).drop("month")
    by_symbol: dict[str, list[str]] = {}
    for s, m in places:
        by_symbol.setdefault(s, []).append(m)
    return stored.where(either([(F.col("symbol") == s) & F.col("month").isin(m) for s, m in by_symbol.items()])).where(times).drop("month")
