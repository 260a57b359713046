"""Scans of fixed-interval candles: last source wins, then missing slots and rule findings per day.

Everything is per request, so that one job answers any number of symbols, intervals and ranges. Rows are reduced to a bit
mask and a source order before they are merged; only two numbers per row are shuffled. Expected slots are counted, not
listed: a grid is made for days that are known to have gaps, and only on demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.functions import dims
from archlake.functions import exprs as E
from archlake.functions import rules as R
from archlake.plans.planning import archive_order
from archlake.sources.shared import cut

#: Bits of the order key that hold the row's ordinal in its archive; the archive's rank stands above them.
_ORDINAL_BITS = 40

#: Details of bad candles that a report lists (F2); counts are always of all.
MAX_DETAILS = 100


def interval_length(code: Column) -> Column:
    pairs = [x for c, m in dims.INTERVAL_MINUTES.items() if m for x in (F.lit(c), F.lit(m * 60_000).cast("bigint"))]
    return F.element_at(F.create_map(*pairs), code)


def candle_rows(raw: DataFrame) -> DataFrame:
    """Typed candle rows (A7, B12): raw rows whose first cell is a time, with open_time, numbers, day and mask."""
    timed = raw.withColumn("open_time", E.epoch_ms(F.get("cells", F.lit(0)))).where("open_time is not null")
    typed = timed.withColumns(R.candle_fields(F.col("cells")))
    return R.with_candle_mask(typed, F.col("cells"), F.col("dataset"), F.col("open_time"), interval_length(F.col("interval")))


def compact(rows: DataFrame) -> DataFrame:
    """Rows in requests as a scan stores them: place, time, mask and order; the cells of rows with findings only."""
    return rows.select("request_id", "path", "member_idx", "ordinal", "open_time", "mask", "order_key", F.when(F.col("mask") != 0, F.col("cells")).alias("cells"))


def rows_in_requests(rows: DataFrame, requests: DataFrame, archives: DataFrame) -> DataFrame:
    """Candle rows inside the requests' days, with order_key: the larger one wins."""
    order = archive_order(requests, archives)
    bounds = requests.select("request_id", E.day_start_ms(F.col("start")).alias("from_ms"), (E.day_start_ms(F.col("end")) + dims.DAY_MS - 1).alias("to_ms"))
    chosen = order.join(bounds, "request_id").select("request_id", "path", "archive_rank", "from_ms", "to_ms")
    met = rows.join(chosen, "path").where(F.col("open_time").between(F.col("from_ms"), F.col("to_ms")))
    return met.withColumn("order_key", F.shiftleft(F.col("archive_rank").cast("bigint"), _ORDINAL_BITS) + F.col("ordinal"))


def merge(rows: DataFrame) -> DataFrame:
    """One row per request and time: mask and order_key of the row that wins, as a hash aggregate of two bigints."""
    return rows.groupBy("request_id", "open_time").agg(F.max_by("mask", "order_key").alias("mask"), F.max("order_key").alias("order_key"))


def with_overlay(merged: DataFrame, overlay: DataFrame, requests: DataFrame) -> DataFrame:
    """merged with verified rows on top (H13): they win over any archive, for candles of family klines only.

    overlay: symbol, interval, cells. Rows outside a request's days, and those that break a rule, don't enter.
    Every candle is counted by its own time, so that an overlay row mends exactly that one.
    """
    typed = candle_rows(overlay.select("symbol", "interval", F.lit("klines").alias("dataset"), "cells"))
    # few rows; stored first, since a filter on the mask would be pushed below all the steps that make it
    rows = cut(typed.select("symbol", "interval", "open_time", "mask")).where("mask = 0")
    met = rows.join(requests.where("dataset = 'klines'").select("request_id", "symbol", "interval", "start", "end"), ["symbol", "interval"])
    met = met.where(F.col("open_time").between(E.day_start_ms(F.col("start")), E.day_start_ms(F.col("end")) + dims.DAY_MS - 1))
    top = met.select("request_id", "open_time", "mask", F.lit(1 << 62).cast("bigint").alias("order_key"))
    return merge(merged.select("request_id", "open_time", "mask", "order_key").unionByName(top))


def by_day(merged: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, day, expected, found, missing and invalid of every day of every request."""
    lengths = requests.withColumn("ms", interval_length(F.col("interval")))
    days = lengths.select("request_id", "ms", F.explode(F.sequence("start", "end")).alias("day"))
    timed = merged.join(lengths.select("request_id", "ms"), "request_id")
    seen = timed.groupBy("request_id", E.day_of(F.col("open_time")).alias("day")).agg(
        F.count_if(F.pmod("open_time", "ms") == 0).alias("found"), F.count_if(F.col("mask") != 0).alias("invalid")
    )
    expected = (F.lit(dims.DAY_MS) / F.col("ms")).cast("bigint")
    return days.join(seen, ["request_id", "day"], "left").select(
        "request_id", "day", expected.alias("expected"), F.coalesce("found", F.lit(0)).alias("found"),
        (expected - F.coalesce("found", F.lit(0))).alias("missing"), F.coalesce("invalid", F.lit(0)).alias("invalid"),
    )


def missing_slots(merged: DataFrame, requests: DataFrame, days: DataFrame) -> DataFrame:
    """request_id and open_time of each missing slot (C5); a grid is made for days with gaps only."""
    gaps = days.where("missing > 0").join(requests.select("request_id", interval_length(F.col("interval")).alias("ms")), "request_id")
    first = E.day_start_ms(F.col("day"))
    grid = gaps.select("request_id", F.explode(F.sequence(first, first + dims.DAY_MS - F.col("ms"), F.col("ms"))).alias("open_time"))
    return grid.join(merged.select("request_id", "open_time"), ["request_id", "open_time"], "left_anti")


def slot_words(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Slots of a day as bits, 64 in a word (D1, D2): request_id, day, word, found and bad, over all archives.

    rows: rows_in_requests(), not merged. Each task has one word for 64 candles of an archive, so that words are shuffled and
    not candles. Archives are laid over each other by rank: a later one's slots replace those below. Where an archive has a slot
    twice, which its count tells, the last row decides, and only the rows of these words are looked at again.
    """
    timed = rows.join(requests.select("request_id", interval_length(F.col("interval")).alias("_ms")), "request_id").where(F.pmod("open_time", "_ms") == 0)
    slot = F.pmod("open_time", F.lit(dims.DAY_MS)) / F.col("_ms")
    placed = timed.select(
        "request_id", E.day_of(F.col("open_time")).alias("day"), F.floor(slot / 64).cast("int").alias("word"), F.expr("shiftright(order_key, 40)").alias("rank"),
        F.pmod(slot, F.lit(64)).cast("int").alias("at"), "mask", "order_key",
    )
    place = ["request_id", "day", "word", "rank"]
    bit = F.expr("shiftleft(1L, at)")
    words = lambda t: t.groupBy(*place).agg(F.bit_or(bit).alias("found"), F.coalesce(F.bit_or(F.when(F.col("mask") != 0, bit)), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n"))
    each = cut(words(placed))
    twice = each.where(F.col("n") > F.bit_count("found")).select(*place)
    last = placed.join(twice, place, "left_semi").groupBy(*place, "at").agg(F.max_by("mask", "order_key").alias("mask"))
    whole = each.where(F.col("n") == F.bit_count("found")).unionByName(words(last))
    layers = whole.groupBy("request_id", "day", "word").agg(F.array_sort(F.collect_list(F.struct("rank", "found", "bad"))).alias("l"))  # a few archives
    start = F.struct(F.lit(0).cast("bigint").alias("found"), F.lit(0).cast("bigint").alias("bad"))
    over = lambda below, top: F.struct(below["found"].bitwiseOR(top["found"]).alias("found"), below["bad"].bitwiseAND(F.bitwise_not(top["found"])).bitwiseOR(top["bad"]).alias("bad"))
    return layers.select("request_id", "day", "word", F.aggregate("l", start, over).alias("w")).select("request_id", "day", "word", "w.found", "w.bad")


def by_day_of_words(words: DataFrame, rows: DataFrame, requests: DataFrame) -> DataFrame:
    """by_day() from slot_words() of the same rows; the few rows off the grid, which are no slots, are merged one by one."""
    lengths = requests.select("request_id", interval_length(F.col("interval")).alias("ms"))
    off = merge(rows.join(lengths, "request_id").where(F.pmod("open_time", "ms") != 0).select("request_id", "open_time", "mask", "order_key"))
    off = off.where("mask <> 0").select("request_id", E.day_of(F.col("open_time")).alias("day"), F.lit(0).alias("found"), F.lit(1).alias("invalid"))
    seen = words.select("request_id", "day", F.bit_count("found").alias("found"), F.bit_count("bad").alias("invalid")).unionByName(off)
    seen = seen.groupBy("request_id", "day").agg(F.sum("found").alias("found"), F.sum("invalid").alias("invalid"))
    expected = (F.lit(dims.DAY_MS) / F.col("ms")).cast("bigint")
    days = requests.select("request_id", interval_length(F.col("interval")).alias("ms"), F.explode(F.sequence("start", "end")).alias("day"))
    found = F.coalesce("found", F.lit(0)).cast("bigint")
    return days.join(seen, ["request_id", "day"], "left").select(
        "request_id", "day", expected.alias("expected"), found.alias("found"), (expected - found).alias("missing"), F.coalesce("invalid", F.lit(0)).cast("bigint").alias("invalid")
    )


def missing_slots_of_words(words: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and open_time of each missing slot (C5), from the bits that aren't set; a word that no archive has is all missing."""
    lengths = requests.select("request_id", "start", "end", interval_length(F.col("interval")).alias("ms"))
    count = (F.lit(dims.DAY_MS) / F.col("ms")).cast("int")
    days = lengths.select("request_id", "ms", count.alias("count"), F.explode(F.sequence("start", "end")).alias("day"))
    grid = days.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / 64).cast("int"))).alias("word"))
    met = grid.join(words.select("request_id", "day", "word", "found"), ["request_id", "day", "word"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    free = met.where(F.bit_count("found") < F.least(F.lit(64), F.col("count") - F.col("word") * 64))
    at = free.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(63), F.col("count") - F.col("word") * 64 - 1))).alias("at")).where(F.expr("getbit(found, at) = 0"))
    return at.select("request_id", (E.day_start_ms(F.col("day")) + (F.col("word") * 64 + F.col("at")) * F.col("ms")).alias("open_time"))


def issue_counts(merged: DataFrame) -> DataFrame:
    """request_id, code and how many findings it has; one candle may add several (D3)."""
    counts = merged.where("mask <> 0").groupBy("request_id").agg(*[F.sum(R.issue_count(F.col("mask"), c)).alias(c) for c in R.CANDLE_CODES])
    return counts.unpivot("request_id", list(R.CANDLE_CODES), "code", "findings").where("findings > 0")


def bad_candles(merged: DataFrame, rows: DataFrame, limit: int | None = MAX_DETAILS) -> DataFrame:
    """Details of the winning bad rows, the earliest `limit` of each request, with `truncated` (F2)."""
    bad = merged.where("mask <> 0").select("request_id", "open_time", "order_key")
    found = rows.select("request_id", "open_time", "order_key", "path", "mask", "cells").join(bad, ["request_id", "open_time", "order_key"])
    found = found.withColumns(R.candle_fields(F.col("cells"))).select(
        "request_id", "open_time", E.iso_of(F.col("open_time")).alias("timestamp"), E.day_of(F.col("open_time")).alias("day"), "path", "mask", "cells",
        R.issue_codes(F.col("mask")).alias("codes"), R.issues(F.col("mask"), {k: F.col(k) for k in (*R.REQUIRED, *R.OPTIONAL)}).alias("issues"),
    )
    if limit is None:
        return found.withColumn("truncated", F.lit(False))
    counts = merged.where("mask <> 0").groupBy("request_id").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    first = Window.partitionBy("request_id").orderBy("open_time")
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n").join(counts, "request_id")


def archive_stats(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Per request and archive: candles in range, invalid ones, duplicates inside a member, and its health.

    A row counts as a duplicate if its member has had its time before. Archives of a status without rows in range are
    listed by the caller's plan, not here.
    """
    members = rows.groupBy("request_id", "path", "member_idx", "open_time").agg(F.count(F.lit(1)).alias("n"), F.max_by("mask", "ordinal").alias("mask"), F.max("ordinal").alias("o"))
    times = members.groupBy("request_id", "path", "open_time").agg(F.sum(F.col("n") - 1).alias("duplicates"), F.max_by("mask", "o").alias("mask"))
    per = times.groupBy("request_id", "path").agg(F.count(F.lit(1)).alias("candles"), F.count_if(F.col("mask") != 0).alias("invalid"), F.sum("duplicates").alias("duplicates"))
    return per.join(status.select("path", "rows", "error", "valid_zip"), "path", "left")


def summary(days: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row per request: slots, days and archives, and whether nothing is missing, invalid or broken."""
    out = days.groupBy("request_id").agg(
        F.sum("expected").alias("expected"), F.sum("found").alias("found"), F.sum("missing").alias("missing"), F.count_if(F.col("missing") > 0).alias("missing_days"),
        F.sum("invalid").alias("invalid"), F.count_if(F.col("invalid") > 0).alias("invalid_days"),
    )
    if stats is None:
        return out.withColumn("complete", (F.col("missing") == 0) & (F.col("invalid") == 0))
    archives = stats.groupBy("request_id").agg(F.count(F.lit(1)).alias("archives"), F.sum("duplicates").alias("duplicates"), F.count_if(F.col("error").isNotNull()).alias("invalid_archives"))
    met = out.join(archives, "request_id", "left").fillna(0, ["archives", "duplicates", "invalid_archives"])
    return met.withColumn("complete", (F.col("missing") == 0) & (F.col("invalid") == 0) & (F.col("invalid_archives") == 0))


def scan_klines(raw: DataFrame, requests: DataFrame, archives: DataFrame, status: DataFrame, overlay: DataFrame | None = None, limit: int | None = MAX_DETAILS) -> dict[str, DataFrame]:
    """A scan's tables (H5): summary, by_day, issues (counts), details, archives, merged.

    raw: landed rows; requests: request_id, symbol, dataset, interval, start, end; archives: path, dataset, symbol, interval,
    period, key of those that are there; status: health per path; overlay: verified rows.
    """
    rows = cut(compact(rows_in_requests(candle_rows(raw), requests, archives)))
    merged = merge(rows)
    if overlay is not None:
        merged = with_overlay(merged, overlay, requests)
    merged = cut(merged)  # three numbers a candle, read by four of the tables
    days = by_day(merged, requests)
    taking = archive_order(requests, archives).select("request_id", "path")
    stats = archive_stats(rows, status)
    per_archive = taking.join(stats.select("request_id", "path", "candles", "invalid", "duplicates"), ["request_id", "path"], "left").join(
        status.select("path", "rows", "error", "valid_zip"), "path", "left"
    ).fillna(0, ["candles", "invalid", "duplicates"])
    return {
        "summary": summary(days, per_archive), "by_day": days, "issues": issue_counts(merged), "details": bad_candles(merged, rows, limit), "archives": per_archive, "merged": merged,
    }
