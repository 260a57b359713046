"""Rebuilding of candles from aggregate trades, with a proof; the first step of it that fails is the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.functions import exprs as E
from archlake.functions import rules as R
from archlake.operators.klines import interval_length
from archlake.sources.shared import cut

#: Name of the method in the records that this library writes.
METHOD = "AGGREGATE_TRADES_RECONSTRUCTION"

# Columns of a candle row.
PRICES = {"open": 1, "high": 2, "low": 3, "close": 4}
VOLUMES = {"volume": 5, "quote_volume": 7, "taker_buy_base_volume": 9, "taker_buy_quote_volume": 10}

_TARGET = ("symbol", "interval", "open_time")


def evidence(raw_trades: DataFrame) -> DataFrame:
    """Typed rows of trade archives (A8): rows with under seven columns, and those without a whole id or time, are left out."""
    c = lambda i: F.get("cells", F.lit(i))
    rows = raw_trades.where(F.size("cells") >= 7).select(
        "symbol", E.integer(c(0)).alias("agg_id"), E.epoch_ms(c(5)).alias("ms"), E.decimal(c(1)).alias("price"), E.decimal(c(2)).alias("quantity"),
        E.integer(c(3)).alias("first_id"), E.integer(c(4)).alias("last_id"), E.buyer_maker(c(6)).alias("maker"),
    )
    return rows.where("agg_id is not null and ms is not null")


def trades_of(targets: DataFrame, trades: DataFrame) -> DataFrame:
    """Trades inside the target candles (C6). The targets are few; Spark broadcasts them if their size allows."""
    codes = targets.select("symbol", "interval").distinct().withColumn("ms_long", interval_length(F.col("interval")))
    each = trades.join(codes, "symbol").withColumn("open_time", F.col("ms") - F.pmod("ms", "ms_long"))
    return each.join(targets.select(*_TARGET).distinct(), list(_TARGET), "left_semi")


def rebuild(trades: DataFrame) -> DataFrame:
    """Candles of trades that carry symbol, interval and open_time (D9), whether their ids are contiguous (E4) and whether
    every row can be evidence (`sound`)."""
    order = Window.partitionBy(*_TARGET).orderBy("ms", "agg_id")
    ok = (F.col("price") > 0) & (F.col("quantity") > 0) & (F.col("last_id") >= F.col("first_id")) & F.col("maker").isNotNull()
    rows = trades.withColumns({"_before": F.lag("last_id").over(order), "_ok": F.coalesce(ok, F.lit(False))})
    at, amount = F.struct("ms", "agg_id"), F.col("price") * F.col("quantity")
    return rows.groupBy(*_TARGET).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").cast("decimal(38,8)").alias("volume"), F.sum(amount).cast("decimal(38,16)").alias("quote_volume"),
        F.coalesce(F.sum(F.when(~F.col("maker"), F.col("quantity"))), F.lit(0)).cast("decimal(38,8)").alias("taker_buy_base_volume"),
        F.coalesce(F.sum(F.when(~F.col("maker"), amount)), F.lit(0)).cast("decimal(38,16)").alias("taker_buy_quote_volume"),
        F.sum(F.col("last_id") - F.col("first_id") + 1).alias("trade_count"),
        F.bool_and(F.col("_before").isNull() | (F.col("first_id") == F.col("_before") + 1)).alias("contiguous"), F.bool_and("_ok").alias("sound"),
    )


def rebuilt_cells(ms: Column) -> Column:
    """The rebuilt row as text cells, with the end of the interval and a last column of 0."""
    text = lambda c: F.col("r_" + c).cast("string")
    return F.array(
        F.col("open_time").cast("string"), *[text(c) for c in PRICES], text("volume"), (F.col("open_time") + ms - 1).cast("string"), text("quote_volume"), text("trade_count"),
        text("taker_buy_base_volume"), text("taker_buy_quote_volume"), F.lit("0"),
    )


def reconstruct(originals: DataFrame, trades: DataFrame, available_days: DataFrame) -> DataFrame:
    """Every target with its verdict and, where the proof holds, the rebuilt cells.

    originals: symbol, interval, open_time, codes, cells (of the bad row; null if it can't be read again); trades: evidence()
    rows; available_days: symbol, day of the daily trade archives that are there. Verdict 'verified', or the first failing
    step: evidence unavailable, source row unavailable, invalid evidence row, schema incomplete, ids not contiguous, trade
    count (unavailable or different), a price, more than one volume, candle rules.
    """
    targets = cut(originals.withColumns({"day": E.day_of(F.col("open_time")), "ms": interval_length(F.col("interval"))}))  # few rows, used three times
    there = available_days.select("symbol", "day").distinct().withColumn("_there", F.lit(True))
    made = cut(rebuild(trades_of(targets, trades)))
    made = made.select(*_TARGET, *[F.col(c).alias("r_" + c) for c in made.columns if c not in _TARGET])
    met = targets.join(there, ["symbol", "day"], "left").join(made, list(_TARGET), "left")
    # step by step, so that no expression holds another one several times
    met = met.withColumns({f"o_{n}": E.wide_decimal(F.get("cells", F.lit(i))) for n, i in (PRICES | VOLUMES).items()})
    met = met.withColumn("o_trade_count", E.decimal(F.get("cells", F.lit(8))))
    met = met.withColumns({f"a_{n}": F.coalesce(E.close(F.col("o_" + n), F.col("r_" + n)), F.lit(False)) for n in PRICES | VOLUMES})
    met = met.withColumn("matching", F.array_compact(F.array(*[F.when(F.col("a_" + n), F.lit(n)) for n in VOLUMES])))
    count = F.col("o_trade_count")
    met = met.withColumns({k: F.col("r_" + k).cast("double") for k in (*R.REQUIRED, *R.OPTIONAL)})
    met = R.with_candle_mask(met, F.array(*[F.lit("")] * 12), F.lit("klines"), F.col("open_time"), F.col("ms"))
    met = met.withColumns({"price": F.coalesce(*[F.when(~F.col("a_" + n), F.lit(f"{n} differs")) for n in PRICES])})
    verdict = (
        F.when(F.col("_there").isNull(), "evidence unavailable")
        .when(F.col("cells").isNull(), "source row unavailable")
        .when(F.coalesce(~F.col("r_sound"), F.lit(False)), "invalid evidence row")
        .when((F.size("cells") < 11) | F.col("r_trade_count").isNull(), "schema incomplete")
        .when(~F.col("r_contiguous"), "trade ids not contiguous")
        .when(count.isNull(), "trade count unavailable")
        .when(count != F.col("r_trade_count"), "trade count differs")
        .when(F.col("price").isNotNull(), F.col("price"))
        .when(F.size("matching") < 3, "volumes differ")
        .when(F.col("mask") != 0, "candle rules")
        .otherwise("verified")
    )
    done = met.select(*_TARGET, "day", "codes", "cells", rebuilt_cells(F.col("ms")).alias("new_cells"), "matching", verdict.alias("verdict"))
    return cut(done.withColumn("new_cells", F.when(F.col("verdict") == "verified", F.col("new_cells"))))  # few rows, read by reports, overlay and provenance


def overlay_rows(verdicts: DataFrame) -> DataFrame:
    """Rows for the overlay table."""
    return verdicts.where("verdict = 'verified'").select("symbol", "interval", "day", F.col("open_time").alias("timestamp_ms"), F.col("new_cells").alias("cells"))


def provenance(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Records for the provenance table: sources has symbol, interval, open_time, source_path, source_sha256, evidence_path, evidence_sha256."""
    met = verdicts.where("verdict = 'verified'").join(sources, list(_TARGET), "left")
    return met.select(
        "symbol", "interval", "day", F.col("open_time").alias("timestamp_ms"), E.iso_of(F.col("open_time")).alias("timestamp"), F.col("codes").alias("original_issue_codes"),
        F.lit(METHOD).alias("method"), "source_path", "source_sha256", "evidence_path", "evidence_sha256", F.col("matching").alias("matching_volume_fields"),
        F.col("cells").alias("original_row"), F.col("new_cells").alias("reconstructed_row"),
    )


def totals(verdicts: DataFrame) -> DataFrame:
    """Per symbol, interval and day: candles rebuilt and refused."""
    good = F.col("verdict") == "verified"
    return verdicts.groupBy("symbol", "interval", "day").agg(F.count_if(good).alias("reconstructed"), F.count_if(~good).alias("refused"))
