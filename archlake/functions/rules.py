"""Row rules of candles and trade events, as Column expressions without UDFs.

A candle's findings are one bigint with a bit for each (code, field): cheap to merge and to aggregate. The details of the
few bad rows are read from the bits afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.functions import exprs as E

REQUIRED = ("open", "high", "low", "close", "volume")
OPTIONAL = {"quote_volume": 7, "trade_count": 8, "taker_buy_base_volume": 9, "taker_buy_quote_volume": 10}

# Fixed values: (code, field) of each bit, in the order in which findings are listed.
CANDLE_BITS: tuple[tuple[str, str | None], ...] = (
    ("OFF_GRID_TIMESTAMP", None),
    ("KLINE_SCHEMA_TOO_SHORT", None),
    *(("INVALID_NUMERIC", f) for f in REQUIRED),
    *(("INVALID_DOMAIN_VALUE", f) for f in REQUIRED),
    ("INVALID_OHLC", None),
    *((code, f) for f in OPTIONAL for code in ("INVALID_NUMERIC", "INVALID_DOMAIN_VALUE")),
    ("TAKER_VOLUME_EXCEEDS_TOTAL", None),
    ("TAKER_QUOTE_VOLUME_EXCEEDS_TOTAL", None),
)
CANDLE_CODES = tuple(dict.fromkeys(code for code, _ in CANDLE_BITS))
#: Findings that a rebuild from trades may mend.
REPAIRABLE = ("TAKER_VOLUME_EXCEEDS_TOTAL", "TAKER_QUOTE_VOLUME_EXCEEDS_TOTAL")


def code_bits(code: str) -> int:
    return sum(1 << i for i, (c, _) in enumerate(CANDLE_BITS) if c == code)


def candle_fields(cells: Column) -> dict[str, Column]:
    """The numbers of a raw candle row, by name."""
    at = {name: i for i, name in enumerate(REQUIRED, 1)} | OPTIONAL
    return {name: E.number(F.get(cells, F.lit(i))) for name, i in at.items()}


def candle_mask(cells: Column, fields: dict[str, Column], dataset: Column, open_time: Column, interval_ms: Column) -> Column:
    """All candle rules (B15-B22) as a bit mask; 0 is a clean row.

    A row with under six columns, and one with a required number missing, isn't looked at further. `fields` are columns
    with the numbers of candle_fields.
    """
    ok = {k: E.finite(v) for k, v in fields.items()}
    short = F.size(cells) < 6
    full = reduce(lambda a, b: a & b, [~short, *[ok[k] for k in REQUIRED]])
    return _mask(fields, ok, short, full, dataset, open_time, interval_ms)


def with_candle_mask(rows: DataFrame, cells: Column, dataset: Column, open_time: Column, interval_ms: Column) -> DataFrame:
    """rows, which have the columns of candle_fields, with candle_mask as `mask`: made in steps, so that no expression holds another one often."""
    names = (*REQUIRED, *OPTIONAL)
    seen = rows.withColumns({**{f"_ok_{k}": E.finite(F.col(k)) for k in names}, "_short": F.size(cells) < 6})
    seen = seen.withColumn("_full", reduce(lambda a, b: a & b, [~F.col("_short"), *[F.col(f"_ok_{k}") for k in REQUIRED]]))
    mask = _mask({k: F.col(k) for k in names}, {k: F.col(f"_ok_{k}") for k in names}, F.col("_short"), F.col("_full"), dataset, open_time, interval_ms)
    return seen.withColumn("mask", mask).drop("_short", "_full", *[f"_ok_{k}" for k in names])


def _mask(f: dict[str, Column], ok: dict[str, Column], short: Column, full: Column, dataset: Column, open_time: Column, interval_ms: Column) -> Column:
    rules: dict[tuple[str, str | None], Column] = {("OFF_GRID_TIMESTAMP", None): F.pmod(open_time, interval_ms) != 0, ("KLINE_SCHEMA_TOO_SHORT", None): short}
    for k in REQUIRED:
        rules["INVALID_NUMERIC", k] = ~short & ~ok[k]
        rules["INVALID_DOMAIN_VALUE", k] = full & ((f[k] < 0) if k == "volume" else (dataset != "premiumIndexKlines") & (f[k] <= 0))
    outside = lambda x: (x < f["low"]) | (x > f["high"])
    rules["INVALID_OHLC", None] = full & ((f["low"] > f["high"]) | outside(f["open"]) | outside(f["close"]))
    for k in OPTIONAL:
        rules["INVALID_NUMERIC", k] = full & f[k].isNotNull() & ~ok[k]
        rules["INVALID_DOMAIN_VALUE", k] = full & ok[k] & (f[k] < 0)

    def exceeds(part: str, total: str) -> Column:
        return full & ok[part] & ok[total] & (f[part] > f[total] + F.greatest(F.abs(f[total]) * 1e-12, F.lit(1e-12)))

    rules["TAKER_VOLUME_EXCEEDS_TOTAL", None] = exceeds("taker_buy_base_volume", "volume")
    rules["TAKER_QUOTE_VOLUME_EXCEEDS_TOTAL", None] = exceeds("taker_buy_quote_volume", "quote_volume")
    bits = [F.when(F.coalesce(rules[bit], F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, bit in enumerate(CANDLE_BITS)]
    return reduce(lambda a, b: a + b, bits)


def issue_count(mask: Column, code: str) -> Column:
    """How many findings of a code a mask has."""
    return F.bit_count(mask.bitwiseAND(F.lit(code_bits(code)).cast("bigint")))


def issue_codes(mask: Column) -> Column:
    """Distinct codes of a mask, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(code_bits(c)).cast("bigint")) != 0, F.lit(c)) for c in CANDLE_CODES]))


def issues(mask: Column, fields: dict[str, Column] | None = None) -> Column:
    """Findings as structs (code, field, value, total, taker), in the order of the rules."""
    none = F.lit(None).cast("double")
    value = fields or {}
    totals = {"TAKER_VOLUME_EXCEEDS_TOTAL": ("volume", "taker_buy_base_volume"), "TAKER_QUOTE_VOLUME_EXCEEDS_TOTAL": ("quote_volume", "taker_buy_quote_volume")}

    def one(i: int, code: str, field: str | None) -> Column:
        total, taker = totals.get(code, (None, None))
        made = F.struct(
            F.lit(code).alias("code"),
            F.lit(field).cast("string").alias("field"),
            (value.get(field, none) if code == "INVALID_DOMAIN_VALUE" else none).alias("value"),
            value.get(total, none).alias("total"),
            value.get(taker, none).alias("taker"),
        )
        return F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, made)

    return F.array_compact(F.array(*[one(i, c, f) for i, (c, f) in enumerate(CANDLE_BITS)]))


def repairable(mask: Column) -> Column:
    """Has findings, and only such as trades may mend."""
    allowed = sum(code_bits(c) for c in REPAIRABLE)
    return (mask != 0) & (mask.bitwiseAND(F.lit(~allowed).cast("bigint")) == 0)


def trade_header(cells: Column) -> Column:
    """A heading, by the name of its first column."""
    first = F.get(cells, F.lit(0))
    # what begins with a digit is no name; nearly all rows do
    return ~F.ascii(first).between(48, 57) & F.regexp_replace(F.lower(first), r"[^\p{L}\p{N}]", "").isin("aggtradeid", "aggregatetradeid", "id")


def trade_fields(cells: Column) -> dict[str, Column]:
    at = lambda i: F.get(cells, F.lit(i))
    return {
        "agg_id": E.integer(at(0)), "price": E.number(at(1)), "quantity": E.number(at(2)), "first_id": E.integer(at(3)), "last_id": E.integer(at(4)),
        "transact_time": E.integer(at(5)), "maker": E.buyer_maker(at(6)),
    }


def trade_error(cells: Column, f: dict[str, Column], previous_id: Column) -> Column:
    """The first rule that a trade event breaks, in the order of the checks, or null."""
    return F.coalesce(trade_row_error(cells, f), trade_order_error(f["agg_id"], previous_id))


def trade_row_error(cells: Column, f: dict[str, Column]) -> Column:
    """The first rule that a trade event breaks by itself, or null; these rules come before those of the order."""
    bad = lambda x: ~(E.finite(x) & F.coalesce(x > 0, F.lit(False)))
    checks = (
        ("SCHEMA_TOO_SHORT", F.size(cells) < 7),
        ("INVALID_AGG_ID", f["agg_id"].isNull()),
        ("INVALID_PRICE", bad(f["price"])),
        ("INVALID_QUANTITY", bad(f["quantity"])),
        ("INVALID_FIRST_ID", f["first_id"].isNull()),
        ("INVALID_LAST_ID", f["last_id"].isNull()),
        ("INVALID_TIME", f["transact_time"].isNull()),
        ("NEGATIVE_ID", (f["agg_id"] < 0) | (f["first_id"] < 0) | (f["last_id"] < 0)),
        ("LAST_BELOW_FIRST", f["last_id"] < f["first_id"]),
        ("TIME_NOT_POSITIVE", f["transact_time"] <= 0),
        ("INVALID_MAKER", f["maker"].isNull()),
    )
    return F.coalesce(*[F.when(test, F.lit(code)) for code, test in checks])


def trade_order_error(agg_id: Column, previous_id: Column) -> Column:
    """The rule that a trade event breaks together with the one before it, or null."""
    return F.when(agg_id == previous_id, F.lit("DUPLICATE_ID")).when(agg_id < previous_id, F.lit("BACKWARD_ID"))
