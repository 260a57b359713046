"""Scalar expressions on Columns. All times are UTC, and no expression depends on the session's time zone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from archlake.functions.dims import DAY_MS

_INTEGER = r"^[+-]?[0-9]{1,19}$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

#: From here on an epoch value is in microseconds.
MICROSECONDS_FROM = 100_000_000_000_000


def integer(cell: Column) -> Column:
    """Trimmed whole number as bigint, else null."""
    text = F.trim(cell)
    return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))


def epoch_ms(cell: Column) -> Column:
    """Epoch milliseconds of a text in milliseconds or microseconds (B1)."""
    value = integer(cell)
    return F.when(value >= MICROSECONDS_FROM, (value - F.pmod(value, F.lit(1000))) / 1000).otherwise(value).cast("bigint")


def number(cell: Column) -> Column:
    """null for an absent or blank cell, NaN for one that isn't a number, else the value (B2)."""
    text = F.trim(cell)
    return F.when(cell.isNull() | (text == ""), F.lit(None).cast("double")).otherwise(
        F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(float("nan")))
    )


def finite(x: Column) -> Column:
    """False for null, NaN and the infinities; in Spark NaN is greater than any number, so every rule asks this first."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def decimal(cell: Column) -> Column:
    """Finite decimal with at most ten digits before and eight after the point, else null."""
    return _exact(cell, "decimal(18,8)")


def wide_decimal(cell: Column) -> Column:
    """Finite decimal with at most 22 digits before and 16 after the point, else null: sums of trades outgrow decimal()."""
    return _exact(cell, "decimal(38,16)")


def _exact(cell: Column, kind: str) -> Column:
    text = F.trim(cell)
    exact = text.rlike(r"^[+-]?[0-9]*\.?[0-9]*[eE]?[+-]?[0-9]*$") & text.rlike(r"[0-9]")
    kept = text.try_cast(kind)
    same = text.try_cast("decimal(38,18)") == kept.try_cast("decimal(38,18)")
    return F.when(exact & F.coalesce(same, F.lit(True)), kept)  # from 10**20 on, where no place after the point could tell


def close(left: Column, right: Column) -> Column:
    """|left - right| <= max(|right| * 1e-10, 1e-8), in decimals."""
    relative = F.abs(right).cast("decimal(38,16)") * F.lit("0.0000000001").cast("decimal(10,10)")
    return F.abs(left.cast("decimal(38,16)") - right.cast("decimal(38,16)")) <= F.greatest(relative.cast("decimal(38,20)"), F.lit("0.00000001").cast("decimal(38,20)"))


def symbol(raw: Column) -> Column:
    """Trimmed, upper-cased, without '/'; null if anything but letters and digits is left."""
    text = F.upper(F.replace(F.trim(raw), F.lit("/"), F.lit("")))
    return F.when(text.rlike(r"^[\p{L}\p{N}]+$"), text)


def symbols(raw: Column) -> Column:
    """Distinct symbols of a list split at commas and blanks, in the order of first mention."""
    parts = F.transform(F.split(F.replace(raw, F.lit(","), F.lit(" ")), r"\s+"), symbol)
    return F.array_distinct(F.array_compact(parts))


def buyer_maker(cell: Column) -> Column:
    """true / false, null for anything unknown."""
    text = F.lower(F.trim(cell))
    return F.when(text.isin("true", "1", "t"), True).when(text.isin("false", "0", "f"), False)


def bucket(ms: Column, length_ms: Column | int) -> Column:
    """Start of the interval that a time is in, for times before 1970 too."""
    length = F.lit(length_ms) if isinstance(length_ms, int) else length_ms
    return ms - F.pmod(ms, length)


def day_of(ms: Column) -> Column:
    """UTC day of epoch milliseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(DAY_MS)).cast("int"))


def iso_of(ms: Column) -> Column:
    """ISO text of epoch milliseconds, to the second, whatever the session's time zone is."""
    at = F.timestamp_add("SECOND", F.floor(ms / F.lit(1000)).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def day_start_ms(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)


def archive_name(dataset: Column, sym: Column, interval: Column, key: Column) -> Column:
    return F.concat(sym, F.lit("-"), F.coalesce(interval, dataset), F.lit("-"), key, F.lit(".zip"))


def archive_path(dataset: Column, sym: Column, period: Column, interval: Column, key: Column) -> Column:
    """Path below the lake's root (B9); families without intervals have a null interval."""
    return F.concat_ws("/", F.lit("raw/futures/um"), period, dataset, sym, interval, archive_name(dataset, sym, interval, key))


def archive_url(base: str, dataset: Column, sym: Column, period: Column, interval: Column, key: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), period, dataset, sym, interval, archive_name(dataset, sym, interval, key))


def overlay_path(sym: Column, interval: Column, day: Column) -> Column:
    file = F.concat(sym, F.lit("-"), interval, F.lit("-"), day.cast("string"), F.lit(".verified-repair.zip"))
    return F.concat_ws("/", F.lit("raw/futures/um/daily/klines"), sym, interval, F.lit("zz_verified_repairs"), file)


#: period / family / symbol / [interval /] file; the key is what the file's name ends with.
_LAYOUT = r"raw/futures/um/(monthly|daily)/([^/]+)/([^/]+)/(?:([^/]+)/)?[^/]*?-(\d{4}-\d{2}(?:-\d{2})?)\.zip$"


def parse_path(path: Column) -> dict[str, Column]:
    """period, dataset, symbol, interval and key of an archive's path; null where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(path, _LAYOUT, i), F.lit(""))
    return {"period": part(1), "dataset": part(2), "symbol": part(3), "interval": part(4), "key": part(5)}


def key_first_day(key: Column) -> Column:
    return F.to_date(F.when(F.length(key) == 7, F.concat(key, F.lit("-01"))).otherwise(key))


def key_last_day(key: Column) -> Column:
    return F.when(F.length(key) == 7, F.last_day(key_first_day(key))).otherwise(key_first_day(key))


def duration_text(seconds: Column) -> Column:
    """HH:MM:SS, a dash for null."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    return F.when(seconds.isNull(), F.lit("—")).otherwise(
        F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint"), F.pmod(s, F.lit(60)))
    )


def fixed(value: Column, places: int) -> Column:
    """A double as text with one or more decimals, rounded by its exact binary value as in C and Python (a tie to the even digit).

    format_string rounds the shortest decimal text of a double, so that 0.15, which is a little less, becomes 0.2. Here the
    value times a power of ten is a whole number, a fraction and the product's rounding error, all of them exact (Dekker).
    Only values near a tie are worked out so; others, as well as those from 2**52 / 10**places on, are left to format_string.
    """
    scale = 10**places
    halves = lambda x: F.struct(x.alias("x"), (x * 134217729.0 - (x * 134217729.0 - x)).alias("h"))
    exact = F.abs(value) < float((1 << 52) // scale)
    steps = F.transform(F.array(halves(F.when(exact, F.abs(value)).otherwise(0.0))), lambda s: F.struct(s["x"].alias("x"), s["h"].alias("h"), (s["x"] * float(scale)).alias("p")))
    steps = F.transform(steps, lambda s: F.struct(s["p"].alias("p"), F.floor(s["p"]).alias("n"), (s["h"] * float(scale) - s["p"] + (s["x"] - s["h"]) * float(scale)).alias("e")))
    over = lambda s: s["p"] - s["n"].cast("double") - 0.5
    up = lambda s: (over(s) > 0) | (over(s) == 0) & ((s["e"] > 0) | (s["e"] == 0) & (s["n"] % 2 == 1))
    whole = F.transform(steps, lambda s: s["n"] + F.when(up(s), 1).otherwise(0))[0]
    text = F.transform(F.array(whole), lambda n: F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(scale)).cast("string"), places, "0")))[0]
    p = F.abs(value) * float(scale)
    tie = exact & ((F.abs(p - F.floor(p) - 0.5) < 1e-3) | (p > 1e9))
    return F.when(tie, F.concat(F.when(value < 0, "-").otherwise(""), text)).otherwise(F.format_string(f"%.{places}f", value))


def size_text(size: Column) -> Column:
    """Bytes with two decimals and a unit of 1024."""
    value = F.coalesce(size.cast("double"), F.lit(0.0))
    units = [(F.lit(1024.0) ** k, name) for k, name in enumerate(("B", "KB", "MB", "GB", "TB"))]
    unit = reduce(lambda rest, u: F.when(value < u[0] * 1024, F.struct((value / u[0]).alias("v"), F.lit(u[1]).alias("u"))).otherwise(rest), reversed(units[:-1]), F.struct((value / units[-1][0]).alias("v"), F.lit("TB").alias("u")))
    return F.transform(F.array(unit), lambda x: F.concat(fixed(x["v"], 2), F.lit(" "), x["u"]))[0]


def speed_text(bytes_per_second: Column) -> Column:
    bps = F.coalesce(bytes_per_second.cast("double"), F.lit(0.0))
    return F.concat(fixed(bps / 1048576, 2), F.lit(" MB/s  ("), fixed(bps * 8 / 1000000, 1), F.lit(" Mbps)"))
