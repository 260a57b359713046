"""More registered queries: landing, probes, overlays, repair planning, validation, reports and rates, each with its SQL.

The inputs are derived from the driver's tables, as in `queries`. Archives that a query lands are zipped by Spark tasks from trades.
"""

from __future__ import annotations

import io
import itertools
import operator
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.functions import dims
from archlake.functions import exprs as E
from archlake.functions import rules as R
from archlake.operators import estimate, klines, reconstruct, report, rounds, throughput, trades
from archlake.operators.increments import IncrementalScan
from archlake.plans import planning
from archlake.queries import (
    _CODES_LIST, _DAY, _FALLBACK_SQL, _PLAN_SQL, HOUR, SQL_HOURLY, SQL_REQUESTS, SQL_ROWS, SQL_TRADES, _cells, _log, _merged, _numbered, archived_hourly, candle_archives, event_trades, hourly, plan_requests, priced, query, scan_requests, table,
)
from archlake.sources import landing, tables
from archlake.sources.logs import CompactedLog
from archlake.sources.shared import cut, remove, scratch

# ---------------------------------------------------------------- landing


def _zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of daily trade archives; of every fifth day the second member is a copy of the first lines, of every
    seventh the file is broken, of every eleventh it holds no CSV member, and every third day has a heading."""
    t = event_trades(spark, sf_dir).withColumn("day", E.day_of(F.col("ms")))
    line = F.concat_ws(",", "agg_id", F.col("price").cast("string"), F.col("quantity").cast("string"), "agg_id", "agg_id", "ms", F.col("maker").cast("string"))
    path = E.archive_path(F.lit("aggTrades"), F.col("symbol"), F.lit("daily"), F.lit(None).cast("string"), F.col("day").cast("string"))
    lines = t.select(path.alias("path"), F.dayofmonth("day").alias("d"), F.col("agg_id").alias("n"), line.alias("line"))

    def members(d: int, texts: Iterator[memoryview]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            head = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n" if d % 3 == 0 else ""
            first = write_lines(z, "rows.txt" if d % 11 == 0 else "rows.csv", texts, head)
            if d % 5 == 0:
                z.writestr("some.csv", first[:20])
        return b"broken" if d % 7 == 0 else out.getvalue()

    return archives_of_lines(lines.repartition("path"), members)


def write_lines(z: zipfile.ZipFile, name: str, texts: Iterator[memoryview], head: str = "") -> str:
    """Write a member from texts of whole lines, without a line's end at its end; returns the first line."""
    first = next(texts)
    info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    info.compress_type = z.compression
    with z.open(info, "w", force_zip64=True) as out:
        out.write(head.encode())
        out.write(first)
        for text in texts:
            out.write(b"\n")
            out.write(text)
    return bytes(first).partition(b"\n")[0].decode()


def archives_of_lines(dealt: DataFrame, made: Callable[[int, Iterator[memoryview]], bytes]) -> DataFrame:
    """path and content of archives, which `made` packs from rows (path, d, n, line): d of the path, and its lines in the order of n.

    dealt: rows of a path are in one partition. Lines reach a task sorted, a batch at a time, and are packed as they come, each
    batch as one text, so that a task holds a packed archive but no whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, d), parts in itertools.groupby(_texts(batches), key=operator.itemgetter(0, 1)):
            yield pa.record_batch([pa.array([path]), pa.array([made(d, (p[2] for p in parts))], pa.binary())], names=["path", "content"])

    return dealt.select("path", "d", "n", "line").sortWithinPartitions("path", "n", "line").select("path", "d", "line").mapInArrow(run, "path string, content binary")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, memoryview]]:
    """path, d and the lines of each run of rows with one path, as one text without a line's end at its end."""
    wide = pa.large_string()
    for batch in batches:
        begin = 0
        for end in pc.run_end_encode(batch.column(0)).run_ends.to_pylist():
            lines = pc.binary_join_element_wise(batch.column(2).slice(begin, end - begin).cast(wide), pa.scalar("", wide), pa.scalar("\n", wide))
            places = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
            yield batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py(), memoryview(lines.buffers()[2])[places[0] : places[-1] - 1]
            begin = end


_ZIP_SQL = f"""with {SQL_TRADES}, a as (
  select symbol, {_DAY.format("ms")} as day, count(*) as n, sum(agg_id) as ids, min(agg_id) as least from t group by 1, 2
), z as (
  select *, day(day) as d, day(day) % 7 = 0 as broken, day(day) % 11 <> 0 as whole, day(day) % 5 = 0 as extra, day(day) % 3 = 0 as head from a
)"""


@query(
    f"{_ZIP_SQL} select 'daily' as period, 'aggTrades' as dataset, symbol, cast(day as varchar) as key, cast(case when broken then 0 else case when whole then n + cast(head as int) else 0 end + cast(extra as int) end as bigint) as rows, "
    "cast(case when broken then 0 else cast(whole as int) + cast(extra as int) end as int) as csv_members, case when broken then 'not a ZIP file' when not whole and not extra then 'no CSV member' end as error, not broken as valid_zip from z"
)
def landing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives landed, with the parts of their paths and their health."""
    landed = cut(landing.with_keys(landing.land(_zips(spark, sf_dir))))
    keys = landed.select("path", "period", "dataset", "symbol", "key").distinct()
    return landing.archive_status(landed).join(keys, "path").select("period", "dataset", "symbol", "key", "rows", "csv_members", "error", "valid_zip")


@query(f"{_ZIP_SQL} select symbol, cast(day as varchar) as key, n as trades, cast(ids as bigint) as ids, least as first_agg_id, cast(1 + cast(head as int) as bigint) as first_row from z where not broken and whole")
def landed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed trades of each archive's largest member, headings left out."""
    landed = cut(landing.with_keys(landing.land(_zips(spark, sf_dir))))
    rows = trades.trade_rows(landing.largest_member(landing.raw_rows(landed)))
    return rows.groupBy("symbol", "key").agg(F.count(F.lit(1)).alias("trades"), F.sum("agg_id").alias("ids"), F.min("agg_id").alias("first_agg_id"), F.min("row_number").alias("first_row"))


@query(f"{_ZIP_SQL} select symbol, cast(sum(n) as bigint) as trades, cast(sum(ids) as bigint) as ids from z where not broken and whole group by 1")
def landed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as evidence for rebuilt candles, from landed archives; a heading has no id, so that it is none."""
    landed = cut(landing.with_keys(landing.land(_zips(spark, sf_dir))))
    found = reconstruct.evidence(landing.largest_member(landing.raw_rows(landed)))
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("agg_id").alias("ids"))


@query(
    f"{_ZIP_SQL} select symbol, cast(day as varchar) as key, case when d % 4 = 0 then 'checksum missing' when d % 4 = 1 then 'mismatch' else 'ok' end as verdict, "
    "case when broken then 'not a ZIP file' when not whole and not extra then 'no CSV member' end as error from z"
)
def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests against checksum files, whose text has another case and a file name, and readability."""
    zips = cut(_zips(spark, sf_dir).withColumn("length", F.length("content").cast("long")))
    d = F.dayofmonth(F.to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.zip$", 1)))
    said = F.when(d % 4 == 1, F.lit("00")).otherwise(F.upper(F.sha2("content", 256)))
    sums = landing.checksum_texts(zips.where(d % 4 != 0).select("path", F.concat(said, F.lit("  name.zip\n")).alias("text")))
    landed = landing.with_keys(landing.land(zips))
    met = landing.verify(landing.digests(zips), sums).join(landing.archive_status(landed).select("path", "error"), "path")
    parts = E.parse_path(F.col("path"))
    return met.select(parts["symbol"].alias("symbol"), parts["key"].alias("key"), "verdict", "error")


def _member(out: io.BytesIO | pa.NativeFile, texts: Iterator[memoryview]) -> None:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        write_lines(z, "rows.csv", texts)


def zipped(lines: DataFrame) -> DataFrame:
    """path and content of archives with one CSV member, from rows (path, n, line); lines are in the order of n."""

    def member(_: int, texts: Iterator[memoryview]) -> bytes:
        out = io.BytesIO()
        _member(out, texts)
        return out.getvalue()

    return archives_of_lines(lines.withColumn("d", F.lit(0)).repartition("path"), member)


def packed(lines: DataFrame, root: str) -> DataFrame:
    """Write the archives of zipped() below root, in tasks and as they are packed: a large one is no value anywhere; returns
    path and length. A few large archives are a task each: paths are dealt by ranges, as hashes would put some of them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, parts in itertools.groupby(_texts(batches), key=operator.itemgetter(0)):
            with landing.new_file(root, path) as out:
                _member(out, (p[2] for p in parts))
                size = out.tell()
            yield pa.record_batch([pa.array([path]), pa.array([size], pa.int64())], names=["path", "length"])

    dealt = lines.select("path", F.lit(0).alias("d"), "n", "line").repartitionByRange("path")
    return dealt.sortWithinPartitions("path", "n", "line").select("path", "d", "line").mapInArrow(run, "path string, length long")


def fetch_from(offers: DataFrame, source: str, root: str) -> rounds.Fetch:
    """A fetch step that takes what is offered (path of files below source) and copies it below the root in tasks."""

    def fetch(plan: DataFrame) -> DataFrame:
        got = cut(landing.copied(offers.join(plan.select("path").distinct(), "path", "left_semi"), source, root))
        return plan.join(got.select("path", F.lit("downloaded").alias("status")), "path", "left").na.fill("missing", ["status"])

    return fetch


@query(
    f"with {SQL_HOURLY}, {SQL_REQUESTS}, b as (select symbol, {_DAY.format('open_time')} as day, open_time // 3600000 as h, ascii(symbol) % 2 = 0 as even from c), "
    "n as (select symbol, day, count(*) as n, count(*) filter (h % case when even then 5 else 7 end <> 0) as m from b group by 1, 2), "
    "d as (select request_id, cast(unnest(generate_series(first, last, interval 1 day)) as date) as day from r), "
    "x as (select request_id, d.day, coalesce(n, 0) as n, coalesce(m, 0) as m, ascii(request_id) % 2 = 0 as even, day(d.day) % 3 <> 0 and coalesce(n, 0) > 0 as offered from d left join n on n.symbol = request_id and n.day = d.day), "
    "y as (select *, 24 - case when even then m else 0 end as was, 24 - case when m < 24 and offered then n else m end as missing from x) "
    "select request_id, cast(day as varchar) as day, cast(missing as bigint) as missing, case when missing = 0 then 'Repaired' when not offered then 'Daily archive unavailable' else 'Still missing after repair' end as status "
    "from y where was > 0 or missing > 0"
)
def repair_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round over a lake that holds months with gaps for half of the symbols: months come for
    the others, then days for what is missing, but not every third one, and the report says what is left."""
    root, source = scratch(spark, "archives"), scratch(spark, "offers")
    requests = cut(scan_requests(spark, sf_dir))
    base = archived_hourly(spark, sf_dir).withColumns({"h": (F.col("open_time") / HOUR).cast("bigint"), "day": E.day_of(F.col("open_time"))})
    base = cut(base.select("symbol", "interval", "h", "day", F.array_join(_cells(False), ",").alias("line")))
    even = F.ascii("symbol") % 2 == 0
    path = lambda period, key: E.archive_path(F.lit("klines"), F.col("symbol"), F.lit(period), F.col("interval"), key).alias("path")
    month = base.where(F.pmod("h", F.when(even, 5).otherwise(7)) != 0).select("symbol", path("monthly", F.date_format("day", "yyyy-MM")), F.col("h").alias("n"), "line")
    days = base.where(F.dayofmonth("day") % 3 != 0).select(path("daily", F.col("day").cast("string")), F.col("h").alias("n"), "line")
    cut(packed(month.where(even), root))
    offers = cut(packed(month.where(~even).drop("symbol").unionByName(days), source))
    out = rounds.repair_round(rounds.Lake(spark, root), requests, fetch_from(offers, source, root), F.lit("2024-06-05").cast("date"))
    return out["report"].select("request_id", F.col("day").cast("string").alias("day"), "missing", "status")


@query(
    f"with {SQL_TRADES}, {SQL_REQUESTS}, d as (select symbol, {_DAY.format('ms')} as day from t group by 1, 2), x as (select request_id, (ascii(request_id) + length(request_id)) % 3 as m, last - first + 1 as days, "
    "(select count(*) from d where d.symbol = request_id and day(day) % 4 <> 0) as came from r) "
    "select request_id, m = 0 as complete_before, cast(case when m < 2 then 1 else days end as bigint) as archives_scanned, cast(case when m < 2 then 0 else days - came end as bigint) as missing_archives, "
    "cast(0 as bigint) as invalid_archives, m < 2 or days = came as complete from x"
)
def trade_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round over monthly trade archives: some are good, some come again and are good then, and those
    that stay bad are put aside for their days, of which every fourth isn't offered."""
    root, source = scratch(spark, "archives"), scratch(spark, "offers")
    span = scan_requests(spark, sf_dir).select("request_id", "symbol", "start", "end")
    month = span.select("request_id", F.lit("aggTrades").alias("dataset"), "symbol", F.lit("monthly").alias("period"), F.date_format("start", "yyyy-MM").alias("key"), F.lit(None).cast("string").alias("interval"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    plan = cut(month.join(planning.plan_rows(month).select("symbol", "path"), "symbol"))
    kind = F.pmod(F.ascii("symbol") + F.length("symbol"), F.lit(3))
    line = F.concat_ws(",", "agg_id", F.col("price").cast("string"), F.col("quantity").cast("string"), "agg_id", "agg_id", "ms", F.col("maker").cast("string"))
    t = cut(priced(event_trades(spark, sf_dir)).select("symbol", "agg_id", "ms", line.alias("line")))
    path = lambda period, key: E.archive_path(F.lit("aggTrades"), F.col("symbol"), F.lit(period), F.lit(None).cast("string"), key).alias("path")
    whole = t.join(plan.select("symbol", "key"), "symbol").select("symbol", path("monthly", F.col("key")), F.col("agg_id").alias("n"), "line")
    twice = lambda bad: F.when(bad, F.concat_ws("\n", "line", "line")).otherwise(F.col("line")).alias("line")  # each id twice
    cut(packed(whole.select("path", "n", twice(kind > 0)), root))
    day = E.day_of(F.col("ms"))
    days = t.where((kind == 2) & (F.dayofmonth(day) % 4 != 0)).select(path("daily", day.cast("string")), F.col("agg_id").alias("n"), "line")
    again = landing.copied(plan.where(kind == 2), root, source)  # as bad as before
    offers = cut(packed(whole.where(kind == 1).select("path", "n", "line").unionByName(days), source).unionByName(again))

    def aside(months: DataFrame) -> None:
        for r in months.select("path").collect():  # a month for each symbol
            remove(spark, f"{root}/{r['path']}")

    out = rounds.trade_repair_round(rounds.Lake(spark, root), plan, fetch_from(offers, source, root), aside)
    after = out["after"]["summary"].drop("missing_keys", "invalid_keys")
    return out["before"]["summary"].select("request_id", F.col("complete").alias("complete_before")).join(after, "request_id")


@query(f"with {SQL_HOURLY} select symbol, count(*) as candles, cast(sum(open_time) as bigint) as times from c group by 1")
def candle_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, blank rows and rows without a time among the candle rows of an archive aren't candles."""
    base = hourly(spark, sf_dir).select("symbol", "open_time", F.array(F.col("open_time").cast("string"), *[F.lit("1")] * 5).alias("cells"))
    texts = [F.array(F.lit("open_time"), F.lit("open")), F.array(F.lit("")), F.array(F.lit(" "), F.lit("1")), F.array(F.lit("12x"), F.lit("1"))]
    rows = base.select("symbol", F.explode(F.array("cells", *texts)).alias("cells")).withColumns({"dataset": F.lit("klines"), "interval": F.lit("1h")})
    return klines.candle_rows(rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("candles"), F.sum("open_time").alias("times"))


@query(
    f"with {SQL_HOURLY}, f as (select *, open_time // 3600000 as h from c) select symbol, cast(open_time as bigint) as open_time, "
    "concat_ws(',', case when h % 7 = 0 then 'INVALID_NUMERIC:quote_volume' end, case when h % 11 = 0 then 'INVALID_DOMAIN_VALUE:trade_count' end, case when h % 13 = 0 then 'INVALID_NUMERIC:taker_buy_base_volume' end) as found from f where h % 7 = 0 or h % 11 = 0 or h % 13 = 0"
)
def optional_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of optional fields, of premium index candles too, whose prices may be negative."""
    h = F.col("open_time") / HOUR
    on = lambda n, bad, good: F.when(F.pmod(h, F.lit(n)) == 0, bad).otherwise(good)
    premium = F.pmod(h, F.lit(2)) == 0
    price = F.when(premium, F.lit("-0.5")).otherwise(F.lit("0.5"))
    cells = F.array(
        F.col("open_time").cast("string"), price, price, price, price, F.lit("10"), F.lit(""), on(7, F.lit("n/a"), F.lit("20")), on(11, F.lit("-1"), F.lit("3")), on(13, F.lit("inf"), F.lit("5")), F.lit(" "),
    )
    rows = hourly(spark, sf_dir).select("symbol", "open_time", cells.alias("cells"), F.when(premium, "premiumIndexKlines").otherwise("klines").alias("dataset"), F.lit("1h").alias("interval"))
    listed = F.transform(R.issues(F.col("mask"), {k: F.col(k) for k in (*R.REQUIRED, *R.OPTIONAL)}), lambda x: F.concat(x["code"], F.lit(":"), x["field"]))
    found = cut(klines.candle_rows(rows).select("symbol", "open_time", "mask", F.array_join(listed, ",").alias("found")))
    return found.where("mask <> 0").select("symbol", "open_time", "found")


@query(
    f"with {SQL_ROWS}, bad as (select *, row_number() over (partition by request_id order by open_time) as n, count(*) over (partition by request_id) as k from merged where mask <> 0) "
    f"select request_id, cast(open_time as bigint) as open_time, array_to_string({_CODES_LIST}, ',') as codes, k > 5 as truncated from bad where n <= 5"
)
def bad_candles_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a report that lists five bad candles of each request only, and says where there are more."""
    merged, rows, _ = _merged(spark, sf_dir)
    return klines.bad_candles(merged, rows, 5).select("request_id", "open_time", F.array_join("codes", ",").alias("codes"), "truncated")


# ---------------------------------------------------------------- logs, probes and overlays

_PROBE_NOW = 60_000


@query(
    "with p as (select 'u' || (o_custkey % 700) as url, case o_orderstatus when 'F' then 'available' when 'O' then 'missing' else 'error' end as status, o_orderkey % 5000 as bytes, "
    "case when o_orderkey % 13 = 0 then '?' || o_orderkey else strftime(timestamp '2024-01-01' + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S') end as checked_at from orders), "
    "w as (select *, row_number() over (partition by url order by checked_at desc) as n from p where status <> 'error') "
    f"select url, status, cast(bytes as bigint) as bytes from w where n = 1 and (status = 'available' or checked_at[1:1] <> '?' and epoch(timestamp '2024-01-01' + to_seconds({_PROBE_NOW})) - epoch(cast(checked_at as timestamp)) <= 43200)"
)
def probe_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest probe of each address, if it still holds."""
    k = F.col("o_orderkey")
    at = F.date_format(F.timestamp_add("SECOND", k.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    status = F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "O", "missing").otherwise("error")
    log = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("u"), F.col("o_custkey") % 700).alias("url"), status.alias("status"), (k % 5000).cast("long").alias("bytes"), F.when(k % 13 == 0, F.concat(F.lit("?"), k)).otherwise(at).alias("checked_at")
    )
    # two thirds are the base of a compacted log, the rest comes later
    logged = CompactedLog(spark, scratch(spark, "log"), "url string, status string, bytes long, checked_at string, k long", ("url",), ("checked_at", "k"), buckets=16)
    for part in (0, 1):
        logged.append(tables.probes(log.withColumn("k", k)).where(k % 3 == 2 if part else k % 3 != 2))
        logged.compact(always=not part)
    return tables.usable_probes(logged.latest(), F.timestamp_add("SECOND", F.lit(_PROBE_NOW), F.lit("2024-01-01 00:00:00").cast("timestamp")))


@query(
    "with a as (select 'S' || (o_custkey % 90) as symbol, o_orderkey as seq, o_orderkey % 1000 as bytes, row_number() over (partition by o_custkey % 90 order by o_orderkey desc) as n, count(*) over (partition by o_custkey % 90) as entries from orders) "
    "select symbol, seq, bytes, entries from a where n = 1"
)
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was appended to twice, and the newest entry of each key."""
    path = scratch(spark, "log")
    log = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 90).alias("symbol"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000).alias("bytes"))
    for half in (0, 1):
        tables.append(log.where(F.col("seq") % 2 == half), path)
    whole = tables.read(spark, path)
    return tables.latest(whole, ("symbol",), "seq").join(whole.groupBy("symbol").agg(F.count(F.lit(1)).alias("entries")), "symbol").select("symbol", "seq", "bytes", "entries")


@query(
    "with r as (select arg_max(o_orderkey % 977, {'a': o_orderkey * 37 % 9973, 'b': o_orderkey}) as speed, max(o_orderkey * 37 % 9973) as t from orders), "
    "b as (select arg_max((l_orderkey + l_linenumber) % 811, {'a': l_orderkey * 41 % 9967, 'b': l_orderkey * 10 + l_linenumber}) as speed, max(l_orderkey * 41 % 9967) as t from lineitem), "
    "u as (select *, 'latest collection average' as source from r union all select *, 'latest Auto Tune' from b) "
    "select cast(speed as double) as speed_mbps, source from (select *, row_number() over (order by t desc, source desc) as n from u where speed > 0) where n = 1"
)
def latest_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the speed that the newer of the latest run and the latest benchmark had."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    runs = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 9973).alias("started_at"), (F.col("o_orderkey") % 977).alias("average_mbps"))
    tuned = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 41 % 9967).alias("started_at"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 811).alias("recommended_mbps"))
    return tables.latest_speed(runs, tuned)


@query(
    "with p as (select o_orderkey as path, sum(case when l_linenumber = 1 then l_partkey % 1000 end) as single, sum(case when l_linenumber > 1 then l_partkey % 1000 end) as segments, any_value(o_orderkey % 1500) as remote from lineitem join orders on l_orderkey = o_orderkey group by 1) "
    "select path, cast(least(remote, greatest(coalesce(single, 0), coalesce(segments, 0))) as bigint) as local_bytes from p"
)
def partial_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of unfinished files on disk, in a single part or in segments."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("segment"), (F.col("l_partkey") % 1000).alias("length"))
    remote = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 1500).alias("remote_bytes"))
    return tables.partial_bytes(parts, remote).select("path", F.col("local_bytes").cast("long").alias("local_bytes"))


@query(
    f"with {SQL_HOURLY}, f as (select symbol, open_time, open_time // 3600000 as h from c) "
    "select symbol, cast(open_time as bigint) as timestamp_ms, case when h % 3 = 0 then 'new' else 'old' end as version from f where h % 2 = 0 or h % 3 = 0"
)
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlay that was written twice: the new row wins where both have a time, other rows stay."""
    path = scratch(spark, "overlay")
    h = F.col("timestamp_ms") / HOUR
    rows = hourly(spark, sf_dir).select("symbol", F.lit("1h").alias("interval"), E.day_of(F.col("open_time")).alias("day"), F.col("open_time").alias("timestamp_ms"))
    shape = ["symbol", "interval", "day", "timestamp_ms", "cells"]
    for step, name in ((2, "old"), (3, "new")):
        written = rows.where(F.pmod(h, F.lit(step)) == 0).withColumn("cells", F.array(F.lit(name))).select(*shape)
        tables.write_overlay(written, path)
    return tables.read_overlay(spark, path, written.schema).select("symbol", "timestamp_ms", F.get("cells", F.lit(0)).alias("version"))


@query(
    "select o_orderkey as id, cast(o_orderkey * 1000 as bigint) as timestamp_ms, case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then 'A' else 'A,B' end as codes from orders where o_orderkey % 5 <> 0"
)
def overlay_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the original codes of provenance records; those with an unreadable time are left out, missing codes are none."""
    k = F.col("o_orderkey")
    codes = F.when(k % 3 == 1, F.array(F.lit("A"))).when(k % 3 == 2, F.array(F.lit("A"), F.lit("B")))
    records = table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, F.lit("?")).otherwise((k * 1000).cast("string")).alias("timestamp_ms"), codes.alias("original_issue_codes"))
    found = tables.overlay_codes(records)
    return found.select(F.floor(F.col("timestamp_ms") / 1000).cast("long").alias("id"), "timestamp_ms", F.array_join("original_issue_codes", ",").alias("codes"))


@query("select 's' || s_suppkey as path, 'M' as method, cast(s_suppkey * 10 + k as bigint) as timestamp_ms, 'C' || k as codes from supplier, (select unnest([0, 1, 2]) as k) where s_suppkey % 4 <> 0 and k < s_suppkey % 4")
def foreign_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs that overlays of other writers list in JSON; unreadable ones give none."""
    s = F.col("s_suppkey")
    one = lambda k: F.concat(F.lit('{"timestamp_ms": '), s * 10 + k, F.lit(f', "original_issue_codes": ["C{k}"]}}'))
    some = F.slice(F.array(*[one(k) for k in range(3)]), F.lit(1), (s % 4).cast("int"))
    text = F.when(s % 4 == 0, F.lit("{not json")).otherwise(F.concat(F.lit('{"version": 1, "method": "M", "repairs": ['), F.array_join(some, ", "), F.lit("]}")))
    manifests = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s).alias("path"), text.alias("json"))
    return tables.foreign_overlay_records(manifests).select("path", "method", "timestamp_ms", F.array_join("original_issue_codes", ",").alias("codes"))


# ---------------------------------------------------------------- planning


@query(
    "with q as (select s_suppkey as k from supplier), e as (select k, case k % 5 when 0 then 'A' || k else 'B' || k end as symbol from q union all select k, 'C' || k from q where k % 2 = 0 union all select k, 'D-' || k from q where k % 7 = 0) "
    "select k as request_id, symbol, case when contains(symbol, '-') then 'invalid symbol' when k % 3 = 0 then 'unknown datasets: nothing' when k % 4 = 0 then 'unsupported intervals: 7m' end as reject_reason from e where not contains(symbol, '-')"
)
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of lists with repeats, and why a request can't be planned."""
    k = F.col("s_suppkey")
    first = F.concat(F.when(k % 5 == 0, F.lit(" a")).otherwise(F.lit(" b/")), k)
    listed = F.concat(first, F.when(k % 2 == 0, F.concat(F.lit(", c"), k, F.lit(" "), first)).otherwise(F.lit("")), F.when(k % 7 == 0, F.concat(F.lit(" d-"), k)).otherwise(F.lit("")))
    asked = table(spark, sf_dir, "supplier").select(
        k.alias("request_id"), listed.alias("symbols"),
        F.when(k % 3 == 0, F.array(F.lit("klines"), F.lit("nothing"))).otherwise(F.array(F.lit("klines"))).alias("datasets"),
        F.when(k % 4 == 0, F.array(F.lit("1h"), F.lit("7m"))).otherwise(F.array(F.lit("1h"))).alias("intervals"),
    )
    return planning.validate(planning.expand_symbols(asked)).select("request_id", "symbol", "reject_reason")


@query(
    "select c_custkey as request_id, case when c_custkey % 11 = 0 then 'invalid symbol' when c_custkey % 7 = 0 then 'not a candle dataset' when c_custkey % 5 = 0 then 'interval without fixed length' when c_custkey % 3 = 0 then 'dates are required' when c_custkey % 2 = 0 then 'start after end' end as reject_reason from customer"
)
def validate_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a scan can't be run."""
    k = F.col("c_custkey")
    day = F.lit("2024-02-01").cast("date")
    asked = table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.when(k % 11 == 0, F.lit("a-b")).otherwise(F.concat(F.lit("s/"), k)).alias("symbol"), F.when(k % 7 == 0, "metrics").otherwise("markPriceKlines").alias("dataset"),
        F.when(k % 5 == 0, "1w").otherwise("4h").alias("interval"), F.when(k % 3 != 0, day).alias("start"), F.when(k % 2 == 0, F.date_sub(day, 1)).otherwise(day).alias("end"),
    )
    return planning.validate_scans(asked).select("request_id", "reject_reason")


@query(f"{_PLAN_SQL} select path, row_number() over (partition by symbol order by dataset, coalesce(interval, ''), span_start, period) as position from plan")
def plan_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the order in which a symbol's archives are worked off."""
    return planning.plan_positions(planning.plan_archives(plan_requests(spark, sf_dir))).select("path", "position")


@query(f"{_FALLBACK_SQL} select period, dataset, symbol, interval, key from plan union all select 'daily', dataset, symbol, interval, key from days")
def parsed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of archive paths, read back from them."""
    plan = planning.plan_archives(plan_requests(spark, sf_dir))
    paths = plan.select("path").unionByName(planning.daily_fallbacks(plan).select("path"))
    return paths.select(*[v.alias(k) for k, v in E.parse_path(F.col("path")).items()])


@query(f"{_PLAN_SQL} select dataset, count(*) as files from plan where dataset in ('klines', 'metrics', 'fundingRate', 'markPriceKlines', 'indexPriceKlines', 'premiumIndexKlines') group by 1")
def research_core_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned files of the families of the research core."""
    plan = planning.plan_archives(plan_requests(spark, sf_dir))
    return plan.join(dims.research_core(spark), "dataset", "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("files"))


_NO = "cast(symbol[2:] as int) + cast(key[-2:] as int)"
_REPAIR_SQL = (
    _FALLBACK_SQL
    + f""", n as (select *, {_NO} as no from plan where dataset = 'aggTrades'), s as (
  select *, no % 4 <> 0 as there, no % 4 <> 0 and no % 3 <> 0 as valid, no % 5 = 0 as absent from n
)"""
)


@query(
    f"{_REPAIR_SQL} select 'repair' as step, symbol, period, key from s where not there or not valid "
    "union all select 'put aside', symbol, period, key from s where there and not valid and period = 'monthly' "
    "union all select distinct 'fallback', d.symbol, 'daily', d.key from days d join s on s.symbol = d.symbol and s.key = d.month and d.dataset = 'aggTrades' and s.period = 'monthly' and (absent or there and not valid) "
    "union all select distinct 'needed', d.symbol, 'daily', d.key from days d join s on s.symbol = d.symbol and s.key = d.month and d.dataset = 'aggTrades' and s.period = 'monthly' and absent and cast(d.key[9:] as int) % 2 <> 0"
)
def trade_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives to fetch again, months to put aside, their days, and days that aren't planned yet."""
    whole = planning.plan_archives(plan_requests(spark, sf_dir))
    plan = cut(_numbered(whole.where("dataset = 'aggTrades'")))
    no = F.col("no")
    scan = plan.withColumns({"exists": no % 4 != 0, "valid": (no % 4 != 0) & (no % 3 != 0)})
    results = plan.withColumn("status", F.when(no % 5 == 0, "missing").otherwise("downloaded"))
    even = planning.daily_fallbacks(plan).where("cast(right(key, 2) as int) % 2 = 0")
    steps = {
        "repair": planning.trade_repairs(scan, plan), "put aside": planning.bad_months(scan, plan), "fallback": planning.trade_fallbacks(results, scan, plan),
        "needed": planning.needed_fallbacks(results, plan.select(*planning.PLAN).unionByName(even)),
    }
    out = None
    for name, rows in steps.items():
        one = rows.select(F.lit(name).alias("step"), "symbol", "period", "key")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"{_PLAN_SQL}, x as (select *, {_NO} as no from plan) select path from x where not (period = 'daily' and exists (select 1 from plan m where m.period = 'monthly' and m.dataset = x.dataset and m.symbol = x.symbol and m.interval is not distinct from x.interval and cast(m.symbol[2:] as int) % 2 = 0)) or period <> 'daily'"
)
def manifest_without_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries without the days of months that have arrived; months here are those of the days, for even symbols."""
    plan = planning.plan_archives(plan_requests(spark, sf_dir))
    arrived = plan.where("period = 'monthly' and cast(substring(symbol, 2) as int) % 2 = 0").select("dataset", "symbol", "interval").distinct()
    days = plan.where("period = 'daily'").select("dataset", "symbol", "interval", F.substring("key", 1, 7).alias("month")).distinct()
    months = days.join(arrived, planning.same(days, arrived, ("dataset", "symbol", "interval")), "left_semi")
    return tables.without_superseded(plan, months).select("path")


# ---------------------------------------------------------------- reports and rates

_DAY_CODES = f"codes_of as (select request_id, {_DAY.format('open_time')} as day, unnest({_CODES_LIST}) as code from merged where mask <> 0), per_day as (select request_id, day, string_agg(distinct code, ', ' order by code) as codes from codes_of group by 1, 2)"


@query(
    f"with {SQL_ROWS}, {_DAY_CODES} select request_id, cast(day as varchar) as day, row_number() over (partition by request_id order by day) as position, "
    "case when missing > 0 and invalid > 0 then 'Still missing + invalid after repair' when missing > 0 then 'Still missing after repair' else 'Still invalid after repair' end || coalesce(' · ' || codes, '') as status "
    "from by_day left join per_day using (request_id, day) where missing + invalid > 0"
)
def report_with_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in the order of days, with the codes that each day has left."""
    merged, _, requests = _merged(spark, sf_dir)
    days = klines.by_day(merged, requests)
    left = report.unresolved_days(days)
    codes = report.codes_by_day_of(merged, E.day_of(F.col("open_time")))
    none = left.select("request_id", "day", F.lit("downloaded").alias("status"))
    made = report.ordered_report(report.repair_report(days, days.join(left, ["request_id", "day"], "left_semi"), none, codes))
    return made.select("request_id", F.col("day").cast("string").alias("day"), "position", "status")


@query(
    "with o as (select o_custkey % 50 as request_id, cast(o_orderdate as date) as day, case o_orderstatus when 'F' then 'failed' when 'O' then 'missing' else 'downloaded' end as status from orders) "
    "select distinct request_id, cast(day as varchar) as day, status from o where status <> 'downloaded'"
)
def merged_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that two rounds of fetching couldn't get."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "missing").otherwise("downloaded")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("request_id"), F.to_date("o_orderdate").alias("day"), status.alias("status"))
    found = report.merged_attempts(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"))
    return found.select("request_id", F.col("day").cast("string").alias("day"), "status")


@query(
    "with l as (select l_orderkey // 10 as run_id, min(l_linenumber * 1000000 + l_orderkey * 500000) as a, max(l_linenumber * 1000000 + l_orderkey * 500000) as b, max(l_partkey) as bytes, count(*) as completed from lineitem group by 1) "
    "select run_id, (b - a) / 1e6 as elapsed, cast(round(bytes / greatest((b - a) / 1e6, 1e-6)) as bigint) as average_bps, cast(round(completed / greatest((b - a) / 1e6, 1e-6) * 60) as bigint) as files_per_minute, "
    "cast(round(case when completed < 40 then (b - a) / 1e6 / completed * (40 - completed) end) as bigint) as eta_seconds from l"
)
def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of each run and what is left of it."""
    l = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 10).alias("run_id"), (F.col("l_linenumber") * 1000000 + F.col("l_orderkey") * 500000).alias("t_us"), F.col("l_partkey").alias("cum_bytes"))  # noqa: E741
    files = l.groupBy("run_id").agg(F.count(F.lit(1)).alias("completed"), F.lit(40).cast("long").alias("total"))
    whole = lambda c: F.round(c).cast("long").alias(c)
    return throughput.run_averages(l, files).select("run_id", "elapsed", whole("average_bps"), whole("files_per_minute"), whole("eta_seconds"))


@query(
    "select l_suppkey as benchmark_id, l_linenumber * 4 as connections, cast(sum(l_partkey) as bigint) as network_bytes, cast(round(sum(l_partkey) * 8 / greatest(sum(l_linenumber / 2.0), 1e-6)) as bigint) as bits_per_second, count(*) filter (l_returnflag = 'R') as errors from lineitem group by 1, 2"
)
def level_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speed of each level of each benchmark."""
    levels = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("benchmark_id"), (F.col("l_linenumber") * 4).alias("connections"), F.col("l_partkey").alias("network_bytes"), (F.col("l_linenumber") / 2).alias("elapsed"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("errors"),
    )
    found = throughput.level_averages(levels)
    return found.select("benchmark_id", "connections", "network_bytes", F.round("average_bps").cast("long").alias("bits_per_second"), F.col("errors").cast("long").alias("errors"))


@query(
    "select o_custkey as run_id, cast(sum(o_orderkey) as bigint) as remaining_bytes, cast(round(case when sum(o_orderkey) > 0 then sum(o_orderkey) * 8 / 12.5e6 * 1000 end) as bigint) as eta_ms, 100000 >= sum(o_orderkey) as enough_disk from orders group by 1"
)
def estimate_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time left at a speed, and whether the disk has room."""
    total = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.sum("o_orderkey").alias("remaining_bytes"))
    return estimate.with_eta(total, 12.5, 100_000).select("run_id", "remaining_bytes", F.round(F.col("eta_seconds") * 1000).cast("long").alias("eta_ms"), "enough_disk")


def _printf(value: str, units: dict[str, int]) -> str:
    """SQL that writes a number in the largest unit that it reaches."""
    cases = [f"when v < {size} * 1024.0 then printf('%.2f {u}', v / {size}.0)" for u, size in list(units.items())[:-1]]
    last, size = list(units.items())[-1]
    return f"case {' '.join(cases)} else printf('%.2f {last}', v / {size}.0) end".replace("v ", f"{value} ")


_UNITS = {u: 1024**i for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))}


@query(
    "with v as (select o_orderkey as id, o_orderkey * 7919 as s, cast(o_orderkey * o_orderkey * 37 as double) as b, case when o_orderkey % 11 <> 0 then cast(o_orderkey * 4099 as double) end as r from orders) select id, "
    "lpad(cast(s // 3600 as varchar), cast(greatest(2, length(cast(s // 3600 as varchar))) as int), '0') || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as duration, "
    f"{_printf('b', _UNITS)} as size, printf('%.2f MB/s  (%.1f Mbps)', coalesce(r, 0) / 1048576, coalesce(r, 0) * 8 / 1000000) as speed from v"
)
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, sizes and speeds as text; no number here is half-way between two texts, which engines round differently."""
    k = F.col("o_orderkey")
    speed = F.when(k % 11 != 0, k * 4099)
    return table(spark, sf_dir, "orders").select(k.alias("id"), E.duration_text((k * 7919).cast("double")).alias("duration"), E.size_text(k * k * 37).alias("size"), E.speed_text(speed).alias("speed"))


# ---------------------------------------------------------------- scans that go on, whole overlays

#: Small archives that one task packs and lands.
ARCHIVES_OF_TASK = 2000


@query(f"with {SQL_ROWS} select request_id, cast(day as varchar) as day, cast(expected as bigint) as expected, cast(found as bigint) as found, cast(missing as bigint) as missing, cast(invalid as bigint) as invalid from by_day")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a scan after batches of archives. For half of the symbols the daily archives come before the
    monthly ones, one month comes again after it was wrong at first, and the last batch comes twice."""
    raw = candle_archives(spark, sf_dir)
    late = (F.col("period") == "monthly") == (F.ascii("symbol") % 2 == 0)
    wrong = F.ascii("symbol") % 5 == 0
    scan = IncrementalScan(spark, scratch(spark, "scan"), cut(scan_requests(spark, sf_dir)))
    first = raw.where(~late).withColumn("cells", F.when(wrong & (F.col("ordinal") % 3 == 0), F.slice("cells", 1, 3)).otherwise(F.col("cells")))
    scan.apply(cut(first), 0)
    second = cut(raw.where(late | wrong))
    scan.apply(second, 1)
    scan.apply(second.limit(5), 1)
    return scan.by_day().withColumn("day", F.col("day").cast("string"))


@query(
    "with s as (select s_suppkey as k from supplier), x as (select k, 's' || k || '.zip' as path, unnest([0, 1, 2, 3]) as i from s where k % 5 <> 0 and k % 7 <> 0), "
    "rows as (select *, 1700000000000 + k * 1000 + i as t from x where k % 3 <> 0 and i < 3), recs as (select *, 1700000000000 + k * 1000 + i as t from x where k % 4 <> 0 and i > 0) "
    "select coalesce(r.path, c.path) as path, coalesce(r.t, c.t) as timestamp_ms, case when r.t is not null then 'v' || r.i || case when r.i = 1 then 'b' else '' end end as cell, case when c.t is not null then 'M' end as method, case when c.t is not null then 'C' || c.i end as codes "
    "from rows r full join recs c on r.path = c.path and r.t = c.t"
)
def foreign_overlay_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of other writers from their ZIP files: rows of the largest CSV member and records of the manifest in one
    archive; some have no rows or no records, one time comes twice, broken archives and manifests give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, made = [], []
            for k in batch.column(0).to_pylist():
                out, t = io.BytesIO(), 1_700_000_000_000 + k * 1000
                with zipfile.ZipFile(out, "w") as z:
                    if k % 3:
                        lines = ["open_time,value", *[f"{t + i}, v{i} " for i in range(3)], f"{t + 1},v1b", "x,y"]
                        z.writestr("rows.csv", "\n".join(lines))
                        z.writestr("few.csv", f"{t},wrong")
                    if k % 4:
                        records = ", ".join(f'{{"timestamp_ms": {t + i}, "original_issue_codes": ["C{i}"]}}' for i in range(1, 4))
                        z.writestr(tables.MANIFEST_MEMBER, "{no json" if k % 7 == 0 else f'{{"version": 1, "method": "M", "repairs": [{records}]}}')
                    elif k % 7 == 0:
                        z.writestr(tables.MANIFEST_MEMBER, "")
                paths.append(f"s{k}.zip")
                made.append(b"no archive" if k % 5 == 0 else out.getvalue())
            yield pa.record_batch([pa.array(paths), pa.array(made, pa.binary())], names=["path", "content"])

    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    tasks = -(-keys.count() // ARCHIVES_OF_TASK)  # a file of a few MB of keys is many archives
    zips = keys.repartition(max(1, tasks), "k").mapInArrow(run, "path string, content binary")
    found = tables.foreign_overlays(landing.land(zips, texts=(tables.MANIFEST_MEMBER,)))
    return found.select("path", "timestamp_ms", F.get("cells", F.lit(1)).alias("cell"), "method", F.array_join("original_issue_codes", ",").alias("codes"))


@query("select customer_log.* from (select *, row_number() over (partition by o_custkey % 400, o_orderpriority order by o_orderkey // 7 desc, o_orderkey desc) as n from orders) o, lateral (select 'klines' as dataset, 'S' || (o_custkey % 400) as symbol, o_orderpriority as key, case o_orderstatus when 'F' then 'downloaded' when 'O' then 'missing' else 'failed' end as status, o_orderkey as seq) customer_log where n = 1")
def manifest_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each archive from a compacted log: a bucketed base, which was compacted twice, and a delta."""
    rows = _log(spark, sf_dir)
    shape = "dataset string, symbol string, period string, key string, interval string, status string, updated_at long, seq long"
    logged = CompactedLog(spark, scratch(spark, "log"), shape, tables.MANIFEST_KEY, ("updated_at", "seq"), buckets=16)
    for part in range(3):
        logged.append(rows.where(F.col("seq") % 3 == part))
        logged.compact(always=part < 2)
    return logged.latest().select("dataset", "symbol", "key", "status", "seq")
