"""The archive operators on small inputs: planning, landing, candle and trade scans, reconstruction, statistics."""

import datetime as dt
import io
import os
import zipfile

from pyspark.sql import functions as F

from archlake.functions import exprs as E
from archlake.functions import rules as R
from archlake.operators import klines, reconstruct, rounds, throughput, trades
from archlake.operators.increments import IncrementalScan
from archlake.plans import planning
from archlake.sources import evidence, landing, tables
from archlake.sources.logs import CompactedLog
from archlake.sources.shared import cut
from archlake.sources.snapshots import Snapshot
from archlake.streaming import landing as stream_landing

D = dt.date
REQ = "symbol string, datasets array<string>, intervals array<string>, start date, end date, today date"
DAY = dt.datetime(2023, 11, 30, tzinfo=dt.timezone.utc)


def zipped(text, name="rows.csv"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


def put(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def plan(spark, dataset, start, end, today):
    rows = [("btc/usdt ", [dataset], ["1h"], start, end, today)]
    return planning.plan_order(planning.plan_archives(spark.createDataFrame(rows, REQ))).collect()


def test_plan_shapes(spark):
    got = plan(spark, "klines", D(2026, 6, 15), D(2026, 8, 20), D(2026, 8, 21))
    assert [r.key for r in got if r.period == "monthly"] == ["2026-06", "2026-07"]
    assert [r.key for r in got if r.period == "daily"] == [f"2026-08-{d:02d}" for d in range(1, 21)]
    assert got[0].path == "raw/futures/um/monthly/klines/BTCUSDT/1h/BTCUSDT-1h-2026-06.zip"
    metrics = plan(spark, "metrics", D(2026, 8, 18), D(2026, 8, 20), D(2026, 8, 21))
    assert len(metrics) == 3 and metrics[0].interval is None
    assert [r.key for r in plan(spark, "fundingRate", D(2026, 6, 1), D(2026, 8, 20), D(2026, 8, 21))] == ["2026-06", "2026-07"]
    assert plan(spark, "klines", D(2026, 9, 1), D(2026, 9, 2), D(2026, 8, 21)) == []


def test_paths_parse_back(spark):
    row = spark.range(1).select(E.archive_path(F.lit("aggTrades"), F.lit("X1"), F.lit("daily"), F.lit(None).cast("string"), F.lit("2024-02-03")).alias("p"))
    got = row.select(*[v.alias(k) for k, v in E.parse_path(F.col("p")).items()]).first()
    assert tuple(got) == ("daily", "aggTrades", "X1", None, "2024-02-03")


def test_scalars(spark):
    t = spark.createDataFrame([(" 1700000000000000 ", "1.5e3", " btc/usdt,eth btc ")], "a string, b string, c string")
    got = t.select(E.epoch_ms(F.col("a")), E.number(F.col("b")), E.symbols(F.col("c")), E.number(F.lit("1_0")), E.duration_text(F.lit(3661.5)), E.size_text(F.lit(1536))).first()
    assert got[0] == 1700000000000 and got[1] == 1500.0 and got[2] == ["BTCUSDT", "ETH", "BTC"] and got[3] != got[3]
    assert got[4:] == ("01:01:01", "1.50 KB")


def candles(bad=None, count="1", minutes=range(1440)):
    rows = []
    for i in minutes:
        t = int(DAY.timestamp() * 1000) + i * 60000
        row = [t, 1, 1, 1, 1, 10, t + 59999, 20, count, 5, 8, 0]
        rows.append(",".join(map(str, bad(row) if bad and i == 755 else row)))
    return zipped("\n".join(rows))


MONTH = "raw/futures/um/monthly/klines/BTCUSDT/1m/BTCUSDT-1m-2023-11.zip"
DAILY = "raw/futures/um/daily/klines/BTCUSDT/1m/BTCUSDT-1m-2023-11-30.zip"


def requests(spark):
    return spark.createDataFrame([("r", "BTCUSDT", "klines", "1m", D(2023, 11, 30), D(2023, 11, 30))], "request_id string, symbol string, dataset string, interval string, start date, end date")


def scan(spark, root, overlay=None):
    landed = landing.land_lake(spark, root)
    return klines.scan_klines(landing.raw_rows(landed), requests(spark), landing.inventory(spark, root), landing.archive_status(landed), overlay)


def test_scan_bad_taker_and_daily_override(spark, tmp_path):
    root = str(tmp_path)

    def taker(row):
        return [*row[:9], 12, *row[10:]]

    put(root, MONTH, candles(taker))
    out = scan(spark, root)
    s = out["summary"].first()
    assert (s.expected, s.found, s.missing, s.invalid, s.complete) == (1440, 1440, 0, 1, False)
    detail = out["details"].first()
    assert detail.codes == ["TAKER_VOLUME_EXCEEDS_TOTAL"] and detail.timestamp == "2023-11-30T12:35:00+00:00"
    put(root, DAILY, candles())
    s = scan(spark, root)["summary"].first()
    assert (s.invalid, s.complete, s.archives) == (0, True, 2)


def test_scan_counts_gaps_and_broken_archives(spark, tmp_path):
    root = str(tmp_path)
    put(root, MONTH, candles(minutes=range(0, 1440, 2)))
    put(root, DAILY, b"not a zip archive")
    out = scan(spark, root)
    s = out["summary"].first()
    assert (s.found, s.missing, s.invalid_archives, s.complete) == (720, 720, 1, False)
    assert klines.missing_slots(out["merged"], requests(spark), out["by_day"]).count() == 720
    again = klines.merge(klines.rows_in_requests(klines.candle_rows(landing.raw_rows(landing.land_lake(spark, root)).repartition(7)), requests(spark), landing.inventory(spark, root)))
    assert again.exceptAll(out["merged"]).isEmpty()


def test_reconstruct_and_overlay(spark):
    ms = int(DAY.timestamp() * 1000) + 755 * 60000
    bad = [str(x) for x in (ms, 1, 1, 1, 1, 10, ms + 59999, 20, 2, 12, 12, 0)]
    shape = "symbol string, interval string, open_time long, codes array<string>, cells array<string>"
    originals = spark.createDataFrame([(f"S{k}", "1m", ms, ["TAKER_VOLUME_EXCEEDS_TOTAL"], bad) for k in range(4)], shape)
    days = spark.createDataFrame([(f"S{k}", D(2023, 11, 30)) for k in range(3)], "symbol string, day date")
    good = [f"1,1,12,100,100,{ms + 1000},false", f"2,1,8,101,101,{ms + 2000},true"]
    lines = [("S0", x) for x in good] + [("S1", f"1,1,20,100,100,{ms + 1000},false")] + [("S2", good[0]), ("S2", f"2,1,8,105,105,{ms + 2000},true")]
    raw = spark.createDataFrame([(k, x.split(",")) for k, x in lines], "symbol string, cells array<string>")
    found = cut(reconstruct.reconstruct(originals, reconstruct.evidence(raw), days))
    got = {r.symbol: r for r in found.collect()}
    assert {k: r.verdict for k, r in got.items()} == {"S0": "verified", "S1": "trade count differs", "S2": "trade ids not contiguous", "S3": "evidence unavailable"}
    assert len(got["S0"].matching) == 3 and float(got["S0"].new_cells[5]) == 20
    merged = spark.createDataFrame([("r", ms, 1 << 21, 5)], "request_id string, open_time long, mask long, order_key long")
    asked = requests(spark).withColumn("symbol", F.lit("S0"))
    assert klines.with_overlay(merged, reconstruct.overlay_rows(found), asked).first().mask == 0


def test_landed_scan_rebuild_rescan(spark, tmp_path):
    """From a landed archive through the scan, the proof and the overlay to a clean scan."""
    root = str(tmp_path)
    ms = int(DAY.timestamp() * 1000) + 755 * 60000

    def wrong(row):
        return [row[0], 1, 1, 1, 1, 10, row[6], 20, 2, 12, 12, 0]

    put(root, MONTH, candles(wrong))
    rows = [f"1,1,12,100,100,{ms + 1000},false", f"2,1,8,101,101,{ms + 2000},true"]
    base = scan(spark, root)
    originals = base["details"].join(requests(spark).select("request_id", "symbol", "interval"), "request_id").select("symbol", "interval", "open_time", "codes", "cells")
    days = spark.createDataFrame([("BTCUSDT", D(2023, 11, 30))], "symbol string, day date")

    def verdict(lines):
        raw = spark.createDataFrame([("BTCUSDT", line.split(",")) for line in lines], "symbol string, cells array<string>")
        return reconstruct.reconstruct(originals, reconstruct.evidence(raw), days)

    good = verdict(rows).first()
    assert good.verdict == "verified" and len(good.matching) == 3
    after = scan(spark, root, reconstruct.overlay_rows(verdict(rows)))["summary"].first()
    assert (after.invalid, after.missing, after.complete) == (0, 0, True)
    assert verdict([f"1,1,20,100,100,{ms + 1000},false"]).first().verdict == "trade count differs"
    assert verdict([rows[0], f"2,1,8,105,105,{ms + 2000},true"]).first().verdict == "trade ids not contiguous"


def fetcher(spark, root, offered, seen):
    """A fetch step that puts what is offered on the lake and remembers what it was asked for."""

    def fetch(plan):
        done = []
        for r in plan.collect():
            seen.append(r.path)
            if r.path in offered:
                put(root, r.path, offered[r.path])
            done.append((*[r[c] for c in planning.PLAN], "downloaded" if r.path in offered else "missing"))
        shape = "dataset string, symbol string, period string, key string, interval string, path string, span_start date, span_end date, status string"
        return spark.createDataFrame(done, shape)

    return fetch


def test_repair_round(spark, tmp_path):
    """The month comes and has a bad candle, its day isn't offered, trades mend it; a second round has nothing to do."""
    root, seen = str(tmp_path), []
    ms = int(DAY.timestamp() * 1000) + 755 * 60000
    trades_path = "raw/futures/um/daily/aggTrades/BTCUSDT/BTCUSDT-aggTrades-2023-11-30.zip"
    offered = {
        MONTH: candles(lambda row: [row[0], 1, 1, 1, 1, 10, row[6], 20, 2, 12, 12, 0]),
        trades_path: zipped(f"1,1,12,100,100,{ms + 1000},false\n2,1,8,101,101,{ms + 2000},true\n"),
    }
    put(root, "raw/futures/um/daily/klines/BTCUSDT/1m/BTCUSDT-1m-2023-11-30.zip.x", b"no archive")
    put(root, "raw/futures/um/monthly/klines/OTHER/1m/OTHER-1m-2023-11.zip", candles())
    out = rounds.repair_round(rounds.Lake(spark, root), requests(spark), fetcher(spark, root, offered, seen), F.lit("2024-01-05").cast("date"))
    assert seen == [MONTH, DAILY, trades_path]
    assert out["verdicts"].first().verdict == "verified"
    assert [(r.missing, r.invalid) for r in out["before"].collect()] == [(1440, 0)] and [(r.missing, r.invalid) for r in out["after"].collect()] == [(0, 0)]
    assert [r.status for r in out["report"].collect()] == ["Repaired"]
    again = rounds.repair_round(rounds.Lake(spark, root), requests(spark), fetcher(spark, root, {}, seen), F.lit("2024-01-05").cast("date"), out["overlay"])
    assert len(seen) == 3 and again["verdicts"] is None and again["report"].count() == 0


def test_trade_repair_round(spark, tmp_path):
    """A bad month stays bad after fetching, is put aside, and its days come instead."""
    root, seen = str(tmp_path), []
    month = "raw/futures/um/monthly/aggTrades/X/X-aggTrades-2022-09.zip"
    day = "raw/futures/um/daily/aggTrades/X/X-aggTrades-2022-09-{:02d}.zip"
    put(root, month, zipped("1,1,1,501,500,5,true\n"))
    offered = {month: zipped("2,1,1,501,500,5,true\n")} | {day.format(d): zipped(f"{d},1,1,{d},{d},5,true\n") for d in (1, 2)}
    rows = [("aggTrades", "X", "monthly", "2022-09", None, month, D(2022, 9, 1), D(2022, 9, 3), "r")]
    plan_ = spark.createDataFrame(rows, "dataset string, symbol string, period string, key string, interval string, path string, span_start date, span_end date, request_id string")
    gone = []

    def drop(bad):
        for r in bad.collect():
            gone.append(r.path)
            os.remove(os.path.join(root, r.path))

    out = rounds.trade_repair_round(rounds.Lake(spark, root), plan_, fetcher(spark, root, offered, seen), drop)
    assert gone == [month] and sorted(seen) == sorted([month, *[day.format(d) for d in (1, 2, 3)]])
    assert [(r.invalid_archives, r.complete) for r in out["before"]["summary"].collect()] == [(1, False)]
    s = out["after"]["summary"].first()
    assert (s.archives_scanned, s.missing_archives, s.invalid_archives, s.missing_keys) == (3, 1, 0, ["daily:2022-09-03"])


def test_streamed_landing_takes_new_archives_only(spark, tmp_path):
    root, to, marks = (str(tmp_path / x) for x in ("lake", "landed", "marks"))
    put(root, MONTH, candles(minutes=range(3)))
    stream_landing.land_new(spark, root, to, marks).awaitTermination()
    assert spark.read.parquet(to).count() == 3
    put(root, DAILY, candles(minutes=range(5)))
    stream_landing.land_new(spark, root, to, marks).awaitTermination()
    got = spark.read.parquet(to)
    assert got.count() == 8 and {r.period for r in got.select("period").distinct().collect()} == {"monthly", "daily"}


def trade_scan(spark, root, lines_by_path):
    for path, data in lines_by_path.items():
        put(root, path, data)
    landed = landing.land_lake(spark, root)
    sources = landing.inventory(spark, root).withColumn("request_id", F.lit("r"))
    return {r.path: r for r in trades.scan_agg_trades(landing.raw_rows(landed), sources, landing.archive_status(landed))["archives"].collect()}


def test_trade_archives(spark, tmp_path):
    base = "raw/futures/um/daily/aggTrades/X/X-aggTrades-2022-09-0{}.zip"
    good = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n1,43000,0.01,10,10,1646092800000,true\n"
    rows = {
        base.format(1): zipped(good), base.format(2): zipped("100,1,1,1,1,5,t\n101,1,1,2,2,5,f\n101,1,1,3,3,5,f\n"),
        base.format(3): zipped("1,1,1,501,500,5,true\n"), base.format(4): b"not a zip archive", base.format(5): zipped("\n"), base.format(6): zipped("a", "x.txt"),
    }
    got = trade_scan(spark, str(tmp_path), rows)
    assert got[base.format(1)].valid
    assert (got[base.format(2)].error, got[base.format(2)].rows, got[base.format(2)].error_row) == ("DUPLICATE_ID", 2, 3)
    assert got[base.format(3)].error == "LAST_BELOW_FIRST"
    assert [got[base.format(i)].error for i in (4, 5, 6)] == ["not a ZIP file", "no rows", "no CSV member"]


def test_rules_mask(spark):
    cells = [["60000", "1", "2", "0.5", "1", "3"], ["60001", "1", "2", "3", "1", "3"], ["0", "1", "2"], ["0", "x", "2", "1", "1", "-1"], ["0", "-1", "2", "-3", "1", "-1", "", "nan", "-2"]]
    t = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cells array<string>").withColumns(R.candle_fields(F.col("cells")))
    mask = R.candle_mask(F.col("cells"), {k: F.col(k) for k in (*R.REQUIRED, *R.OPTIONAL)}, F.lit("klines"), E.epoch_ms(F.get("cells", F.lit(0))), F.lit(60000))
    got = {r.i: r.codes for r in t.select("i", R.issue_codes(mask).alias("codes")).collect()}
    assert got == {0: [], 1: ["OFF_GRID_TIMESTAMP", "INVALID_OHLC"], 2: ["KLINE_SCHEMA_TOO_SHORT"], 3: ["INVALID_NUMERIC"], 4: ["INVALID_NUMERIC", "INVALID_DOMAIN_VALUE"]}


def test_statistics(spark):
    levels = [("b", i, c, m, 1, 0) for i, (c, m) in enumerate([(4, 4.5), (8, 4.9), (16, 5.0), (24, 4.98), (32, 4.92)])]
    got = throughput.recommend_level(spark.createDataFrame(levels, "benchmark_id string, position int, connections int, average_mbps double, network_bytes long, errors int")).first()
    assert (got.recommended_connections, got.best_connections, round(got.efficiency_pct)) == (8, 16, 98)
    mib = 1 << 20
    rows = [("r", 0, 0), ("r", 2_000_000, 2 * mib), ("r", 5_000_000, 5 * mib)]
    rates = throughput.throughput(spark.createDataFrame(rows, "run_id string, t_us long, cum_bytes long")).orderBy("t_us").collect()
    assert rates[1].current_bps > 0 and rates[1].peak_bps == 0 and rates[2].peak_bps > 0
    probes = spark.createDataFrame([(4.0, 4.3, 0), (4.0, 4.1, 0), (4.0, 5.0, 3)], "b double, c double, e int")
    assert [r[0] for r in probes.select(throughput.better(F.col("b"), F.col("c"), F.col("e"))).collect()] == [True, False, False]


def test_overlay_table_and_probes(spark, tmp_path):
    path = str(tmp_path / "overlay")
    shape = "symbol string, interval string, day date, timestamp_ms long, cells array<string>"
    tables.write_overlay(spark.createDataFrame([("A", "1m", D(2024, 1, 1), 5, ["old"]), ("A", "1m", D(2024, 1, 2), 6, ["stays"])], shape), path)
    tables.write_overlay(spark.createDataFrame([("A", "1m", D(2024, 1, 1), 5, ["new"]), ("A", "1m", D(2024, 1, 1), 4, ["more"])], shape), path)
    got = tables.read_overlay(spark, path, spark.createDataFrame([], shape).schema).orderBy("timestamp_ms").collect()
    assert [(r.timestamp_ms, r.cells) for r in got] == [(4, ["more"]), (5, ["new"]), (6, ["stays"])]
    log = [("a", "missing", 0, "2024-01-01 00:00:00"), ("b", "missing", 0, "2023-12-01 00:00:00"), ("c", "available", 7, "2000-01-01 00:00:00"), ("d", "missing", 0, "?")]
    fresh = tables.usable_probes(tables.latest(tables.probes(spark.createDataFrame(log, "url string, status string, bytes long, checked_at string")), ("url",), "checked_at"), F.lit("2024-01-01 11:00:00").cast("timestamp"))
    assert sorted(r.url for r in fresh.collect()) == ["a", "c"]


def test_checksums(spark, tmp_path):
    data, base = zipped("1,2\n"), "raw/futures/um/daily/trades/X/X-trades-2024-01-0{}.zip"
    import hashlib

    for i, text in ((1, hashlib.sha256(data).hexdigest().upper() + "  name.zip\n"), (2, "00 name.zip"), (3, None)):
        put(str(tmp_path), base.format(i), data)
        if text:
            put(str(tmp_path), base.format(i) + ".CHECKSUM", text.encode())
    got = {r.path[-5]: r.verdict for r in landing.verify_archives(spark, str(tmp_path)).collect()}
    assert got == {"1": "ok", "2": "mismatch", "3": "checksum missing"}


ODD_TEXTS = [
    "", "\n", "\n\n", "a,b\n1,2,3\n", "a\r\nb\r\n\r\nc", "a\rb\r", "\ufeffx,y\n1\n", " \n,\n,,\n", "é,漢\n" * 50, "x" * 300 + "\ny\n", '1,"a,b"\n2,"c\nd"\n3\n', "1,2\n" * 40 + '5,"q""r"\n6\n',
]


def test_landing_in_blocks_of_any_size(spark, tmp_path):
    """Streamed landing gives what the csv module reads from the whole text, however small the block."""
    import csv

    root = str(tmp_path)
    base = "raw/futures/um/daily/trades/T{}/T{}-trades-2024-01-01.zip"
    for i, text in enumerate(ODD_TEXTS):
        put(root, base.format(i, i), zipped(text))
    want = {}
    for i, text in enumerate(ODD_TEXTS):
        rows = list(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")))
        want |= {(f"T{i}", n + 1): r for n, r in enumerate(rows) if r}
    for block in (7, 64, landing.BLOCK):
        for frame in (landing.land_lake(spark, root, block=block), landing.with_keys(landing.land(landing.files(spark, root), block))):
            assert {(r.symbol, r.row_number): r.cells for r in landing.raw_rows(frame).collect()} == want
    status = {r.path: r.error for r in landing.archive_status(landing.land_lake(spark, root)).collect()}
    assert len(status) == len(ODD_TEXTS) and [status[base.format(i, i)] for i in range(4)] == ["no rows"] * 3 + [None]


def test_landing_of_what_is_no_text(spark, tmp_path):
    """Rows before a broken place stay; the error says what happened."""
    root, base = str(tmp_path), "raw/futures/um/daily/trades/T{}/T{}-trades-2024-01-01.zip"
    put(root, base.format(1, 1), zipped(b"1,2\n" * 10 + b"\xff\xfe,3\n" + b"4\n" * 10))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("rows.csv", "\n".join(str(i * 7919) for i in range(50_000)))
    data = bytearray(out.getvalue())
    data[len(data) // 2 : len(data) // 2 + 64] = b"\0" * 64
    put(root, base.format(2, 2), bytes(data))
    landed = cut(landing.land_lake(spark, root, block=16))
    status = {r.path[-25:-24]: r for r in landing.archive_status(landed).collect()}
    got = {r.path: r for r in landing.archive_status(landed).collect()}
    first, second = got[base.format(1, 1)], got[base.format(2, 2)]
    assert status and first.error.startswith("UnicodeDecodeError") and 0 < first.rows <= 10
    assert second.error and 0 < second.rows < 50_000 and second.valid_zip


def test_large_archives_where_spark_reads_whole_files(spark, tmp_path, monkeypatch):
    """Beyond the limit a file that can only be read whole has an error; by path it lands, in small blocks."""
    root = str(tmp_path)
    put(root, MONTH, candles(minutes=range(1000)))
    put(root, DAILY, candles(minutes=range(3)))
    monkeypatch.setattr(landing, "WHOLE_LIMIT", 2000)
    found = landing.inventory(spark, root)
    whole = {r.path: (r.rows, r.error) for r in landing.archive_status(landing.with_keys(landing.land_files(spark, found, by_path=False))).collect()}
    assert whole == {MONTH: (0, "too large for one value"), DAILY: (3, None)}
    streamed = {r.path: (r.rows, r.error) for r in landing.archive_status(landing.with_keys(landing.land_files(spark, found, block=512))).collect()}
    assert streamed == {MONTH: (1000, None), DAILY: (3, None)}
    assert not landing.opens("viewfs://store/in/x.zip") and landing.opens("file:" + root) and landing.opens(root)


def test_only_wanted_archives_are_opened_and_once(spark, tmp_path):
    """A lake of 1,000 archives, of which a request needs two: these are opened, once, until one of them changes."""
    root = str(tmp_path)
    for i in range(998):
        put(root, f"raw/futures/um/daily/klines/OTHER{i % 40}/1m/OTHER{i % 40}-1m-2023-{i // 40 % 12 + 1:02d}-{i // 480 + 1:02d}.zip", b"unreadable %d" % i)
    put(root, MONTH, candles(minutes=range(0, 1440, 2)))
    put(root, DAILY, candles(minutes=range(100)))
    lake = rounds.Lake(spark, root, str(tmp_path / "store"))
    assert rounds._scan(lake, requests(spark), None)["summary"].first().found == 720 + 50
    assert sorted(r.path for r in lake.opened().collect()) == sorted([MONTH, DAILY])
    again = rounds.Lake(spark, root, lake.store)
    assert rounds._scan(again, requests(spark), None)["summary"].first().found == 720 + 50 and again.opened().count() == 2
    put(root, DAILY, candles(minutes=range(200)))
    assert rounds._scan(again, requests(spark), None)["summary"].first().found == 720 + 100
    assert [(r.path, r.batch) for r in again.opened().orderBy("batch", "path").collect()] == [(DAILY, 1), (MONTH, 1), (DAILY, 2)]
    os.remove(os.path.join(root, DAILY))
    assert rounds._scan(again, requests(spark), None)["summary"].first().found == 720 and again.opened().count() == 3


OVERLAY = "symbol string, interval string, day date, timestamp_ms long, cells array<string>"


def overlay_row(ms, text, day=D(2024, 1, 1)):
    return ("A", "1m", day, ms, [text])


def test_overlay_of_a_writer_that_fails(spark, tmp_path, monkeypatch):
    """Readers see the version before, whatever a lost writer has left; the next one goes on from there."""
    path, schema = str(tmp_path / "overlay"), spark.createDataFrame([], OVERLAY).schema
    write = lambda *rows: tables.write_overlay(spark.createDataFrame(list(rows), OVERLAY), path)
    read = lambda: sorted((r.timestamp_ms, r.cells[0]) for r in tables.read_overlay(spark, path, schema).collect())
    assert read() == []
    write(overlay_row(1, "a"), overlay_row(2, "b", D(2024, 1, 2)))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshot, "_commit", lost)
        try:
            write(overlay_row(1, "half"), overlay_row(9, "half"))
        except RuntimeError:
            pass
    assert read() == [(1, "a"), (2, "b")]
    open(os.path.join(path, "log", "000000000002"), "w").close()  # a number without its version
    assert read() == [(1, "a"), (2, "b")]
    assert write(overlay_row(3, "c")).number == 3
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
    table = Snapshot(spark, path, schema, ("symbol", "interval", "day"))
    assert table.vacuum() > 0 and read() == [(1, "a"), (2, "b"), (3, "c")] and table.vacuum() == 0


def test_overlay_of_two_writers(spark, tmp_path, monkeypatch):
    """The slower one meets the other's version, and merges with it: no row of either is lost."""
    path, schema = str(tmp_path / "overlay"), spark.createDataFrame([], OVERLAY).schema
    write = lambda *rows: tables.write_overlay(spark.createDataFrame(list(rows), OVERLAY), path)
    write(overlay_row(1, "old"))
    plain, waiting = Snapshot._commit, [overlay_row(2, "fast"), overlay_row(3, "fast"), overlay_row(7, "other day", D(2024, 1, 5))]

    def slow(self, version, base):
        if waiting:
            rows = waiting[:]
            waiting.clear()
            write(*rows)
        return plain(self, version, base)

    monkeypatch.setattr(Snapshot, "_commit", slow)
    assert write(overlay_row(1, "slow"), overlay_row(3, "slow")).number == 3
    got = sorted((r.timestamp_ms, r.cells[0]) for r in tables.read_overlay(spark, path, schema).collect())
    assert got == [(1, "slow"), (2, "fast"), (3, "slow"), (7, "other day")]


def test_a_partition_that_loses_its_rows(spark, tmp_path):
    schema = "k string, v int"
    table = Snapshot(spark, str(tmp_path / "t"), schema, ("k",))
    table.replace(lambda old, _: spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], schema), spark.createDataFrame([("a",), ("b",), (None,)], "k string"))
    table.replace(lambda old, _: old.where("v > 9"), spark.createDataFrame([("a",), (None,)], "k string"), note="n")
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)] and table.current().note == "n"


def test_rates_of_one_long_run_in_chunks(spark):
    """Rates of chunks of any length equal those of one sample after the other; gaps, equal bytes and borders included."""
    import random

    rnd = random.Random(5)
    rows, t, b = [], 0, 0
    for _ in range(1500):
        t += rnd.choice([1, 500_000, 1_000_000, 5_000_000, 10_000_000, 47_000_000]) if rnd.random() < 0.98 else 400_000_000
        b += rnd.choice([0, 10, 5_000])
        rows.append((None if t % 2 else "r", t, b))

    def rate(run, t, b, window, least):
        old = [x for x in run if x[1] <= t - window * 1_000_000]
        start, base = (max(x[1] for x in old), max(x[2] for x in old)) if old else run[0][1:]
        span = (t - start) / 1e6
        return 0.0 if span < least else max(0.0, (b - base) / max(span, 1e-6))

    want = {}
    for name in (None, "r"):
        run, peak = [x for x in rows if x[0] == name], 0.0
        for r in run:
            sustained = rate(run, *r[1:], 10, 5)
            peak = max(peak, sustained)
            want[r[:2]] = (rate(run, *r[1:], 5, 2), sustained, peak)
    frame = spark.createDataFrame(rows, "run_id string, t_us long, cum_bytes long")
    for seconds in (10, 33, 3600):
        got = {(r.run_id, r.t_us): (r.current_bps, r.sustained_bps, r.peak_bps) for r in throughput.throughput(frame, seconds).collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-6 for k in want for x, y in zip(got[k], want[k]))


def test_errors_as_of_probes(spark):
    """Events on both borders count; chunks don't matter; repeated probes stay; null runs are runs."""
    import random

    rnd = random.Random(6)
    events = [(rnd.choice(["a", None]), rnd.randrange(0, 4000) * 500_000) for _ in range(900)]
    points = [(rnd.choice(["a", "b", None]), rnd.randrange(0, 4000) * 500_000, i // 2) for i in range(200)]
    points += points[:3]
    ev, po = spark.createDataFrame(events, "run_id string, t_us long"), spark.createDataFrame(points, "run_id string, t_us long, id long")
    for window, chunk in ((60, 60), (60, 3600), (300, 10)):
        got = sorted((str(r.run_id), r.t_us, r.id, r.errors) for r in throughput.errors_as_of(po, ev, window, chunk_seconds=chunk).collect())
        assert got == sorted((str(run), t, i, sum(e[0] == run and t - window * 1_000_000 <= e[1] <= t for e in events)) for run, t, i in points)
    probes = po.withColumns({"start_us": F.col("t_us") + 7_000_000, "end_us": F.col("t_us") + 40_000_000})
    near = lambda run, t: sum(e[0] == run and t - 300_000_000 <= e[1] <= t for e in events)
    got = sorted((str(r.run_id), r.t_us, r.id, r.candidate_errors) for r in throughput.probe_errors(probes, ev).collect())
    assert got == sorted((str(run), t, i, max(0, near(run, t + 40_000_000) - near(run, t + 7_000_000))) for run, t, i in points)


def exchanges_over(plan, name):
    """How many exchanges stand between the top of a physical plan and the scan of a table."""
    path = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        path = [(d, n) for d, n in path if d < depth] + [(depth, line)]
        if "Scan" in line and name in line:
            return sum("Exchange" in n for _, n in path)
    raise AssertionError(f"no scan of {name}")


def test_compacted_log(spark, tmp_path):
    """Base and delta give what ranking the whole log gives, null keys and ties of time included; the base isn't shuffled."""
    import random

    rnd = random.Random(8)
    shape = "k string, interval string, at long, seq long, v string"
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice(["1h", None, "x"]), rnd.choice([None, *range(6)]), i, f"v{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, shape)
    want = sorted(map(str, tables.latest(frame, ("k", "interval"), "at", "seq").collect()))
    path = str(tmp_path / "log")
    log = CompactedLog(spark, path, shape, ("k", "interval"), ("at", "seq"), buckets=8)
    assert log.latest().collect() == []
    for lo, hi, compact in ((0, 100, True), (100, 170, True), (170, 300, False)):
        log.append(frame.where(F.col("seq").between(lo, hi - 1)))
        assert log.compact(always=compact) == compact
    assert sorted(map(str, log.latest().collect())) == want
    log.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = log.latest()._jdf.queryExecution().executedPlan().toString()
    finally:
        log.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges_over(plan, log.base) == 0 and "Exchange" in plan
    spark.sql(f"drop table {log.base}")
    again = CompactedLog(spark, path, shape, ("k", "interval"), ("at", "seq"), buckets=8)
    assert again.base == log.base and sorted(map(str, again.latest().collect())) == want
    assert len([f for f in os.listdir(path) if f.startswith("log_")]) == 1


def test_incremental_scan(spark, tmp_path):
    """Batches in any order, a replaced file and a replayed batch give what one scan of the lake gives; other months stay."""
    root, store = str(tmp_path / "lake"), str(tmp_path / "scan")
    scan_ = IncrementalScan(spark, store, requests(spark))
    assert scan_.done() == -1
    put(root, DAILY, candles(minutes=range(100, 200)))
    assert scan_.catch_up(root) and not scan_.catch_up(root)

    def same():
        want = scan(spark, root)
        assert sorted(map(str, scan_.by_day().collect())) == sorted(map(str, want["by_day"].collect()))
        got = {r.open_time: (r.mask, r.cells) for r in scan_.merged().collect()}
        bad = {r.open_time: (r.mask, r.cells) for r in want["details"].collect()}
        assert {k: v for k, v in got.items() if v[0]} == bad

    same()
    put(root, MONTH, candles(lambda row: [*row[:9], 12, *row[10:]], minutes=range(0, 1440)))  # late, and bad at 755
    assert scan_.catch_up(root)
    same()
    put(root, DAILY, candles(minutes=range(750, 760)))  # mends 755, and no longer has 100 to 199
    assert scan_.catch_up(root) and scan_.done() == 2
    same()
    before = scan_.state.current()
    assert not scan_.apply(landing.land_lake(spark, root).limit(3), 2) and scan_.state.current() == before
    put(root, DAILY, b"broken now")
    assert scan_.catch_up(root)
    same()


def test_incremental_scan_of_a_lost_batch(spark, tmp_path, monkeypatch):
    """A batch that is lost before its state is switched is done again from the start."""
    root, store = str(tmp_path / "lake"), str(tmp_path / "scan")
    scan_ = IncrementalScan(spark, store, requests(spark))
    put(root, MONTH, candles(minutes=range(0, 1440, 2)))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshot, "_commit", lost)
        try:
            scan_.apply(landing.land_lake(spark, root), 0)
        except RuntimeError:
            pass
    assert scan_.done() == -1 and scan_.merged().count() == 0
    put(root, MONTH, candles(minutes=range(0, 1440, 3)))
    assert scan_.apply(landing.land_lake(spark, root), 0) and scan_.merged().count() == 480


def test_streamed_scan(spark, tmp_path):
    """Archives that come to a stream one by one; a second run of the stream takes new ones only."""
    root, marks = str(tmp_path / "lake"), str(tmp_path / "marks")
    scan_ = IncrementalScan(spark, str(tmp_path / "scan"), requests(spark))
    put(root, MONTH, candles(minutes=range(0, 1440, 2)))
    put(root, "raw/futures/um/daily/klines/OTHER/1m/OTHER-1m-2023-11-30.zip", candles())
    stream_landing.scan_new(root, scan_, marks, at_once=1).awaitTermination()
    assert scan_.by_day().first().found == 720
    put(root, DAILY, candles(minutes=range(10)))
    stream_landing.scan_new(root, scan_, marks, at_once=1).awaitTermination()
    assert scan_.by_day().first().found == 725 and scan_.done() >= 1


def test_scan_does_not_depend_on_partitions(spark, tmp_path):
    """SURVEY section 5: 1 against 13 partitions; and an overlay never adds missing or invalid ones."""
    root = str(tmp_path)
    put(root, MONTH, candles(lambda row: [*row[:9], 12, *row[10:]], minutes=[*range(0, 1440, 3), 755]))
    put(root, DAILY, candles(minutes=range(300, 330)))
    landed = cut(landing.land_lake(spark, root))
    inventory, status = landing.inventory(spark, root), landing.archive_status(landed)
    outs = [klines.scan_klines(landing.raw_rows(landed).repartition(n), requests(spark), inventory, status) for n in (1, 13)]
    for name in ("summary", "by_day", "issues", "details", "archives"):
        assert sorted(map(str, outs[0][name].collect())) == sorted(map(str, outs[1][name].collect()))
    ms = int(DAY.timestamp() * 1000)
    rows = [("BTCUSDT", "1m", [str(ms + i * 60000), "1", "1", "1", "1", v, "0", "1", "1", "1", "1", "0"]) for i, v in ((755, "10"), (1, "10"), (4, "-1"), (3, "x"))]
    overlay = spark.createDataFrame(rows, "symbol string, interval string, cells array<string>")
    before = outs[0]["by_day"].first()
    after = klines.scan_klines(landing.raw_rows(landed), requests(spark), inventory, status, overlay)["by_day"].first()
    assert after.missing < before.missing and after.invalid == 0


def test_evidence_is_pruned(spark, tmp_path):
    """Only partitions of the targets are opened, and only row groups of their times are read."""
    path = str(tmp_path / "evidence")
    base = int(DAY.timestamp() * 1000)
    t = spark.range(0, 60_000, numPartitions=3).selectExpr(
        "'S' || (id % 3) as symbol", "id as agg_id", f"{base} + (id * 7919 % 60000) * 72000 as ms", "cast(1.5 as decimal(18,8)) as price", "cast(2 as decimal(18,8)) as quantity", "id as first_id", "id as last_id", "id % 2 = 0 as maker"
    )
    evidence.write_evidence(t, path, parts=8, group_bytes=1 << 14)
    hours = [(f"S{k}", "1h", base + d * 86_400_000 + 5 * 3_600_000) for k, d in ((0, 2), (1, 2), (1, 3))] + [("S1", "1d", base)]
    targets = spark.createDataFrame(hours, "symbol string, interval string, open_time long")
    rows = evidence.read_evidence(spark, path, targets)
    got = {r.agg_id for r in reconstruct.trades_of(targets, rows).collect()}
    assert got == {r.agg_id for r in reconstruct.trades_of(targets, t).collect()} and got
    rows.collect()
    metrics = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    files, read = (metrics.get(k).get().value() for k in ("numFiles", "numOutputRows"))
    everything = sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(path))
    assert files < everything / 2 and read < 60_000 / 5
    assert evidence.read_evidence(spark, path, targets.limit(0)).count() == 0


def test_ranges():
    spans = [(5, 9), (1, 2), (10, 12), (100, 110), (50, 60), (52, 55)]
    assert evidence.ranges(spans, 9) == [(1, 2), (5, 12), (50, 60), (100, 110)]
    assert evidence.ranges(spans, 2) == [(1, 60), (100, 110)] and evidence.ranges(spans, 1) == [(1, 110)] and evidence.ranges([], 3) == []


def test_slot_words_equal_merged_candles(spark):
    """Random layers with repeats inside an archive, times off the grid and days without anything, for intervals of all sizes."""
    import random

    rnd = random.Random(9)
    day = int(DAY.timestamp() * 1000)
    asked = [(code, "S", "klines", code, D(2023, 11, 30), D(2023, 12, 2)) for code in ("1m", "15m", "1h", "1d")]
    reqs = spark.createDataFrame(asked, "request_id string, symbol string, dataset string, interval string, start date, end date")
    rows = []
    for code, ms in (("1m", 60_000), ("15m", 900_000), ("1h", 3_600_000), ("1d", 86_400_000)):
        for rank in (1, 2, 3):
            for i in range(rnd.choice([40, 700])):
                t = day + rnd.randrange(2 * 86_400_000 // ms) * ms + (1 if rnd.random() < 0.05 else 0)
                rows.append((code, t, rnd.choice([0, 0, 0, 4]), (rank << 40) + i))
    frame = spark.createDataFrame(rows, "request_id string, open_time long, mask long, order_key long").repartition(5)
    merged = klines.merge(frame)
    words = cut(klines.slot_words(frame, reqs))
    want = klines.by_day(merged, reqs)
    assert sorted(map(str, klines.by_day_of_words(words, frame, reqs).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(tuple, klines.missing_slots_of_words(words, reqs).collect())) == sorted(map(tuple, klines.missing_slots(merged, reqs, want).collect()))
    assert words.count() <= 2 * (23 + 2 + 1 + 1)
