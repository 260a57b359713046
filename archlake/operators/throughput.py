"""Transfer rates, connection levels and calibration, from logs of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000

# Windows and the least evidence in them, in seconds; retention of error events.
CURRENT_WINDOW, CURRENT_LEAST = 5, 2
PEAK_WINDOW, PEAK_LEAST = 10, 5
ERROR_RETENTION = 2 * 3600
CALIBRATION_INTERVAL, CANDIDATE_WINDOW = 3600, 300

#: Seconds of a run that one task works on at least.
CHUNK_SECONDS = 3600

# The share of the best speed that a level has to reach, the gain that a higher cap has to bring, the errors
# that stop it, the step, and the least and greatest cap.
RECOMMENDATION = 0.95
LEAST_GAIN_PCT, ERRORS, STEP, LEAST_CONNECTIONS, MOST_CONNECTIONS = 5.0, 3, 8, 4, 32


def _chunk(at: str, seconds: int) -> Column:
    return F.floor(F.col(at) / (seconds * SECOND)).cast("long")


def _dealt(rows: DataFrame, at: str, seconds: int, overlap: int) -> DataFrame:
    """rows by chunk of time (_chunk); the last `overlap` seconds of a chunk come to the next one, too, as guests (_guest)."""
    late = F.pmod(F.col(at), F.lit(seconds * SECOND)) >= (seconds - overlap) * SECOND
    own = F.struct(_chunk(at, seconds).alias("c"), F.lit(False).alias("g"))
    guest = F.struct((_chunk(at, seconds) + 1).alias("c"), F.lit(True).alias("g"))
    return rows.withColumn("_in", F.explode(F.when(late, F.array(own, guest)).otherwise(F.array(own)))).select(*rows.columns, F.col("_in.c").alias("_chunk"), F.col("_in.g").alias("_guest"))


def _carried(samples: DataFrame, seconds: int) -> DataFrame:
    """What a run's chunks take over from those before (_run, _at, first: the run's first sample; time and bytes: the greatest of
    all samples PEAK_WINDOW and more before the chunk). One row for a chunk, from a scan over the chunks' summaries."""
    early = F.pmod("t_us", F.lit(seconds * SECOND)) < (seconds - PEAK_WINDOW) * SECOND
    top = lambda c, when=None: F.max(F.col(c) if when is None else F.when(when, F.col(c)))
    each = samples.groupBy("run_id", _chunk("t_us", seconds).alias("_at")).agg(
        F.min(F.struct("t_us", "cum_bytes")).alias("first"), top("t_us").alias("t"), top("cum_bytes").alias("b"), top("t_us", early).alias("early_t"), top("cum_bytes", early).alias("early_b")
    )
    run = Window.partitionBy("run_id").orderBy("_at")
    before, last = run.rangeBetween(Window.unboundedPreceding, -2), run.rangeBetween(-1, -1)
    return each.select(
        F.col("run_id").alias("_run"), "_at", F.min("first").over(run.rangeBetween(Window.unboundedPreceding, 0)).alias("first"),
        F.greatest(F.max("t").over(before), F.max("early_t").over(last)).alias("time"), F.greatest(F.max("b").over(before), F.max("early_b").over(last)).alias("bytes"),
    )


def rolling_rate(window: int, least: int) -> Column:
    """Bytes a second over the trailing window (E5): since the newest sample at or before its start, else the first one; 0
    if that is less than `least` seconds ago. Over samples that are dealt to chunks and have what their chunk takes over."""
    old = Window.partitionBy("run_id", "_chunk").orderBy("t_us").rangeBetween(Window.unboundedPreceding, -window * SECOND)
    start = F.coalesce(F.greatest(F.max("t_us").over(old), F.col("time")), F.col("first.t_us"))
    base = F.coalesce(F.greatest(F.max("cum_bytes").over(old), F.col("bytes")), F.col("first.cum_bytes"))
    span = (F.col("t_us") - start) / SECOND
    rate = F.greatest(F.lit(0.0), (F.col("cum_bytes") - base) / F.greatest(span, F.lit(1e-6)))
    return F.when(span < least, F.lit(0.0)).otherwise(rate)


def throughput(samples: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Samples with current_bps, sustained_bps and peak_bps, the highest sustained rate so far.

    A run is dealt to chunks of time, so that a long one is many tasks' work: windows end at a chunk, with what they need of
    the one before, and running maxima are carried over from a scan of one row for each chunk. samples: run_id, t_us, cum_bytes.
    """
    if chunk_seconds < PEAK_WINDOW:
        raise ValueError("a chunk is as long as the longest window at least")
    carried = _carried(samples, chunk_seconds)
    dealt = _dealt(samples, "t_us", chunk_seconds, PEAK_WINDOW)
    met = dealt.join(carried, dealt["run_id"].eqNullSafe(carried["_run"]) & (dealt["_chunk"] == carried["_at"]))
    rated = met.withColumns({"current_bps": rolling_rate(CURRENT_WINDOW, CURRENT_LEAST), "sustained_bps": rolling_rate(PEAK_WINDOW, PEAK_LEAST)}).where("not _guest")
    rated = rated.select(*samples.columns, "_chunk", "current_bps", "sustained_bps")
    run = Window.partitionBy("run_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    peaks = rated.groupBy(F.col("run_id"), F.col("_chunk").alias("_at")).agg(F.max("sustained_bps").alias("most"))
    peaks = peaks.select(F.col("run_id").alias("_run"), "_at", F.max("most").over(run).alias("_before"))
    inside = Window.partitionBy("run_id", "_chunk").orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("_peak", F.max("sustained_bps").over(inside))
    met = rated.join(peaks, rated["run_id"].eqNullSafe(peaks["_run"]) & (rated["_chunk"] == peaks["_at"]))
    return met.select(*samples.columns, "current_bps", "sustained_bps", F.greatest("_peak", "_before").alias("peak_bps"))


def run_averages(samples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per run: elapsed seconds, average bytes a second and, with files (run_id, completed, total), the rate and time left."""
    out = samples.groupBy("run_id").agg(((F.max("t_us") - F.min("t_us")) / SECOND).alias("elapsed"), F.max("cum_bytes").alias("bytes"))
    out = out.withColumn("average_bps", F.col("bytes") / F.greatest("elapsed", F.lit(1e-6)))
    if files is None:
        return out
    met = out.join(files, "run_id", "left")
    left = F.when((F.col("completed") > 0) & (F.col("total") > F.col("completed")), F.col("elapsed") / F.col("completed") * (F.col("total") - F.col("completed")))
    return met.withColumns({"files_per_minute": F.col("completed") / F.greatest("elapsed", F.lit(1e-6)) * 60, "eta_seconds": left})


def _window(seconds: float) -> int:
    """Windows are 1 second to 2 hours long; in microseconds."""
    return int(min(max(seconds, 1), ERROR_RETENTION) * SECOND)


def errors_as_of(points: DataFrame, events: DataFrame, window_seconds: float, name: str = "errors", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """points (run_id, t_us and more) with how many error events (run_id, t_us) the window that ends there holds, its start and
    its end included (E7). Both are one stream of rows by chunk of time, with the window's length of events from the chunk
    before; nothing is joined, and a run is many tasks' work."""
    w = _window(window_seconds)
    seconds = max(chunk_seconds, -(-w // SECOND))
    point = points.select("run_id", "t_us", F.struct(*points.columns).alias("_point"), _chunk("t_us", seconds).alias("_chunk"))
    event = _dealt(events.select("run_id", "t_us"), "t_us", seconds, -(-w // SECOND)).drop("_guest")
    both = point.unionByName(event, allowMissingColumns=True)
    trailing = Window.partitionBy("run_id", "_chunk").orderBy("t_us").rangeBetween(-w, Window.currentRow)
    counted = both.withColumn(name, F.count_if(F.col("_point").isNull()).over(trailing)).where("_point is not null")
    return counted.select("_point.*", name)


def trailing_errors(events: DataFrame, window_seconds: float) -> DataFrame:
    """Error events with how many the trailing window holds, its start included (E7); windows are 1 second to 2 hours long."""
    return errors_as_of(events, events, window_seconds)


def level_averages(levels: DataFrame) -> DataFrame:
    """Bits a second, Mbps and MB/s of each level of each benchmark (D18): benchmark_id, connections, network_bytes, elapsed, errors."""
    out = levels.groupBy("benchmark_id", "connections").agg(F.sum("network_bytes").alias("network_bytes"), F.sum("elapsed").alias("elapsed"), F.sum("errors").alias("errors"))
    s = F.greatest("elapsed", F.lit(1e-6))
    bits = F.col("network_bytes") * 8 / s
    return out.withColumns({"average_bps": bits, "average_mbps": bits / 1_000_000, "average_mb_s": F.col("network_bytes") / s / 1_048_576})


def recommend_level(levels: DataFrame) -> DataFrame:
    """Per benchmark: the fewest connections within 95 % of the best speed, free of errors if any is.

    levels: benchmark_id, position, connections, average_mbps, network_bytes, errors. Levels without bytes don't count; of
    equally fast ones the first is best. No usable level gives no row.
    """
    used = levels.where("network_bytes > 0")
    best = used.groupBy("benchmark_id").agg(F.max(F.struct("average_mbps", (-F.col("position")).alias("p"), "connections")).alias("b"))
    met = used.join(best, "benchmark_id").where(F.col("average_mbps") >= F.col("b.average_mbps") * RECOMMENDATION)
    pick = lambda c: F.coalesce(F.min(F.when(F.col("errors") == 0, c)), F.min(c))
    out = met.groupBy("benchmark_id").agg(pick(F.struct("connections", "position", "average_mbps")).alias("r"), F.first("b").alias("b"))
    return out.select(
        "benchmark_id", F.col("r.connections").alias("recommended_connections"), F.col("r.average_mbps").alias("recommended_mbps"), F.col("b.connections").alias("best_connections"),
        F.col("b.average_mbps").alias("best_mbps"), (F.col("r.average_mbps") / F.greatest("b.average_mbps", F.lit(0.000001)) * 100).alias("efficiency_pct"),
    )


def better(baseline: Column, candidate: Column, errors: Column) -> Column:
    """Whether a higher cap brought a stable gain."""
    b, c = F.greatest(baseline, F.lit(0.0)), F.greatest(candidate, F.lit(0.0))
    return F.when(errors >= ERRORS, False).when(b <= 0, c > 0).otherwise(c >= b * (1 + LEAST_GAIN_PCT / 100))


def probe_errors(probes: DataFrame, events: DataFrame, interval_seconds: float = CALIBRATION_INTERVAL) -> DataFrame:
    """probes with recent_errors and candidate_errors (E9): events in the interval up to the decision, and by how many more the
    last five minutes hold at the end of the candidate's measurement than at its start, 0 at least.

    probes: run_id, t_us, start_us and end_us of the candidate's measurement, and more; events: run_id, t_us.
    """
    columns = probes.columns
    row = F.struct(*columns)
    at = F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(i).alias("i")) for i, c in enumerate(("start_us", "end_us"))]))
    points = probes.select("run_id", row.alias("row"), at.alias("at")).select("run_id", F.col("at.t").alias("t_us"), "row", F.col("at.i").alias("i"))
    counted = errors_as_of(points, events, CANDIDATE_WINDOW)
    each = F.sum(F.when(F.col("i") == 1, F.col("errors")).otherwise(-F.col("errors")))
    met = counted.groupBy("row").agg(each.alias("more"), F.count_if(F.col("i") == 1).alias("times"))
    rows = met.select("row.*", F.greatest(F.lit(0), F.floor(F.col("more") / F.col("times"))).cast("long").alias("candidate_errors"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).drop("_time")
    return errors_as_of(rows, events, interval_seconds, "recent_errors")


def calibration_verdicts(probes: DataFrame) -> DataFrame:
    """Logged probes with action and the cap after it.

    probes: cap, recent_errors, baseline_mbps, candidate_mbps, candidate_errors. Too many errors lower the cap by a step, else
    a step more is tried and kept if better(); at the greatest cap, and without traffic, nothing is done.
    """
    cap, errors = F.col("cap"), F.col("recent_errors")
    lower, higher = F.greatest(F.lit(LEAST_CONNECTIONS), cap - STEP), F.least(F.lit(MOST_CONNECTIONS), cap + STEP)
    keep = better(F.col("baseline_mbps"), F.col("candidate_mbps"), F.col("candidate_errors"))
    action = (
        F.when((errors >= ERRORS) & (cap > LEAST_CONNECTIONS), "backoff").when(higher <= cap, "at maximum").when(F.col("baseline_mbps") <= 0, "no traffic").when(keep, "raise").otherwise("revert")
    )
    return probes.withColumn("action", action).withColumn("cap_after", F.when(F.col("action") == "backoff", lower).when(F.col("action") == "raise", higher).otherwise(cap))
