"""Registered queries against their SQL on tables with values that the driver's small ones lack."""

import os
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archlake import queries as Q
from archlake import queries_store  # noqa: F401 (registers more queries)
from tests.test_queries import DATA, norm

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def differing(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    got = Q.QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    want = con.sql(Q.ORACLE[name])
    at = [want.columns.index(c) for c in cols]
    a, b = Counter(tuple(norm(r[c]) for c in cols) for r in got.collect()), Counter(tuple(norm(v[i]) for i in at) for v in want.fetchall())
    return (a - b) + (b - a)


@pytest.fixture(scope="module")
def free(tmp_path_factory):
    """The smallest tables, with events whose value is 0 among trades of all kinds of candles."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("free"))
    for f in os.listdir(DATA):
        if f != "events.parquet":
            shutil.copy(f"{DATA}/{f}", folder)
    duckdb.connect().sql(f"copy (select * replace (case when event_id % 7 = 3 then 0.0 else value end as value) from '{DATA}/events.parquet') to '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "archive_stats", "bad_candles", "bad_candles_truncated", "candle_build", "daily_repairs", "evidence_days", "incremental_scan", "invalid_by_day", "issue_counts", "layered_last_wins",
        "overlay_scan", "reconstruct_pruned", "reconstruct_totals", "reconstruct_verdict", "repair_round", "trade_archive_stats", "trade_first_error", "trade_order_check", "trade_round",
    ],
)
def test_trades_of_no_value_are_no_defects(spark, free, name):
    assert not differing(spark, free, name)


def test_fixed_rounds_by_the_exact_value(spark):
    import random

    from archlake.functions import exprs as E

    rng = random.Random(4)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.125, 0.375, 204.95, 1844.55, 0.995, 1.005, 2.675, 1e-9, 1e13 + 0.0625, -0.15, -2.675, 4.5e13, 1e17, 123456789.125]
    values += [rng.randrange(10**7) / 1000 for _ in range(500)] + [rng.uniform(0, 10**9) for _ in range(200)] + [k * 4099 * 8 / 1000000 for k in range(6250, 200000, 6250)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", E.fixed(F.col("v"), 1).alias("one"), E.fixed(F.col("v"), 2).alias("two")).collect()
    assert [(r["one"], r["two"]) for r in got] == [(f"{r['v']:.1f}", f"{r['v']:.2f}") for r in got]


def changed(tmp_path, table, sql):
    """The smallest tables, one of them changed by SQL."""
    import duckdb

    folder = str(tmp_path)
    for f in os.listdir(DATA):
        if f != f"{table}.parquet":
            shutil.copy(f"{DATA}/{f}", folder)
    duckdb.connect().sql(f"copy ({sql.format(f"'{DATA}/{table}.parquet'")}) to '{folder}/{table}.parquet'")
    return folder


def test_report_texts_of_borders(spark, tmp_path):
    """Order 6250 has 204.95 Mbps, a little less as a double."""
    assert not differing(spark, changed(tmp_path, "orders", "select * replace (o_orderkey * 6250 as o_orderkey) from {}"), "report_texts")


def test_level_averages_of_halves(spark, tmp_path):
    """Levels of many speeds that lie half-way between two whole numbers of bits a second."""
    sql = "select l.* replace (i as l_suppkey, 32 as l_linenumber, i * 7919 + 1 as l_partkey) from (select * from {} limit 1) l, range(3000) r(i)"
    assert not differing(spark, changed(tmp_path, "lineitem", sql), "level_averages")


def test_tree_of_batches_equals_single_rows():
    """A tree that is read level by level, in batches that cut paths apart, and quickly: node by node these 20,000 paths took 3.8 s."""
    import time

    import numpy as np
    import pyarrow as pa

    from archlake.llm import divergence

    rng = np.random.default_rng(3)
    none = rng.integers(1, 50, 20)
    rows = sorted({tuple((int(i), int(none[i] + rng.integers(0, 3)), int(none[i])) for i in np.flatnonzero(rng.random(20) < 0.8)) for _ in range(20_000)})
    kind = pa.list_(pa.struct([("place", pa.int64()), ("share", pa.int64()), ("none", pa.int64())]))
    made = [pa.record_batch([pa.array(["x"] * len(part), pa.string()), pa.array([[{"place": a, "share": b, "none": c} for a, b, c in p] for p in part], kind), pa.array([2] * len(part), pa.int64())], names=["lang", "path", "n"]) for part in (rows[:7001], rows[7001:])]
    began = time.process_time()
    got = Counter()
    for batch in divergence.shared_terms(iter(made)):
        for i, j, v in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            got[i, j] += v
    took = time.process_time() - began
    dense, there = np.tile(none, (len(rows), 1)), np.zeros((len(rows), 20), bool)
    for r, path in enumerate(rows):
        for a, b, _ in path:
            dense[r, a], there[r, a] = b, True
    for j in range(20):
        for i in range(j):
            a, b = dense[:, i], dense[:, j]
            v = np.abs(a - b) - np.abs(a - none[j]) - np.abs(none[i] - b) + abs(none[i] - none[j])
            assert got[i, j] == 2 * int(v[there[:, i] & there[:, j]].sum())
    assert took < 2


def test_lines_are_packed_in_order(spark):
    """Archives are packed from sorted lines, a batch at a time, and not from whole texts."""
    from archlake.sources import landing

    rows = spark.range(30_000).select(F.concat(F.lit("p"), F.col("id") % 3).alias("path"), (-F.col("id")).alias("n"), F.concat(F.lit("r"), "id").alias("line"))
    landed = landing.land(queries_store.zipped(rows)).select("path", "row_number", F.get("cells", F.lit(0)).alias("line")).collect()
    assert len(landed) == 30_000 and all(r["line"] == f"r{29_999 - (2 - int(r['path'][1])) - 3 * (r['row_number'] - 1)}" for r in landed)


def test_small_archives_leave_together():
    import pyarrow as pa

    from archlake.sources import landing

    some = [pa.record_batch([pa.array([i])], names=["x"]) for i in range(10_000)]
    got = list(landing._gathered(iter(some)))
    assert len(got) < 5 and [x for b in got for x in b.column(0).to_pylist()] == list(range(10_000))


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The smallest tables, with users whose numbers are shifted by thousands of millions, so that volumes pass ten digits."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("grown"))
    for f in os.listdir(DATA):
        if f != "events.parquet":
            shutil.copy(f"{DATA}/{f}", folder)
    sql = f"select e.* replace (event_id + 1000000 * i as event_id, user_id + 1000000000 * i as user_id) from '{DATA}/events.parquet' e, range(1, 7) r(i)"
    duckdb.connect().sql(f"copy ({sql}) to '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "archive_stats", "bad_candles", "bad_candles_truncated", "daily_repairs", "evidence_days", "incremental_scan", "invalid_by_day", "issue_counts", "layered_last_wins", "overlay_scan",
        "reconstruct_pruned", "reconstruct_totals", "reconstruct_verdict",
    ],
)
def test_planted_defects_of_large_volumes(spark, grown, name):
    assert not differing(spark, grown, name)


def test_wide_decimals(spark):
    from archlake.functions import exprs as E

    cells = ["12345678901.5", "0.123456789", "1e20", "9" * 22 + ".5", "1" * 23, "0.12345678901234567", "x", "", "nan"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(E.wide_decimal(F.col("c")).alias("w"), E.decimal(F.col("c")).alias("d")).collect()
    assert [None if r["w"] is None else f"{r['w'].normalize():f}" for r in got] == ["12345678901.5", "0.123456789", "1" + "0" * 20, "9" * 22 + ".5", None, None, None, None, None]
    assert all(r["d"] is None for r in got)


def test_encoding_takes_little_memory():
    """Blocks of 1 MB took over 60 MB of a worker beside the other stages' and the JVM's."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql import types as T

    from archlake.llm import bpe, packing

    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(1500)]
    path, caught = public_tokenizers.path("byte_bpe_50k.json"), []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    packing.encode_pieces(SimpleNamespace(schema=schema, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: caught.append(run))), path, 2048, 1)
    bpe.load(path).encode(np.frombuffer(b"warm", np.uint8), np.array([0, 4]))
    tracemalloc.start()
    rows = sum(b.num_rows for b in caught[0](iter([pa.record_batch([pa.array(range(1500)), pa.array(texts)], names=["doc_id", "text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 and peak < 40e6, peak
