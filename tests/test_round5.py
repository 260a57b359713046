"""Trade rounds: what is found in an archive is made in one pass, and stored instead of its rows."""

import os
import random

from pyspark.sql import functions as F

from archlake import queries_store
from archlake.operators import rounds, trades
from archlake.sources import landing
from archlake.sources.shared import shared_dir
from tests.test_archives import put, zipped

BASE = "raw/futures/um/daily/aggTrades/X/X-aggTrades-2022-09-{:02d}.zip"


def plain(rows):
    """rows, first and last id before the first broken rule, that rule, its row and id: event by event."""
    count, first, last, previous = 0, None, None, None
    for number, cells in rows:
        if not cells or "".join(x for x in cells[0].lower() if x.isalnum()) in ("aggtradeid", "aggregatetradeid", "id"):
            continue
        here = int(cells[0]) if cells[0].lstrip("-").isdigit() else None
        error = "INVALID_AGG_ID" if here is None else "NEGATIVE_ID" if here < 0 else None
        if error is None and previous is not None and here <= previous:
            error = "DUPLICATE_ID" if here == previous else "BACKWARD_ID"
        if error:
            return count, first, last, error, number, here
        count, first, last, previous = count + 1, here if first is None else first, here, here
    return count, first, last, None, None, None


def test_archives_in_chunks_of_any_size(spark):
    """Broken rules at the borders of chunks, in chunks without payload and in archives without any, as event by event."""
    rng, made, want = random.Random(7), [], {}
    for a in range(60):
        path, rows, at = f"p{a}", [], 100
        for number in range(1, rng.randrange(1, 40)):
            at += rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, -3]) if rng.random() < 0.3 else 1
            first = rng.choice(["x", "-5", " Agg_Trade_ID", "id"]) if rng.random() < 0.06 else str(at)
            rows.append((number, [] if rng.random() < 0.1 else [first, "1", "1", "1", "1", "5", "true"]))
        size = rng.choice([1, 2, 5, 50])
        made += [(path, i // size, i, number, cells, None) for i, (number, cells) in enumerate(rows)]
        made.append((path, None, None, 1, None, "broken"))
        want[path] = plain(rows)
    landed = spark.createDataFrame(made, "path string, chunk_id long, ordinal long, row_number long, cells array<string>, error string")
    got = {r.path: r for r in trades.archive_trades(landed).collect()}
    assert {p: (r.rows, r.first_agg_id, r.last_agg_id, r.first_error, r.error_row, r.error_id) for p, r in got.items()} == want
    assert all(r.read_error == "broken" and r.valid_zip for r in got.values())


def test_checked_archives_are_opened_once(spark, tmp_path, monkeypatch):
    """An archive is opened again only when its file has changed, and its rows aren't stored."""
    root, opened = str(tmp_path), []
    land_files = landing.land_files
    monkeypatch.setattr(landing, "land_files", lambda spark, new, *a: opened.append(sorted(r.path for r in new.select("path").collect())) or land_files(spark, new, *a))
    line = "{0},1,1,{0},{0},5,true\n"
    for d in (1, 2):
        put(root, BASE.format(d), zipped(line.format(d)))
    lake = rounds.Lake(spark, root)
    see = lambda: {r.path: (r.rows, r.first_error) for r in lake.checked(lake.inventory(), lake.inventory()).collect()}
    assert see() == see() == {BASE.format(1): (1, None), BASE.format(2): (1, None)}
    put(root, BASE.format(2), zipped(line.format(7) * 2))
    os.remove(os.path.join(root, BASE.format(1)))
    assert see() == {BASE.format(2): (1, "DUPLICATE_ID")}
    assert opened == [[BASE.format(1), BASE.format(2)], [BASE.format(2)]]
    stored = lake.store.removeprefix("file:")
    assert shared_dir(spark).removeprefix("file:") in stored and os.listdir(stored) == ["checked"]


def test_few_archives_are_a_task_each(spark, tmp_path):
    for d in range(1, 5):
        put(str(tmp_path), BASE.format(d), zipped(f"{d},1,1,1,1,5,true\n" * 3))
    landed = landing.land_lake(spark, str(tmp_path))
    assert landed.count() == 12 and landed.select("path", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() == 4


def test_packed_archives_are_files(spark, tmp_path):
    """Archives are packed into files and copied as files; their contents aren't values of a table."""
    source, root = (str(tmp_path / x) for x in ("offers", "lake"))
    rows = spark.range(30_000).select(F.concat(F.lit(BASE.format(1)[:-5]), F.col("id") % 3 + 1, F.lit(".zip")).alias("path"), (-F.col("id")).alias("n"), F.concat(F.lit("r"), "id").alias("line"))
    made = queries_store.packed(rows, source)
    assert made.columns == ["path", "length"]
    made = {r.path: r.length for r in made.collect()}
    here = {r.path: r.length for r in landing.copied(spark.createDataFrame([(p,) for p in made if not p.endswith("3.zip")], "path string"), source, root).collect()}
    assert len(made) == 3 and len(here) == 2 and here.items() <= made.items()
    for p in here:
        with open(f"{source}/{p}", "rb") as a, open(f"{root}/{p}", "rb") as b:
            data = b.read()
            assert a.read() == data and len(data) == here[p]
    landed = landing.land_lake(spark, source).collect()
    assert len(landed) == 30_000 and all(r.cells == [f"r{29_999 - (29_999 - int(r.path[-5]) + 1) % 3 - 3 * (r.row_number - 1)}"] for r in landed)
