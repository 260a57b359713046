"""Validation of aggregate-trade event streams: the first broken rule of each archive, whatever its size.

Events of an archive are ordered; comparing each with the one before would put a whole archive into one task. Archives are
cut into chunks of rows at landing: inside a chunk a window looks back, across chunks the last id of the chunk before does.
What an archive is found to be is made in one pass over its rows: each is dealt to its chunk's task and read there, and what
is left of a chunk is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.functions import rules as R

#: What is found in an archive (archive_trades).
FOUND = "rows long, first_agg_id long, last_agg_id long, first_error string, error_row long, error_id long, read_error string, valid_zip boolean"

_FIELDS = ("agg_id", "price", "quantity", "first_id", "last_id", "transact_time", "maker")


def _payload() -> Column:
    return F.coalesce(F.size("cells") > 0, F.lit(False)) & ~F.coalesce(R.trade_header(F.col("cells")), F.lit(False))


def trade_rows(raw: DataFrame) -> DataFrame:
    """Payload rows with typed fields (A8): no blank rows, no headings."""
    return raw.where(_payload()).withColumns(R.trade_fields(F.col("cells")))


def with_previous(rows: DataFrame) -> DataFrame:
    """rows with previous_id, the aggregate id of the payload row before it in the archive."""
    inside = Window.partitionBy("path", "chunk_id").orderBy("ordinal")
    last = rows.groupBy("path", "chunk_id").agg(F.max_by("agg_id", "ordinal").alias("last_agg_id"))
    across = last.select("path", "chunk_id", F.lag("last_agg_id").over(Window.partitionBy("path").orderBy("chunk_id")).alias("before"))
    met = rows.withColumns({"_own": F.lag("agg_id").over(inside), "_n": F.row_number().over(inside)}).join(across, ["path", "chunk_id"])
    return met.withColumn("previous_id", F.when(F.col("_n") == 1, F.col("before")).otherwise(F.col("_own"))).drop("_own", "_n", "before")


def check_rows(raw: DataFrame) -> DataFrame:
    """Payload rows with error, the first rule that each breaks, or null."""
    return with_previous(trade_rows(raw)).withColumn("error", R.trade_error(F.col("cells"), {k: F.col(k) for k in _FIELDS}, F.col("previous_id")))


def first_errors(checked: DataFrame) -> DataFrame:
    """path, error, row_number, member_idx and the offending id of each archive's first bad row."""
    bad = checked.where("error is not null").groupBy("path").agg(F.min_by(F.struct("error", "row_number", "member_idx", "agg_id", "ordinal"), "ordinal").alias("f"))
    return bad.select("path", "f.*")


def archive_trades(landed: DataFrame) -> DataFrame:
    """Per archive: payload rows before its first broken rule, their first and last id, that rule with its row and id (D7, E8), and
    what landing says of it (A4): read_error and valid_zip.

    landed: path, chunk_id, ordinal, row_number, cells and error, all rows of landing or the raw ones. Rows are dealt by chunk before they are
    looked at, as one task reads an archive; ids and findings only are sorted.
    """
    dealt = landed.select("path", "chunk_id", "ordinal", "row_number", "cells", F.col("error").alias("read_error")).repartition("path", "chunk_id")
    typed = dealt.withColumn("payload", _payload()).withColumns(R.trade_fields(F.col("cells")))
    own = F.when(F.col("payload"), R.trade_row_error(F.col("cells"), {k: F.col(k) for k in _FIELDS}))
    seen = typed.select("path", "chunk_id", "payload", "ordinal", "row_number", "agg_id", own.alias("own"), "read_error", F.coalesce(F.size("cells") > 0, F.lit(False)).alias("filled"))
    chunk = ("path", "chunk_id", "payload")
    inside = Window.partitionBy(*chunk).orderBy("ordinal")
    rows = seen.withColumns({"before": F.lag("agg_id").over(inside), "n": F.row_number().over(inside)})
    rows = rows.withColumn("error", F.coalesce("own", R.trade_order_error(F.col("agg_id"), F.col("before"))))
    chunks = rows.groupBy(*chunk).agg(
        F.max("n").alias("n"), F.count_if("filled").alias("filled"), F.max("read_error").alias("read_error"),
        F.min_by(F.struct("agg_id", "row_number", "own"), "ordinal").alias("head"), F.max_by("agg_id", "ordinal").alias("last"),
        F.min_by(F.struct("error", "row_number", "agg_id", "n", "before"), F.when(F.col("error").isNotNull(), F.col("ordinal"))).alias("stop"),
    )
    # few rows from here on: the first row of a chunk is compared with the last one of the chunk before
    along = Window.partitionBy("path", "payload").orderBy("chunk_id")
    met = chunks.withColumn("across", F.lag("last").over(along))
    order = F.when(F.col("payload") & F.col("head.own").isNull(), R.trade_order_error(F.col("head.agg_id"), F.col("across")))
    first = F.struct(order.alias("error"), F.col("head.row_number").alias("row_number"), F.col("head.agg_id").alias("agg_id"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("before"))
    met = met.withColumn("stop", F.when(F.col("payload"), F.when(order.isNotNull(), first).otherwise(F.col("stop"))))
    met = met.withColumn("good", F.coalesce(F.col("stop.n") - 1, F.col("n")))
    met = met.withColumn("last", F.when(F.col("stop").isNull(), F.col("last")).otherwise(F.when(F.col("good") == 0, F.col("across")).otherwise(F.col("stop.before"))))
    stopped = F.coalesce(F.max(F.col("stop").isNotNull()).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    met = met.withColumn("counts", F.col("payload") & ~stopped)
    counted = lambda c: F.when(F.col("counts"), c)
    at = counted(F.col("chunk_id"))
    found = met.groupBy("path").agg(
        F.coalesce(F.sum(counted(F.col("good"))), F.lit(0)).alias("rows"), F.min_by(F.when(F.col("good") > 0, F.col("head.agg_id")), at).alias("first_agg_id"), F.max_by("last", at).alias("last_agg_id"),
        *[F.max(counted(F.col(f"stop.{c}"))).alias(name) for c, name in (("error", "first_error"), ("row_number", "error_row"), ("agg_id", "error_id"))],
        F.coalesce(F.max("read_error"), F.when(F.sum("filled") == 0, F.lit("no rows"))).alias("read_error"),
    )
    return found.withColumn("valid_zip", F.coalesce("read_error", F.lit("")) != "not a ZIP file").select("path", *[c.split()[0] for c in FOUND.split(", ")])


def scan_agg_trades(raw: DataFrame, sources: DataFrame, status: DataFrame) -> dict[str, DataFrame]:
    """A scan's tables (H9) from raw rows and the archives' status; see scan_found."""
    per = archive_trades(raw.withColumn("error", F.lit(None).cast("string"))).drop("read_error", "valid_zip")
    return scan_found(status.select("path", F.col("error").alias("read_error"), "valid_zip").join(per, "path", "left"), sources)


def scan_found(found: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """A scan's tables (H9): archives and summary.

    found: archive_trades() of the archives that are there; sources: plan rows with request_id, the files to look at
    (effective_trade_sources). Whole archives are checked, not only the days asked for. An archive is missing if it isn't
    found, and invalid with a broken rule, no rows or a read error; a broken rule comes first in a file, so it is the one
    that is told. complete is null for a request without archives.
    """
    met = sources.join(found, "path", "left")
    error = F.coalesce("first_error", "read_error", F.when(F.coalesce("rows", F.lit(0)) == 0, F.lit("no rows")))
    exists = F.col("valid_zip").isNotNull()
    archives = met.select(
        "request_id", "dataset", "symbol", "period", "key", "path", exists.alias("exists"), (exists & error.isNull()).alias("valid"),
        F.when(exists, error).alias("error"), "error_row", "error_id", F.coalesce("rows", F.lit(0)).alias("rows"), "first_agg_id", "last_agg_id",
    )
    return {"archives": archives, "summary": trade_summary(archives)}


def trade_summary(archives: DataFrame) -> DataFrame:
    name = F.concat("period", F.lit(":"), "key")
    missing, invalid = ~F.col("exists"), F.col("exists") & ~F.col("valid")
    return archives.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("archives_scanned"), F.count_if(missing).alias("missing_archives"), F.count_if(invalid).alias("invalid_archives"),
        F.array_sort(F.collect_list(F.when(missing, name))).alias("missing_keys"), F.array_sort(F.collect_list(F.when(invalid, name))).alias("invalid_keys"),
        F.bool_and(F.col("valid")).alias("complete"),
    )
