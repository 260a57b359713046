"""Incremental landing: archives that weren't there at the last run, as a stream that ends when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archlake.operators.increments import IncrementalScan
from archlake.sources import landing
from archlake.sources.shared import cut


def _new(spark: SparkSession, root: str, at_once: int | None) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip")
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).load(root)


def scan_new(root: str, scan: IncrementalScan, checkpoint: str, at_once: int | None = None) -> StreamingQuery:
    """Take all archives below root that the checkpoint hasn't seen into a scan's state, `at_once` of them a batch, then stop.

    The stream holds places of files; a batch that comes again after a loss has the same id, and changes nothing.
    """
    spark = scan.spark

    def batch(new: DataFrame, number: int) -> None:
        chosen = cut(new.select(F.col("path").alias("file"), "length"))
        scan.apply(cut(landing.with_keys(landing.land_files(spark, chosen))), number)

    return _new(spark, root, at_once).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_new(spark: SparkSession, root: str, to: str, checkpoint: str) -> StreamingQuery:
    """Land all archives below root that the checkpoint hasn't seen into the Parquet table at `to`, then stop."""
    new = _new(spark, root, None)
    # where tasks can open files, the stream holds places only
    landed = landing.with_keys(landing.land_by_path(new.select(F.col("path").alias("file"))) if landing.opens(root) else landing.land(new))
    return landed.writeStream.format("parquet").partitionBy("dataset", "symbol", "month").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
