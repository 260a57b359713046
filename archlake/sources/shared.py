"""Where jobs cut their lineage: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", found)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new place below the shared folder, in the part of it that belongs to this application (see clear)."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: it survives lost executors, is computed and planned once."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; nothing happens if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove the table of a DataFrame that cut() has made and that nothing reads any more."""
    remove(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has stored for itself; its results that read them must have been written."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
