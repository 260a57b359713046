"""The tables that operators read, and where long jobs cut their lineage (see sources.shared)."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from archlake.llm.blocks import release
from archlake.sources import shared
from archlake.sources.shared import drop, remove, scratch, shared_dir

__all__ = ["cut", "drop", "remove", "scratch", "settle", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(spark: SparkSession) -> bool:
    """The driver gives memory that it has freed back to the system, in Python and in Java (17.0.9 or later; False on others).

    Plans of many joins leave its Java process with hundreds of MB that the C library keeps for later.
    """
    release()
    try:
        java = spark._jvm
        server = java.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is not open to callers
        call = next(m for m in server.getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(java.Object, call.getParameterCount())  # the rest stays null
        given[0], given[1] = java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(java.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except (Py4JError, AttributeError, TypeError):  # another Java, or a session without one
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """shared.cut(), after which the driver gives freed memory back: jobs of many tables would pile it up."""
    back = shared.cut(df)
    settle(df.sparkSession)
    return back
