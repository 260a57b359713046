"""Joins of rows with the figures of their groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is heavy, so that at most HEAVY keys are.
HEAVY = 256

#: Places that the rows of a heavy key are dealt to.
SALTS = 64


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column, grows: bool = False) -> DataFrame:
    """rows with the columns of groups, null where a row has no group (a left join; null keys are equal).

    groups: one row per value of the keys, with the number of its rows in the column `size`. The rows of heavy keys are dealt
    to SALTS places by `spread`, a bigint that doesn't change when a task is run again. Only hashes of the at most HEAVY heavy
    keys come to the driver; a hash decides about places only, never about equality. grows: the groups grow with the rows, so
    that both sides are sorted and merged whatever their size; otherwise Spark chooses.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = [r[0] for r in groups.where(F.col(size) > max(total // HEAVY, 1000)).select(F.xxhash64(*keys)).distinct().collect()]
    groups = groups.hint("merge") if grows else groups
    own = [f"_own_{i}" for i in range(len(keys))]
    right = groups.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[c for c in groups.columns if c not in keys])
    met = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        met = met & F.col(k).eqNullSafe(F.col(o))
    if not heavy:
        return rows.join(right, met, "left").drop(*own)
    left = rows.withColumn("_salt", F.when(F.xxhash64(*keys).isin(heavy), F.pmod(spread, F.lit(SALTS))).otherwise(0).cast("int"))
    places = F.when(F.xxhash64(*own).isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_place", F.explode(places))
    return left.join(right, met & (F.col("_salt") == F.col("_place")), "left").drop("_salt", "_place", *own)
