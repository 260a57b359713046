"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Documents are split by the first digit of their text (64 bytes), groups with more than one text by the next one, and so on until
a group is a single document or its texts have ended. What has ended in one group is equal, byte by byte: groups are joins on
the bytes themselves, no digest takes part. Digits grow sixteenfold, so that a text of any length has at most seven of them.

A level only reads the column of its own digit, and only rows of groups that are still open. The texts are moved once, to meet
the first digits that occur more than once; the digits of single documents aren't stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.llm.skew import attach
from archlake.llm.store import cut, drop

#: Where digits end, in bytes; the last digit goes on to the end of the text.
ENDS = (1 << 6, 1 << 10, 1 << 14, 1 << 18, 1 << 22, 1 << 26)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case; other letters stay."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _digit(norm: Column, level: int) -> Column:
    """The bytes of a level, null where the text has ended before."""
    start = ENDS[level - 1] if level else 0
    length = ENDS[level] - start if level < len(ENDS) else 1 << 30
    return F.when(F.octet_length(norm) > start, F.substring(norm, start + 1, length))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The values of keys that several rows have, with the number of these rows (n) and a number of the group (g_new), stored."""
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(several.withColumn("g_new", F.monotonically_increasing_id()))


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 of every row; texts are equal when they are after lower-casing A-Z.

    Of equal texts the row with the largest key stays. A null text counts as empty. A null key is smaller than every other;
    of rows with one key and equal texts one stays, so that each group has exactly one kept row. keep_id is null where all
    keys of a group are. Keys are of any type with an order; extra columns, under any name, are left out. An empty table
    gives no rows. text_sha256 is worked out for the result only.

    Large groups: a group's number comes from a pre-aggregated count, and its rows are dealt to many tasks when they meet it.
    """
    norm = lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit("")))
    plain = docs.select(F.col(key).alias("k"), norm.alias("t")).select("k", F.col("t").cast("binary").alias("t"))
    heads = plain.select("k", "t", _digit(F.col("t"), 0).alias("d0"), (F.octet_length("t") > ENDS[0]).alias("more"))
    first = _numbered(heads, ["d0", "more"])
    met = attach(heads.withColumn("sha", F.sha2("t", 256)), first, ["d0", "more"], "n", F.xxhash64("k"), grows=True)
    open_ = F.col("g_new").isNotNull() & F.col("more")
    later = [F.when(open_, _digit(F.col("t"), level)).alias(f"d{level}") for level in range(1, len(ENDS) + 1)]
    base = cut(met.select(F.monotonically_increasing_id().alias("rid"), "k", "sha", F.col("g_new").alias("g"), open_.alias("open"), *later))
    drop(first)

    level, live = 1, base.where("open").select("rid", "g", "d1", F.col("d2").isNotNull().alias("more"))
    ended: list[DataFrame] = []
    while not live.isEmpty():
        digits = ["g", f"d{level}", "more"]
        groups = _numbered(live, digits)
        split = cut(attach(live, groups, digits, "n", F.col("rid"), grows=True).where("g_new is not null").select("rid", F.col("g_new").alias("g"), "more"))
        drop(groups)
        ended.append(split.where("not more").select("rid", F.lit(level).alias("level"), "g"))
        level += 1
        if level > len(ENDS):
            break
        more = F.col(f"d{level + 1}").isNotNull() if level < len(ENDS) else F.lit(False)
        digit = base.where(F.col(f"d{level}").isNotNull()).select("rid", f"d{level}", more.alias("more"))
        live = split.where("more").select("rid", "g").hint("merge").join(digit, "rid")

    at_once = base.where("g is not null and not open").select("rid", F.lit(0).alias("level"), "g")
    members = reduce(DataFrame.unionByName, ended, at_once)
    rows = cut(base.select("rid", "k", "sha").join(members.hint("merge"), "rid", "left"))
    best = F.max(F.struct("k", (-F.col("rid")).alias("r")))  # a null key is the smallest
    groups = cut(rows.where("g is not null").groupBy("level", "g").agg(F.count(F.lit(1)).alias("n"), best.alias("best")))
    found = attach(rows, groups, ["level", "g"], "n", F.col("rid"), grows=True)
    drop(base)
    return found.select(
        F.col("k").alias(key),
        F.when(F.col("g").isNull(), F.col("k")).otherwise(F.col("best.k")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(-F.col("best.r") == F.col("rid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
