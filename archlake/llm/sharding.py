"""Sharding by jump consistent hashing, in SQL expressions only.

A key and a shard count decide the shard; nothing else is kept. One more shard takes a 1/(n+1) share of the keys
into itself and moves no other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier of its 64-bit congruential generator, in 32-bit halves.
_HIGH, _LOW = divmod(2862933555777941757, 1 << 32)

#: Jumps that are laid out in one expression. A key makes about ln(shards) jumps; the rare rest goes on in a loop.
UNROLLED = 24

#: Sub-groups of a shard in which slots are dealt in parallel (a prime, so that patterned ids spread).
SLOT_GROUPS = 1009


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 on 32-bit halves; every product stays under 2**49, so nothing overflows."""
    a, b = _LOW & 0xFFFF, _LOW >> 16
    upper = low * F.lit(b)
    whole = low * F.lit(a) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(whole, 32) + F.shiftright(upper, 16)

    def low_product(x: Column, m: int) -> Column:
        return x * F.lit(m & 0xFFFF) + F.shiftleft((x * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)

    return _mask(carry + low_product(low, _HIGH) + low_product(high, _LOW)), _mask(whole)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards-1) of a bigint key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0))
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), _mask(key).alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["h"], s["l"])
        spread = F.shiftright(high, 1) + F.lit(1)
        # the quotient is at most 2**31 times the shard index, far below the limits of a long
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / spread.cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(high.alias("h"), low.alias("l"), s["j"].alias("b"), to.alias("j")))

    def run(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    done = run(state, min(shards, UNROLLED))
    if shards > UNROLLED:
        done = F.when(done["j"] >= shards, done).otherwise(run(done, shards - UNROLLED))
    return done["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard, its gapless place in the shard and the shard it would have with one shard more.

    Columns: key, size (UTF-8 bytes plus 1; a null text has no bytes), text_crc32 (a null text: 0), law ('key'), shard,
    slot, grown_shard. A null key is dealt as key 0; rows with the same key share a shard and have slots of their own,
    in the order of key, crc and size. Extra columns are left out; an empty table gives an empty result.

    Only the six small columns are shuffled, once; slots come from ranks in sub-groups plus the sub-groups' counts, so
    that no task holds a shard.
    """
    bare = docs.select(
        F.col(key).alias("_k"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("_crc"),
    )
    dealt = bare.select(
        "*",
        jump_shard(F.col("_k"), shards).alias("_shard"),
        jump_shard(F.col("_k"), shards + 1).alias("_grown"),
        F.pmod(F.coalesce(F.col("_k").cast("long"), F.lit(0)), F.lit(SLOT_GROUPS)).alias("_group"),
    )
    groups = dealt.groupBy("_shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = groups.selectExpr(
        "_shard as _s", "_group as _g", "coalesce(sum(_n) over (partition by _shard order by _group rows between unbounded preceding and 1 preceding), 0) as _before"
    )  # at most shards * SLOT_GROUPS rows
    ranked = dealt.selectExpr("*", "row_number() over (partition by _shard, _group order by _k, _crc, _size) - 1 as _rank")
    return ranked.join(before, (F.col("_shard") == F.col("_s")) & (F.col("_group") == F.col("_g"))).select(
        F.col("_k").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_rank")).cast("long").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )
