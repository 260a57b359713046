"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL expressions only.

Time is counted in slots, a slot holds one block of one source. Weights are whole numbers of slots in a period of P slots, the
sum of all weights. Block i (from 0) of a source of weight u is released at floor(i * P / u) and due by ceil((i + 1) * P / u);
among released blocks the one with the earliest deadline takes the slot. Every block then lies in its window, so that after any
number of slots, however many, each source has had its target share of blocks, less than one block off.

The windows repeat after P slots, so that one period is scheduled and block i of a source then finds its slot by division. Each
block has a number, by deadline, and the blocks up to any number take the same slots whatever comes after them: a slot is one of
theirs unless all of them that are released by then have had theirs, which running sums and their minima tell. Rounds narrow each
slot's block down so, a hexadecimal digit of its number each, in all slots at once; any number of sources goes the same way. Where
a source has no block left its slots fall out, and the others keep their shares among themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.llm.store import cut

#: Slots of a period, about, and slots for each source in it, at least on average: the finer of both is the resolution of weights.
RESOLUTION, SLOTS_PER_SOURCE = 4096, 16

#: Binary digits of a block's number that a round finds.
DIGIT = 4

#: Slots that a task goes through in a round, about, and blocks of a source that are listed at once.
STRETCH, LISTED = 1 << 16, 1 << 12


def whole_weights(weights: DataFrame, resolution: int | None = None) -> DataFrame:
    """source and weight as whole numbers that add up to about the resolution, each at least one.

    weights: source, weight (> 0 in any unit; others, nulls and non-finite ones take no part). The resolution is RESOLUTION, or
    SLOTS_PER_SOURCE slots for each source if that is more, so that any number of sources works.
    """
    able = weights.where((F.col("weight") > 0) & (F.col("weight").cast("double") < float("inf"))).select(F.struct("source").alias("s"), F.col("weight").cast("double").alias("weight"))
    summed = cut(able.groupBy("s").agg(F.sum("weight").alias("weight")))
    total, sources = summed.agg(F.sum("weight"), F.count(F.lit(1))).first()
    slots = float(resolution or max(RESOLUTION, SLOTS_PER_SOURCE * sources))
    share = F.col("weight") / F.lit(total or 1.0) * F.lit(slots)
    return summed.select("s.source", F.greatest(F.lit(1), F.round(share)).cast("long").alias("weight"))


def tempered_weights(docs: DataFrame, alpha: float = 0.5, source: str = "source", resolution: int | None = None) -> DataFrame:
    """source and weight: the number of rows to the power alpha, as whole_weights; null is a source of its own."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha)).alias("weight"))
    return whole_weights(sizes, resolution)


def _blocks(able: DataFrame, period: int, stretch: int | None) -> DataFrame:
    """s, units and release of each block of a period, with no: its number from 0 by deadline, ties to the heavier source, then by name."""
    order = [F.col("due"), F.desc("units"), F.col("s")]
    first = able.select("s", "units", F.explode(F.expr(f"sequence(0L, units - 1, {LISTED}L)")).alias("first"))
    each = first.select("s", "units", F.explode(F.expr(f"sequence(first, least(first + {LISTED}, units) - 1)")).alias("i"))
    timed = each.select("s", "units", F.expr(f"i * {period}L div units").alias("release"), F.expr(f"((i + 1) * {period}L + units - 1) div units").alias("due"))
    if not stretch:
        return cut(timed.coalesce(1).select("s", "units", "release", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long").alias("no")))
    ordered = cut(timed.orderBy(*order).select("s", "units", "release", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)  # as monotonically_increasing_id() numbers the rows of each part from 0
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    met = ordered.join(F.broadcast(before), part == F.col("part"))
    return cut(met.select("s", "units", "release", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("no")))


def _narrowed(slots: DataFrame, blocks: DataFrame, shift: int, stretch: int | None) -> DataFrame:
    """slots (slot and node, the digits of its block's number so far) with the next digit in node; shift: the bits that come after it.

    Of a node's slots, the blocks with a digit up to c leave those free at whose time all of them that are released have had
    one: where the sum of blocks less slots falls below all sums before. A digit is the number of c that leave the slot free.
    Nodes are cut into stretches of time, whose sums and minima are carried on; without `stretch` all is one stretch, and one task.
    """
    edges = range((1 << DIGIT) - 1)
    each = lambda form: [form.replace("#", str(c)) for c in edges]
    came = blocks.selectExpr(f"shiftright(no, {shift + DIGIT}) as node", "release as slot", f"pmod(shiftright(no, {shift}), {1 << DIGIT}) as digit", "0 as own")
    marks = came.unionByName(slots.selectExpr("node", "slot", "cast(null as bigint) as digit", "1 as own"))
    marks = marks if stretch else marks.coalesce(1)
    steps = marks.groupBy("node", "slot").agg(F.expr("max(own) as own"), *map(F.expr, each("count_if(digit <= #) - max(own) as d#")))
    steps = steps.selectExpr("*", f"slot div {stretch} as stretch" if stretch else "0L as stretch")
    time = "over (partition by node, stretch order by slot rows between unbounded preceding and"
    sums = steps.selectExpr("node", "stretch", "slot", "own", *each(f"sum(d#) {time} current row) as s#"))
    sums = sums.selectExpr("*", *each(f"min(s#) {time} 1 preceding) as m#"))
    free = "s# < least(0L, m#)"
    if stretch:
        sums = cut(sums)
        before = "over (partition by node order by stretch rows between unbounded preceding and 1 preceding)"
        ends = sums.groupBy("node", "stretch").agg(*map(F.expr, each("max_by(s#, slot) as t#") + each("min(s#) as l#")))
        ends = ends.selectExpr("node", "stretch", *each("l#"), *each(f"coalesce(sum(t#) {before}, 0L) as b#"))
        ends = ends.selectExpr("node", "stretch", *each("b#"), *each(f"min(b# + l#) {before} as f#"))
        sums, free = sums.join(ends, ["node", "stretch"]), "b# + s# < least(0L, f#, b# + m#)"
    digit = " + ".join(each(f"int({free})"))
    return sums.where("own = 1").selectExpr("slot", f"node * {1 << DIGIT} + {digit} as node")


def period_schedule(weights: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per source: source, units (its weight), period (the sum of all weights) and slots (its slots of a period, ascending).

    weights: source, weight (a whole number > 0, such as whole_weights gives; others take no part). A slot goes to the released
    block with the earliest deadline, whatever the number of sources. A period of more than `stretch` slots is gone through by
    many tasks, stretch by stretch; that changes no slot.
    """
    able = weights.where(F.col("weight") >= 1).select(F.struct("source").alias("s"), F.col("weight").cast("long").alias("units"))
    period = able.agg(F.sum("units")).first()[0]
    if period is None:
        return able.select("s.source", "units", F.col("units").alias("period"), F.array("units").alias("slots"))
    stretch = stretch if period > stretch else None
    blocks = _blocks(able, period, stretch)
    slots = weights.sparkSession.range(period).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("node"))
    for k in reversed(range(-(-max(1, (period - 1).bit_length()) // DIGIT))):
        slots = _narrowed(slots, blocks, k * DIGIT, stretch)
    taken = blocks.join(slots, F.col("no") == F.col("node")).groupBy("s", "units").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    return taken.select("s.source", "units", F.lit(period).cast("long").alias("period"), "slots")


def mix(
    docs: DataFrame, weights: DataFrame, block_rows: int = 16, key: str = "doc_id", source: str = "source", groups: int = 1009, prefix: str = ""
) -> DataFrame:
    """docs with block (of its source, from 0), row_in_block, release, deadline and slot; order by slot and row_in_block.

    weights: whole numbers, as for period_schedule. A source's rows are cut into blocks in the order of pmod(key, groups), then
    key. All rows stay, those of sources without a weight too: their slot is null and they come last. Sources may be null; extra
    columns stay, under any name: `prefix` goes before the five names given here, and if one of them is taken all the same, as many
    underscores as it needs. An empty table gives no rows. Slots are unique to a block; they have gaps where a source has run out.
    A slot lies from release on and before deadline.

    Ranks are made in groups of a source and shifted by the groups' counts, so that a source that holds most rows is many
    tasks. What is joined in is at most one row per source and group.
    """
    while any(prefix + name in docs.columns for name in ("block", "row_in_block", "release", "deadline", "slot")):
        prefix += "_"
    number = F.xxhash64(key) if dict(docs.dtypes)[key] == "string" else F.col(key).cast("long")
    content = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    dealt = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(key).alias("k"),
        F.struct(F.col(source).alias("source")).alias("s"),  # a struct is equal to itself with a null in it, too
        content.alias("h"),  # rows of one key, and those without one, keep their order when a task is run again
        F.pmod(F.coalesce(number, content), F.lit(groups)).alias("g"),
    )
    before = (
        dealt.groupBy("s", "g")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("s as s2", "g as g2", "coalesce(sum(n) over (partition by s order by g rows between unbounded preceding and 1 preceding), 0) as before")
    )
    schedule = cut(period_schedule(weights)).select(F.struct("source").alias("s3"), "units", "period", "slots")
    starts = before.join(schedule, F.col("s2") == F.col("s3"), "left").select("s2", "g2", "before", "units", "period", "slots")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("s", "g").orderBy("k", "h")) - 1).select("row", "s", "g", "rank")
    met = ranked.join(starts, (F.col("s") == F.col("s2")) & (F.col("g") == F.col("g2")))
    rank = (F.col("before") + F.col("rank")).cast("long")
    i, u, p = F.floor(rank / block_rows).cast("long"), F.col("units"), F.col("period")
    made = {
        "block": i,
        "row_in_block": F.pmod(rank, F.lit(block_rows)).cast("long"),
        "release": F.floor(i * p / u).cast("long"),
        "deadline": F.ceil((i + 1) * p / u).cast("long"),
        "slot": (F.floor(i / u) * p + F.get("slots", F.pmod(i, u).cast("int"))).cast("long"),
    }
    return met.select("row.*", *[v.alias(prefix + name) for name, v in made.items()])
