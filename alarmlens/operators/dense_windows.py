"""Anchored windows of runs in which one block alone is too large for a task.

Every distinct time stamp is a step: a window that ended before it, and not before the stamp ahead of it, is followed by the window
that the stamp opens. The steps of a block are its step function; they stay rows, keyed by narrow slices of time, which
hold as many stamps as they have microseconds at most. Functions of neighbouring blocks are composed pairwise, all pairs of a level in
one join-free pass over slices (union, then the next step in time), so a level costs one shuffle of the steps that are left, and equal
ends in a row collapse. Going down again, each part learns where it starts by looking up one slice of its left neighbour.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.runtime import materialize

SLICE_US = 1 << 16
_NEVER = -(2**62)
_RUN = ["domain", "run"]
_PART = [*_RUN, "part"]


def _slice(at: str | Column) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(SLICE_US)).cast("bigint")


def _next_step(asked: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, x, ...) with ``found``: the step (upper, exit) of its keys with the smallest upper above x, or null.

    Inside a slice steps and questions are put in one order; what a slice cannot answer comes from the first step
    of the next slice that has any. No ordered group is larger than a slice, or than the slices of a part.
    """
    kept = [c for c in asked.columns if c not in keys]
    step = F.struct("upper", "exit")
    rows = asked.select(*keys, _slice("x").alias("slice"), F.col("x").alias("at"), F.struct(*kept).alias("own"), F.lit(None).cast("struct<upper:bigint,exit:bigint>").alias("step"))
    offered = steps.select(*keys, _slice("upper").alias("slice"), F.col("upper").alias("at"), step.alias("step"))
    both = rows.unionByName(offered, allowMissingColumns=True)
    # Latest first; at one moment a question stands before the step, which is not above it.
    backwards = W.partitionBy(*keys, "slice").orderBy(F.desc("at"), F.col("own").isNull()).rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("near", F.last("step", ignorenulls=True).over(backwards)).filter("own is not null")
    slices = both.groupBy(*keys, "slice").agg(F.min("step").alias("first"))
    onward = W.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    later = slices.select(*keys, "slice", F.last("first", ignorenulls=True).over(onward).alias("far"))
    return inside.join(later, [*keys, "slice"]).select(*keys, "own.*", F.coalesce("near", "far").alias("found"))


def _composed(steps: DataFrame) -> DataFrame:
    """Step functions of pairs of parts, numbered by half."""
    half = F.shiftright("part", 1).alias("part")
    left, right = (steps.filter(F.col("part") % 2 == side).select(*_RUN, half, "upper", "exit") for side in (0, 1))
    through = _next_step(left.select(*_PART, "upper", F.col("exit").alias("x")), right, _PART)
    through = through.select(*_PART, "upper", F.coalesce("found.exit", "x").alias("exit"))
    last = left.groupBy(*_PART).agg(F.max("upper").alias("last"))
    beyond = right.join(last, _PART, "left").filter(F.col("upper") > F.coalesce("last", F.lit(_NEVER)))
    every = through.unionByName(beyond.select(*_PART, "upper", "exit")).withColumn("slice", _slice("upper"))
    following = F.lead("exit").over(W.partitionBy(*_PART, "slice").orderBy("upper"))  # of equal ends in a row the last step says all
    every = every.withColumn("following", following).filter(F.col("following").isNull() | (F.col("following") != F.col("exit")))
    return every.select(*_PART, "upper", "exit")


def dense_anchors(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(domain, anchor, until)`` of the runs in ``points`` (domain, run, block, us, until), distinct stamps of the
    blocks in ``blocks`` (domain, run, block). ``until`` is the end of the window that a stamp would open."""
    place = F.row_number().over(W.partitionBy(*_RUN).orderBy("block")) - 1
    parts = materialize(blocks.select(*_RUN, "block", place.cast("bigint").alias("part")), "dense_blocks")
    steps = points.join(parts, [*_RUN, "block"]).select(*_PART, F.col("us").alias("upper"), F.col("until").alias("exit"))
    levels = [materialize(steps, "dense_steps")]
    most = parts.agg(F.max("part")).first()[0] or 0
    while most >> (len(levels) - 1):
        levels.append(materialize(_composed(levels[-1]), "dense_steps"))
    starts = parts.select(*_RUN).distinct().select(*_RUN, F.lit(0).cast("bigint").alias("part"), F.lit(_NEVER).alias("x"))
    for depth in range(len(levels) - 2, -1, -1):
        own = parts.select(*_RUN, F.shiftright("part", depth).alias("part")).distinct()
        given = own.withColumn("up", F.shiftright("part", 1)).join(starts.withColumnRenamed("part", "up"), [*_RUN, "up"]).drop("up")
        right = given.filter("part % 2 = 1").select(*_RUN, (F.col("part") - 1).alias("part"), "x")
        moved = _next_step(right, levels[depth], _PART).select(*_RUN, (F.col("part") + 1).alias("part"), F.coalesce("found.exit", "x").alias("x"))
        starts = materialize(given.filter("part % 2 = 0").select(*_PART, "x").unionByName(moved), "dense_starts")
    opened = _next_step(starts, levels[0], _PART).filter("found is not null")
    return opened.select("domain", F.col("found.upper").alias("anchor"), F.col("found.exit").alias("until"))


def _counted(asked: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """``asked`` (domain, run, x, ...) with ``upto``: messages of its run at or before x.

    Three sums: of earlier blocks, of earlier slices of the block, and inside the slice.
    """
    kept = [c for c in asked.columns if c not in _RUN]
    block = F.floor(F.col("at") / F.lit(width)).cast("bigint")
    rows = asked.select(*_RUN, F.col("x").alias("at"), F.struct(*kept).alias("own"), F.lit(0).cast("bigint").alias("n"))
    both = rows.unionByName(points.select(*_RUN, F.col("us").alias("at"), "n"), allowMissingColumns=True)
    both = both.withColumns({"b": block, "slice": _slice("at")})
    forwards = W.partitionBy(*_RUN, "b", "slice").orderBy("at", F.col("own").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("here", F.sum("n").over(forwards)).filter("own is not null")
    slices = both.groupBy(*_RUN, "b", "slice").agg(F.sum("n").alias("n"))
    blocks = slices.groupBy(*_RUN, "b").agg(F.sum("n").alias("n"))
    earlier = lambda *keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*_RUN, "b", "slice", F.coalesce(F.sum("n").over(earlier(*_RUN, "b", order="slice")), F.lit(0)).alias("n_slices"))
    blocks = blocks.select(*_RUN, "b", F.coalesce(F.sum("n").over(earlier(*_RUN, order="b")), F.lit(0)).alias("n_blocks"))
    summed = inside.join(slices, [*_RUN, "b", "slice"]).join(blocks, [*_RUN, "b"])
    return summed.select(*_RUN, "own.*", (F.col("here") + F.col("n_slices") + F.col("n_blocks")).alias("upto"))


def dense_ends(points: DataFrame, width: int, burst) -> DataFrame:
    """``points`` (domain, run, block, us, n) with ``until``, the end of the window that each stamp would open.

    The first poll of most stamps already sees enough messages; only the others are counted poll by poll.
    """
    wide = burst.widened_us(width) if burst is not None else width
    if wide <= width:
        return points.withColumn("until", F.col("us") + width)
    step = int(burst.window_sec * 1_000_000)
    offsets = list(dict.fromkeys(min(k * step, width) for k in range(1, -(-width // step) + 1)))

    def hits(stamps: DataFrame, polls: list[int]) -> DataFrame:
        """Stamps of which some poll sees enough."""
        polled = stamps.select(*_RUN, "us", F.explode(F.array(*map(F.lit, polls))).alias("off"))
        since = F.greatest("us", F.col("us") + F.col("off") - step)
        ends = polled.select(*_RUN, "us", "off", F.lit(1).alias("sign"), (F.col("us") + F.col("off")).alias("x"))
        begins = polled.select(*_RUN, "us", "off", F.lit(-1).alias("sign"), (since - 1).alias("x"))
        counted = _counted(ends.unionByName(begins), points, width).groupBy(*_RUN, "us", "off")
        seen = counted.agg(F.sum(F.col("sign") * F.col("upto")).alias("seen"))
        return seen.filter(F.col("seen") >= burst.threshold).select(*_RUN, "us").distinct()

    stamps = points.select(*_RUN, "us")
    met = materialize(hits(stamps, offsets[:1]), "burst_stamps")
    if len(offsets) > 1:
        met = met.unionByName(materialize(hits(stamps.join(met, [*_RUN, "us"], "left_anti"), offsets[1:]), "burst_stamps"))
    marked = points.join(met.withColumn("hit", F.lit(True)), [*_RUN, "us"], "left")
    return marked.withColumn("until", F.col("us") + F.when(F.col("hit"), wide).otherwise(width)).drop("hit")
