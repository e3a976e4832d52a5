"""Time-window assignment: anchored, burst-adaptive, session, tumbling, newest-N.

An anchored window opens at a message and takes every message up to ``width`` later
(inclusive); the next message after that opens the next window. The chain is
sequential by definition, so the work is cut in three ways:

* Time is laid out in blocks as wide as the window. Two messages of one block are
  closer than the width, so a block holds at most one anchor. One small row per
  (domain, block), built with map-side combining, is all that ordered per-domain
  passes ever see; its number grows with elapsed time, not with messages.
* A gap wider than the window always starts a new anchor. Short runs between gaps are
  packed into chunks of bounded size, and each chunk is solved on its own.
* A run too long for one chunk is split at block borders. Each part yields a step
  function "end of the last window before me -> end of my last window"; these are
  composed in a tree, which tells each part where it starts.
* A run with a block that has more messages than ``dense_rows`` is left to ``dense_windows``, where stamps stay rows in
  narrow slices of time and no task holds a block.

Messages find their window through their block and are never sorted or grouped.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.operators.dense_windows import SLICE_US, dense_anchors, dense_ends
from alarmlens.runtime import is_empty, materialize

# Limits and defaults of the windows.
MIN_WINDOW_SEC, MAX_WINDOW_SEC = 10, 600
DEFAULT_WINDOW_SEC = 30
DEFAULT_RING_SIZE = 100_000

CHUNK_ROWS = 125_000
DENSE_ROWS = 500_000
TREE_FANIN = 256
_US = 1_000_000
_NEVER = -(2**62)


@dataclass(frozen=True)
class Burst:
    """Widening rule: enough messages within ``window_sec`` at a poll widen the window once."""

    window_sec: float = 5.0
    threshold: int = 5
    factor: float = 2.0
    max_sec: float = 120.0

    def widened_us(self, width_us: int) -> int:
        if self.threshold <= 0 or self.window_sec <= 0:
            return width_us
        return max(width_us, int(min(width_us * self.factor, self.max_sec * _US)))


def check_window_sec(window_sec: float) -> None:
    if not MIN_WINDOW_SEC <= window_sec <= MAX_WINDOW_SEC:
        raise ValueError(f"window_sec must be within 10..600, got {window_sec}")


def _block(ts: Column, width_us: int) -> Column:
    us = F.unix_micros(ts)
    return F.floor((us - F.pmod(us, F.lit(width_us))) / F.lit(width_us)).cast("bigint")


def _block_table(messages: DataFrame, time_col: str, width_us: int) -> DataFrame:
    ts = F.col(time_col)
    return (
        messages.select("domain", _block(ts, width_us).alias("block"), F.unix_micros(ts).alias("us"))
        .groupBy("domain", "block")
        .agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    )


# --- chunk kernels: sorted arrays of one chunk, bounded by CHUNK_ROWS or one block ----


def _window_ends(us: np.ndarray, n: np.ndarray, width: int, burst: Burst | None) -> np.ndarray:
    """End of the window that each timestamp would open as an anchor."""
    ends = us + width
    if burst is None:
        return ends
    wide = burst.widened_us(width)
    if wide <= width:
        return ends
    step = int(burst.window_sec * _US)
    total = np.concatenate([[0], np.cumsum(n)])
    hit = np.zeros(len(us), dtype=bool)
    for offset in dict.fromkeys(min(k * step, width) for k in range(1, -(-width // step) + 1)):
        upto = total[np.searchsorted(us, us + offset, side="right")]
        since = total[np.searchsorted(us, np.maximum(us, us + offset - step), side="left")]
        hit |= upto - since >= burst.threshold
    return np.where(hit, us + wide, ends)


def _prepared(pdf: pd.DataFrame, width: int, burst: Burst | None):
    us = pdf["us"].to_numpy()
    order = np.argsort(us, kind="stable")  # only what is needed is copied, not the frame with its names
    us = us[order]
    ends = _window_ends(us, pdf["n"].to_numpy()[order], width, burst)
    own = ~pdf["ahead"].to_numpy()[order]
    return us[own], ends[own]


def _chunk_steps(pdf: pd.DataFrame, width: int, burst: Burst | None) -> pd.DataFrame:
    """Step function of one part: for start times below ``upper``, the end of its last window."""
    us, ends = _prepared(pdf, width, burst)
    size = len(us)
    following = np.searchsorted(us, ends, side="right")
    last = np.where(following < size, following, np.arange(size))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    reach = width if burst is None else burst.widened_us(width)
    entries = min(size, int(np.searchsorted(us, us[0] + reach, side="left")) + 1)
    steps = pd.DataFrame({"upper": us[:entries], "exit": ends[last[:entries]]})
    return _merge_steps(steps)


def _merge_steps(steps: pd.DataFrame) -> pd.DataFrame:
    same_as_next = steps["exit"].to_numpy()[:-1] == steps["exit"].to_numpy()[1:]
    return steps[np.append(~same_as_next, True)]


def _apply_steps(start: np.ndarray, upper: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(upper, start, side="right")
    inside = at < len(upper)
    return np.where(inside, exit_[np.minimum(at, len(upper) - 1)], start)


def _chunk_anchors(pdf: pd.DataFrame, width: int, burst: Burst | None) -> pd.DataFrame:
    us, ends = _prepared(pdf, width, burst)
    following = np.searchsorted(us, ends, side="right")
    anchors = []
    at = int(np.searchsorted(us, pdf["start"].iloc[0], side="right"))
    while at < len(us):
        anchors.append(at)
        at = int(following[at])
    return pd.DataFrame({"anchor": us[anchors], "until": ends[anchors]})


def _parts(pdf: pd.DataFrame):
    for part, steps in pdf.sort_values(["part", "upper"]).groupby("part", sort=True):
        yield part, steps["upper"].to_numpy(), steps["exit"].to_numpy()


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step function of several consecutive parts together."""
    uppers, exits = np.empty(0, dtype="int64"), np.empty(0, dtype="int64")
    for _, upper, exit_ in _parts(pdf):
        if len(exits):
            exits = _apply_steps(exits, upper, exit_)
        fresh = upper > (uppers[-1] if len(uppers) else _NEVER)
        uppers = np.concatenate([uppers, upper[fresh]])
        exits = np.concatenate([exits, exit_[fresh]])
    return _merge_steps(pd.DataFrame({"upper": uppers, "exit": exits}))


def _walk(pdf: pd.DataFrame, start: int) -> pd.DataFrame:
    """Start time of every part, given the start time of the first."""
    parts, starts = [], []
    for part, upper, exit_ in _parts(pdf):
        parts.append(part)
        starts.append(start)
        start = int(_apply_steps(np.array([start]), upper, exit_)[0])
    return pd.DataFrame({"part": parts, "start": starts})


def _part_starts(steps: DataFrame, fanin: int) -> DataFrame:
    """Start time per (domain, run, part), by composing step functions in a tree."""
    keys = ["domain", "run"]
    out = "domain string, run bigint, part bigint, start bigint"

    def keyed(key, frame):
        frame.insert(0, "domain", key[0])
        frame.insert(1, "run", key[1])
        return frame

    top = steps.agg(F.max("part").alias("p")).first().p
    if top < fanin:
        return steps.groupBy(*keys).applyInPandas(lambda key, pdf: keyed(key, _walk(pdf, _NEVER)), out)

    def composed(key, pdf):
        frame = keyed(key, _compose(pdf))
        frame["part"] = key[2]
        return frame[["domain", "run", "part", "upper", "exit"]]

    grouped = steps.withColumn("parent", F.floor(F.col("part") / fanin))
    coarse = materialize(
        grouped.groupBy(*keys, "parent").applyInPandas(
            composed, "domain string, run bigint, part bigint, upper bigint, exit bigint"
        ),
        "steps",
    )
    parents = _part_starts(coarse, fanin).select(*keys, F.col("part").alias("parent"), "start")
    return (
        grouped.join(parents, [*keys, "parent"])
        .groupBy(*keys, "parent")
        .applyInPandas(lambda key, pdf: keyed(key, _walk(pdf, int(pdf["start"].iloc[0]))), out)
    )


# --- anchored windows -----------------------------------------------------------------


def _anchor_blocks(
    messages: DataFrame,
    time_col: str,
    width: int,
    burst: Burst | None,
    chunk_rows: int,
    fanin: int,
    dense_rows: int,
) -> DataFrame:
    """Per (domain, block): the anchor inside it, if any, and the one open before it."""
    reach = width if burst is None else burst.widened_us(width)
    in_order = W.partitionBy("domain").orderBy("block")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    table = materialize(_block_table(messages, time_col, width), "blocks")
    previous = F.lag("hi").over(in_order)
    gap = previous.isNull() | (F.col("lo") - previous > reach)
    runs = table.withColumn("run", F.sum(gap.cast("bigint")).over(in_order)).withColumn(
        "rows_before", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    whole = W.partitionBy("domain", "run")
    runs = runs.withColumn("run_rows", F.sum("n").over(whole)).withColumn(
        "run_begin", F.min("rows_before").over(whole)
    )
    runs = materialize(runs.withColumn("dense", F.max("n").over(whole) > dense_rows), "runs")
    dense = runs.filter("dense").select("domain", "block", "run")
    runs = runs.filter("not dense")
    long = F.col("run_rows") > chunk_rows
    # Short runs share a chunk named by a negative number, long runs keep theirs.
    chunks = materialize(
        runs.select(
            "domain",
            "block",
            F.when(long, F.col("run"))
            .otherwise(-1 - F.floor(F.col("run_begin") / chunk_rows))
            .alias("run"),
            F.when(long, F.floor((F.col("rows_before") - F.col("run_begin")) / chunk_rows))
            .otherwise(0)
            .alias("part"),
        ),
        "chunks",
    )

    ts = F.col(time_col)
    points = (
        messages.select("domain", _block(ts, width).alias("block"), F.unix_micros(ts).alias("us"))
        .groupBy("domain", "block", "us")
        .agg(F.count("*").alias("n"))
    )
    placed = chunks.withColumn("ahead", F.lit(False))
    if burst is not None:
        # The first block of a part is also shown to the part before it, whose last
        # windows may have to count messages beyond the border.
        behind = F.lag(F.struct("block", "run", "part")).over(in_order)
        borders = chunks.withColumn("b", behind).filter(
            (F.col("b.block") == F.col("block") - 1)
            & ((F.col("b.part") != F.col("part")) | (F.col("b.run") != F.col("run")))
        )
        placed = placed.unionByName(
            borders.select("domain", "block", "b.run", "b.part", F.lit(True).alias("ahead"))
        )

    long_runs = chunks.filter("part > 0").select("domain", "run").distinct()
    starts = None
    if not is_empty(long_runs):
        split = placed.join(long_runs, ["domain", "run"], "left_semi")

        def steps_of(key, pdf):
            frame = _chunk_steps(pdf, width, burst)
            frame.insert(0, "domain", key[0])
            frame.insert(1, "run", key[1])
            frame.insert(2, "part", key[2])
            return frame

        steps = materialize(
            points.join(split, ["domain", "block"])
            .drop("block")
            .groupBy("domain", "run", "part")
            .applyInPandas(
                steps_of, "domain string, run bigint, part bigint, upper bigint, exit bigint"
            ),
            "steps",
        )
        starts = materialize(_part_starts(steps, fanin), "starts")

    if starts is None:
        placed = placed.withColumn("start", F.lit(_NEVER))
    else:
        placed = placed.join(starts, ["domain", "run", "part"], "left").withColumn(
            "start", F.coalesce("start", F.lit(_NEVER))
        )

    def anchors_of(key, pdf):
        frame = _chunk_anchors(pdf, width, burst)
        frame.insert(0, "domain", key[0])
        return frame

    anchors = (
        points.join(placed, ["domain", "block"])
        .drop("block")
        .groupBy("domain", "run", "part")
        .applyInPandas(anchors_of, "domain string, anchor bigint, until bigint")
        .select(
            "domain",
            F.floor((F.col("anchor") - F.pmod("anchor", F.lit(width))) / width).alias("block"),
            F.struct("anchor", "until").alias("here"),
        )
    )
    if not is_empty(dense):
        crowded = materialize(points.join(dense, ["domain", "block"]), "dense_points")
        found = dense_anchors(dense_ends(crowded, width, burst), dense)
        block = F.floor((F.col("anchor") - F.pmod("anchor", F.lit(width))) / width).alias("block")
        anchors = anchors.unionByName(found.select("domain", block, F.struct("anchor", "until").alias("here")))
    return (
        table.select("domain", "block")
        .join(anchors, ["domain", "block"], "left")
        .withColumn("open", F.last("here", ignorenulls=True).over(before))
    )


def anchored_windows(
    messages: DataFrame,
    window_sec: float = DEFAULT_WINDOW_SEC,
    *,
    time_col: str = "received_at",
    burst: Burst | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fanin: int = TREE_FANIN,
    dense_rows: int = DENSE_ROWS,
) -> DataFrame:
    """Attach ``window_start`` and ``window_end`` of the anchored window of each message.

    With ``burst`` the window of an anchor is widened once when a poll sees enough
    recent messages. Groups hold the stamps of about ``chunk_rows`` messages; runs with more than ``dense_rows`` in one
    block are solved slice by slice. Rows without a time in ``time_col`` are left out. ``messages`` is
    read more than once: store it first when it is costly to compute.
    """
    check_window_sec(window_sec)
    width = int(window_sec * _US)
    timed = messages.filter(F.col(time_col).isNotNull())
    table = materialize(_anchor_blocks(timed, time_col, width, burst, chunk_rows, fanin, dense_rows), "anchors")
    in_here = F.unix_micros(time_col) >= F.col("here.anchor")
    window = F.when(in_here, F.col("here")).otherwise(F.col("open"))
    return (
        timed.withColumn("block", _block(F.col(time_col), width))
        .join(table, ["domain", "block"])
        .withColumn("window_start", F.timestamp_micros(window["anchor"]))
        .withColumn("window_end", F.timestamp_micros(window["until"]))
        .drop("block", "here", "open")
    )


def session_windows(
    messages: DataFrame, gap_sec: float = DEFAULT_WINDOW_SEC, *, time_col: str = "received_at"
) -> DataFrame:
    """Attach the idle-gap session of each message; a pause of exactly the gap still joins.

    Sessions never break inside a block as wide as the gap, so they are found from the
    per-block table alone. ``window_end`` is the last message plus the gap.
    """
    width = int(gap_sec * _US)
    timed = messages.filter(F.col(time_col).isNotNull())
    in_order = W.partitionBy("domain").orderBy("block")
    previous = F.lag("hi").over(in_order)
    opens = previous.isNull() | (F.col("lo") - previous > width)
    blocks = _block_table(timed, time_col, width).withColumn(
        "session", F.sum(opens.cast("bigint")).over(in_order)
    )
    whole = W.partitionBy("domain", "session")
    table = blocks.select(
        "domain",
        "block",
        F.timestamp_micros(F.min("lo").over(whole)).alias("window_start"),
        F.timestamp_micros(F.max("hi").over(whole) + width).alias("window_end"),
    )
    return (
        timed.withColumn("block", _block(F.col(time_col), width))
        .join(table, ["domain", "block"])
        .drop("block")
    )


def tumbling_windows(
    messages: DataFrame, window_sec: float = 10, *, time_col: str = "received_at"
) -> DataFrame:
    """Attach fixed, aligned windows."""
    span = F.window(time_col, f"{int(window_sec * 1000)} milliseconds")
    return (
        messages.withColumn("w", span)
        .withColumn("window_start", F.col("w.start"))
        .withColumn("window_end", F.col("w.end"))
        .drop("w")
    )


def payload_windows(messages: DataFrame) -> DataFrame:
    """Each payload (its domain) is one window."""
    return messages.withColumn("window_start", F.col("received_at")).withColumn(
        "window_end", F.col("received_at")
    )


def newest_per_window(
    messages: DataFrame, max_size: int = DEFAULT_RING_SIZE, *, time_col: str = "received_at", overflow: bool = False
) -> DataFrame:
    """Overflow policy of the live buffer: keep the newest ``max_size`` rows of a window, or with ``overflow`` the others.

    Counts per slice of time tell which slice is cut; only its rows are ranked, so a hot window is neither sorted nor held by one
    task. ``messages`` is read twice.
    """
    keys = ["domain", "window_start"]
    sliced = messages.withColumn("_slice", F.floor(F.unix_micros(time_col) / F.lit(SLICE_US)))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    newer = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    room = F.lit(max_size) - F.coalesce(F.sum("_n").over(newer), F.lit(0))
    marked = sliced.join(counts.withColumn("_room", room), [*keys, "_slice"])
    whole = marked.filter(F.col("_room") <= 0 if overflow else F.col("_n") <= F.col("_room"))
    newest = W.partitionBy(*keys).orderBy(F.desc(time_col), F.desc("seq"))
    cut = marked.filter((F.col("_room") > 0) & (F.col("_n") > F.col("_room"))).withColumn("_rn", F.row_number().over(newest))
    kept = cut.filter(F.col("_rn") > F.col("_room") if overflow else F.col("_rn") <= F.col("_room")).drop("_rn")
    return whole.unionByName(kept).drop("_slice", "_n", "_room")


def burst_detected(messages: DataFrame, as_of: Column, burst: Burst = Burst()) -> DataFrame:
    """Per domain: did enough messages arrive within the burst window before ``as_of``?"""
    if burst.threshold <= 0 or burst.window_sec <= 0:
        return messages.select("domain").distinct().select("domain", F.lit(False).alias("burst"))
    cutoff = as_of - F.make_dt_interval(secs=F.lit(burst.window_sec))
    recent = F.sum((F.col("received_at") >= cutoff).cast("bigint"))
    return messages.groupBy("domain").agg((recent >= burst.threshold).alias("burst"))
