import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alarmlens.operators import windows
from alarmlens.operators.dense_windows import SLICE_US
from alarmlens.operators.windows import (
    Burst,
    anchored_windows,
    burst_detected,
    check_window_sec,
    newest_per_window,
    session_windows,
)
from tests.helpers import at


def model_windows(stamps, width, burst=None):
    """Anchor and end of the window of each time stamp (microseconds), one after another."""
    out, anchor, end = {}, None, None
    for t in sorted(stamps):
        if anchor is None or t > end:
            anchor, span = t, width
            if burst and burst.widened_us(width) > width:
                step, off = int(burst.window_sec * 1e6), 0
                while off < width:
                    off = min(off + step, width)
                    recent = [x for x in stamps if max(t, t + off - step) <= x <= t + off]
                    if len(recent) >= burst.threshold:
                        span = burst.widened_us(width)
                        break
            end = anchor + span
        out[t] = (anchor, end)
    return out


def _frame(spark, offsets, domain="d"):
    rows = [(domain, i, at(o)) for i, o in enumerate(offsets)]
    return spark.createDataFrame(rows, "domain string, seq bigint, received_at timestamp")


def test_anchored_example(spark):
    got = anchored_windows(_frame(spark, [0, 10, 30, 31, 70, 90, 101]), 30)
    anchors = [r.w for r in got.select("window_start").distinct().select(F.col("window_start").alias("w")).orderBy("w").collect()]
    assert anchors == [at(o).replace(tzinfo=None) for o in (0, 31, 70, 101)]


@pytest.mark.parametrize("chunk_rows,fanin", [(500_000, 256), (9, 3)])
def test_random_windows_match_the_model(spark, chunk_rows, fanin):
    """With tiny chunks every long run goes through several levels of composition."""
    rng = random.Random(4)
    rows, stamps = [], {}
    for d in ("even", "mixed", "dense"):
        t = 1_700_000_000_000_000
        stamps[d] = []
        for _ in range(150):
            pause = {"even": [1], "mixed": [0, 0.5, 3, 9, 10, 11, 25], "dense": [0.25, 0.5, 2]}[d]
            t += int(rng.choice(pause) * 1e6)
            stamps[d].append(t)
            rows.append((d, len(rows), t))
    frame = spark.createDataFrame(rows, "domain string, seq bigint, us bigint").withColumn(
        "received_at", F.timestamp_micros("us")
    )
    for burst in (None, Burst(3.0, 4, 2.5, 18)):
        got = anchored_windows(frame, 10, burst=burst, chunk_rows=chunk_rows, fanin=fanin)
        for r in got.select(
            "domain", "us", F.unix_micros("window_start").alias("a"), F.unix_micros("window_end").alias("e")
        ).collect():
            if "want" not in stamps or stamps["want"][0] is not burst:
                stamps["want"] = (burst, {d: model_windows(stamps[d], 10_000_000, burst) for d in ("even", "mixed", "dense")})
            assert (r.a, r.e) == stamps["want"][1][r.domain][r.us]
        assert got.count() == len(rows)


@pytest.mark.parametrize("burst", [None, Burst(3.0, 4, 2.5, 18), Burst(10.0, 6, 2.0, 30)])
def test_dense_runs_match_the_model(spark, burst):
    """Every run counts as dense, so stamps are solved slice by slice; lone stamps and pauses over several blocks included."""
    rng = random.Random(8)
    rows, stamps = [], {}
    for d in ("even", "mixed", "lone"):
        t, stamps[d] = 1_700_000_000_000_000, []
        for _ in range(90 if d != "lone" else 1):
            t += int(rng.choice({"even": [1], "mixed": [0, 0.03, 0.5, 3, 9, 10, 11, 25], "lone": [1]}[d]) * 1e6)
            stamps[d].append(t)
            rows.append((d, len(rows), t))
    frame = spark.createDataFrame(rows, "domain string, seq bigint, us bigint").withColumn("received_at", F.timestamp_micros("us"))
    got = anchored_windows(frame, 10, burst=burst, dense_rows=0)
    want = {d: model_windows(stamps[d], 10_000_000, burst) for d in stamps}
    found = got.select("domain", "us", F.unix_micros("window_start").alias("a"), F.unix_micros("window_end").alias("e")).collect()
    assert len(found) == len(rows)
    assert all((r.a, r.e) == want[r.domain][r.us] for r in found)


def test_block_of_a_million_stamps(spark, monkeypatch):
    """One block has a million distinct stamps; no Python group gets any of them, and no ordered group is larger than a slice."""
    from alarmlens.operators import windows

    largest = []
    monkeypatch.setattr(windows, "_chunk_anchors", lambda pdf, *_: largest.append(len(pdf)) or pdf.iloc[:0])
    us = F.lit(1_700_000_000_000_000) + F.col("id") * 11
    frame = spark.range(1_000_000).select(F.lit("d").alias("domain"), F.col("id").alias("seq"), F.timestamp_micros(us).alias("received_at"))
    got = anchored_windows(frame, 10, dense_rows=100_000).groupBy(F.unix_micros("window_start").alias("a")).count().orderBy("a").collect()
    inside = 10_000_000 // 11 + 1  # the end of a window belongs to it
    assert [(r.a - 1_700_000_000_000_000, r["count"]) for r in got] == [(0, inside), (inside * 11, 1_000_000 - inside)]
    slices = frame.groupBy(F.floor(F.unix_micros("received_at") / SLICE_US)).count().agg(F.max("count")).first()[0]
    assert slices <= SLICE_US and not largest


def test_session_example(spark):
    got = session_windows(_frame(spark, [0, 30, 61, 61.5]), 30).groupBy("window_start", "window_end").count()
    assert [(r.window_start, r.window_end, r["count"]) for r in got.orderBy("window_start").collect()] == [
        (at(0).replace(tzinfo=None), at(60).replace(tzinfo=None), 2),
        (at(61).replace(tzinfo=None), at(91.5).replace(tzinfo=None), 2),
    ]


def test_newest_rows_and_guard(spark):
    frame = _frame(spark, range(5)).withColumn("window_start", F.lit(at(0)))
    assert sorted(r.seq for r in newest_per_window(frame, 3).collect()) == [2, 3, 4]
    for bad in (9, 601):
        with pytest.raises(ValueError):
            check_window_sec(bad)
    check_window_sec(10)
    check_window_sec(600)


@pytest.mark.parametrize("size", [1, 7, 40, 200])
def test_newest_rows_of_crowded_windows(spark, size):
    """Rows of one slice, of one moment and of several windows; what is not kept is the overflow."""
    rng = random.Random(size)
    rows = [(rng.choice("ab"), i, at(rng.choice([0, 0, 0.01, 0.02, 1, 2.5])), at(0)) for i in range(150)]
    frame = spark.createDataFrame(rows, "domain string, seq bigint, received_at timestamp, window_start timestamp")
    want = set()
    for d in "ab":
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1]), reverse=True)
        want |= {r[1] for r in own[:size]}
    assert {r.seq for r in newest_per_window(frame, size).collect()} == want
    assert {r.seq for r in newest_per_window(frame, size, overflow=True).collect()} == {r[1] for r in rows} - want


def _burst_cases():
    """Random ages around the border of the span, the border itself, and rules that are switched off."""
    rng = random.Random(17)
    cases = [
        ([rng.choice([0, 0.25, 2.75, 3, 3.25, 40]) for _ in range(rng.randint(1, 8))], rng.randint(1, 6), rng.choice([2.75, 3, 3.125]))
        for _ in range(6)
    ]
    return cases + [([3], 1, 3), ([3.001], 1, 3), ([0.5] * 7, 7, 3), ([0.5] * 6, 7, 3), ([1, 2], 0, 3), ([0, 0], 2, 0)]


@pytest.mark.parametrize("ages,count,span", _burst_cases())
def test_burst(spark, ages, count, span):
    burst = Burst(span, count)
    expected = count > 0 and span > 0 and sum(a <= span for a in ages) >= count
    frame = _frame(spark, [100 - a for a in ages])
    assert burst_detected(frame, F.lit(at(100)), burst).first().burst is expected


def test_memory_of_a_full_chunk():
    """A full chunk is sorted without a copy of its frame and is small enough for several at once."""
    rng = np.random.default_rng(1)
    n = windows.CHUNK_ROWS
    frame = pd.DataFrame({"domain": ["default"] * n, "run": 1, "part": 1, "n": 1, "us": rng.permutation(n) * 72_000, "ahead": False, "start": 0})
    tracemalloc.start()
    us, ends = windows._prepared(frame, 600_000_000, Burst())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(us) == n and (np.diff(us) > 0).all() and (ends > us).all()
    assert peak < 16_000_000
