import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alarmlens.llm import exact_dedup
from alarmlens.llm.exact_dedup import build_directory, build_index, exact_groups


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_odd_rows(docs_of, odd_rows):
    got = [tuple(r) for r in exact_groups(docs_of(odd_rows)).collect()]
    assert sorted(map(str, got)) == plain(odd_rows)


@pytest.mark.parametrize("capacity", [1, 20_000])
def test_many_copies_and_small_buckets(docs_of, capacity):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + [f"t{k}" for k in range(12)])) for i in range(200)]
    got = [tuple(r) for r in exact_groups(docs_of(rows).repartition(5), capacity=capacity).collect()]
    assert sorted(map(str, got)) == plain(rows)


def test_empty_table(docs_of):
    assert exact_groups(docs_of([])).collect() == []


def test_directory_splits_only_overfull_buckets(spark):
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    directory, depth = build_directory(spark.createDataFrame([(k,) for k in keys], "h long"), 20)
    slots = {r["slot"]: r for r in directory.collect()}
    filled = defaultdict(int)
    for k in keys:
        filled[slots[(k % (1 << 64)) >> (64 - depth)]["bucket"]] += 1
    assert max(filled.values()) <= 20
    assert all(r["bucket"] >> (depth - r["depth"]) == s >> (depth - r["depth"]) for s, r in slots.items())


def test_entries_hold_each_text_once(docs_of, odd_rows):
    entries = build_index(docs_of(odd_rows)).entries.collect()
    assert len(entries) == len({t or "" for _, t in odd_rows})
    assert sum(r["group_size"] for r in entries) == len(odd_rows)


def test_entries_lie_in_the_bucket_of_their_slot(docs_of):
    rows = [(i, f"text {i % 60}") for i in range(90)]
    index = build_index(docs_of(rows), capacity=5)
    slots = {r["slot"]: r["bucket"] for r in index.directory.collect()}
    entries = index.entries.collect()
    assert index.global_depth >= 3 and len({r["bucket"] for r in entries}) > 8
    assert all(r["bucket"] == slots[(r["h"] % (1 << 64)) >> (64 - index.global_depth)] for r in entries)
    assert sum(r["key_rows"] == 2 for r in entries) == 30


def test_rows_come_from_the_directory(docs_of, monkeypatch):
    """A directory that lacks a bucket loses the rows of that bucket, with copies or without."""
    rows = [(i, f"text {i % 60}") for i in range(90)]
    right = exact_dedup.build_directory

    def without_first(keys, capacity):
        directory, depth = right(keys, capacity)
        return directory.filter("bucket > 0"), depth

    index = build_index(docs_of(rows), capacity=5)
    missing = {r["h"]: r["key_rows"] for r in index.entries.filter("bucket = 0").collect()}
    monkeypatch.setattr(exact_dedup, "build_directory", without_first)
    assert missing and exact_groups(docs_of(rows), capacity=5).count() == 90 - sum(missing.values())


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_colliding_texts_and_no_broadcast(spark, docs_of, odd_rows, monkeypatch, limit):
    """Keys of two bits: nearly all texts collide, and chains decide. The same with broadcasts off."""
    few = lambda col: F.shiftleft(F.pmod(F.crc32(F.col(col).cast("binary")), F.lit(4)), 62)
    monkeypatch.setattr(exact_dedup, "key_of", few)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = odd_rows + [(1000 + i, f"text {i % 25}") for i in range(60)]
        got = [tuple(r) for r in exact_groups(docs_of(rows).repartition(4), capacity=2).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(str, got)) == plain(rows)


def test_colliding_keys_are_chained_by_their_bytes(monkeypatch):
    """Two texts with one key: each has its own chain link, and copies find the right one."""

    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr(exact_dedup.TaskContext, "get", lambda: Context())
    columns = [pa.array([5, 5, 5, 5, 6], pa.int64()), pa.array(["a", "b", "a", "b", "a"])]
    (out,) = exact_dedup._chain([pa.RecordBatch.from_arrays(columns, names=["h", "text"])])
    heads, links = out.column(2).to_pylist(), out.column(6).to_pylist()
    assert heads == [0, 1, 0, 1, 4] and links == [0, 1, 0, 1, 0]
