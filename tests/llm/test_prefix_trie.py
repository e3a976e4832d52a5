import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from alarmlens.llm.prefix_trie import MinimalPerfectHash, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, hi string, h string"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(original.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(not children[q] for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own) if rebuilt[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, **bounds):
    frame = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie(frame, **bounds).collect()]
    assert sorted(map(str, got)) == plain(rows)


def random_rows(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, convs):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 2, 5, 9, 12, 20])):
            rows.append((c, rng.choice([t, t, None]) if seed == 3 else t, rng.choice(["user", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("bounds", [{}, {"shard_rows": 12}, {"shard_rows": 12, "crown_nodes": 0}])
def test_random_conversations(spark, seed, bounds):
    check(spark, random_rows(seed, 60, ["a", "é", None, ""] if seed < 3 else ["a"]), **bounds)


def test_odd_rows(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(3, None, None, None)])
    long = "y" * 1_000_000
    rows = [(0, 0, "user", long), (0, 1, "user", long), (5, 0, "user", long), (None, 0, "user", long), (7, 0, "user", "a"), (7, 0, "user", "a")]
    check(spark, rows)


def test_long_conversation_and_hot_first_turn(spark):
    rows = [(10, t, "user", f"t{t % 7}") for t in range(1500)] + [(15, t, "user", f"t{t % 7}") for t in range(1500)]
    rows += [(c, 0, "user", "hello") for c in range(20, 320)] + [(c, 1, "user", f"w{c % 3}") for c in range(20, 320)]
    frame = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)
    whole = sorted(map(str, prefix_trie(frame).collect()))
    assert whole == sorted(map(str, prefix_trie(frame, shard_rows=100).collect()))
    assert len(whole) > 1500


def test_slots_are_minimal_and_checked():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(1 << 62), 1 << 62, (2, 50_000))
    table = MinimalPerfectHash(hi, lo)
    assert sorted(table.slots(hi, lo)) == list(range(50_000))
    assert (table.slots(lo, hi) == -1).all()
    with pytest.raises(ValueError):
        MinimalPerfectHash(np.array([1, 1]), np.array([2, 2]))
