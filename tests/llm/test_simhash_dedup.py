import random

import numpy as np
import pytest

from alarmlens.llm.components import components
from alarmlens.llm.simhash_dedup import fingerprint, links, near_groups
from tests.llm.plain import components_of, linked, simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def near_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            text = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 200])))
        base.append(text)
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "ÀB É x")]


def test_fingerprint_equals_plain_version():
    for text in ["", "a", "A b", "a b c", "a b c\x0bd", "é É é É", "x " * 70000, *[t or "" for _, t in near_texts(3, 30)]]:
        assert fingerprint(text) == simhash(text)


@pytest.mark.parametrize("limit", [4096, 2])
def test_components_equal_all_pairs(spark, limit):
    rows = near_texts(5, 250)
    got = {r["doc_id"]: r for r in near_groups(rows_of(spark, rows), group_limit=limit).collect()}
    prints = {i: simhash(t) for i, t in rows}
    assert {i: r["component_id"] for i, r in got.items()} == linked(prints)
    assert all(got[i]["fingerprint"] == f"{p:016x}" for i, p in prints.items())


@pytest.mark.parametrize("limit", [4096, 8])
def test_links_connect_random_clusters(spark, limit):
    rng = np.random.default_rng(7)
    values = set()
    for center in rng.integers(0, 1 << 64, 12, dtype=np.uint64).tolist():
        for _ in range(40):
            value = center
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                value ^= 1 << bit
            values.add(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = components_of([(r["u"], r["v"]) for r in links(prints, limit).collect()], signed)
    pairs = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert got == components_of(pairs, signed)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (300, 299)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    edges.remove((200, 200))
    expected = components_of(edges, {n for e in edges for n in e})
    assert got == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nulls_repeats_and_no_rows(spark):
    got = near_groups(rows_of(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "zz")])).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == ["(4, 4)", "(4, 4)", "(None, 4)", "(None, None)"]
    assert near_groups(rows_of(spark, [])).count() == 0
