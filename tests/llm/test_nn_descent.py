import math
import random

import numpy as np
import pytest

from alarmlens.llm.nn_descent import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, q long"


def plain(rows, every=100, k=10):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for i, v in fine:
        if i % every == 0:
            near = sorted((math.dist(v, w), j) for j, w in fine if j != i)[:k]
            out[i] = [(r, j, d) for r, (d, j) in enumerate(near, 1)]
    return out


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(nearest_neighbours(frame, **more).collect()):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def check(spark, rows, **more):
    got, want = found(spark, rows, **more), plain(rows, more.get("every", 100))
    assert {q: [(r, j) for r, j, _ in x] for q, x in got.items()} == {q: [(r, j) for r, j, _ in x] for q, x in want.items() if x}
    for q, x in got.items():
        assert all(math.isclose(a[2], b[2], rel_tol=1e-12) for a, b in zip(x, want[q]))


def unit(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return [[float(np.float32(x)) for x in row] for row in v / np.linalg.norm(v, axis=1)[:, None]]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    check(spark, list(enumerate(unit(rng, 150, 8))), every=10)
    check(spark, list(enumerate(unit(rng, 7, 8))), every=2)
    check(spark, [(0, [1.0, 2.0])], every=1)
    check(spark, [], every=1)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(-30, 60)]  # many equal vectors and zeros
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(40, rows[70][1]), (40, rows[70][1]), (105, [1e-30, 0.0, 0.0]), (106, [1e18, 1e18, 0.0])]
    check(spark, rows, every=10)


def test_recall_against_brute_force(spark):
    """Random directions, the hardest case, and a third of the rows around one vector."""
    rng = np.random.default_rng(3)
    vectors = np.array(unit(rng, 4000, 24))
    vectors[::3] = vectors[0] + 0.02 * vectors[::3]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    got, want = found(spark, rows), plain(rows)
    assert got.keys() == want.keys()
    hits = [len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 10 * len(hits)
    assert all(len(x) == 10 for x in got.values())


@pytest.mark.parametrize("beam", [40])
def test_graph_is_needed_beyond_one_leaf(spark, beam):
    rng = np.random.default_rng(4)
    rows = list(enumerate(unit(rng, 1200, 6)))
    got, want = found(spark, rows, every=50, beam=beam, step=10, leaf=64), plain(rows, 50)
    hits = [len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.95 * 10 * len(hits)
