import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.operators import similar


def _frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, embedding array<double>")


def _plain(q, c, k, first_q=0):
    out = []
    for i, v in enumerate(q):
        near = sorted((float(((v - w) ** 2).sum()), j) for j, w in enumerate(c) if j != first_q + i)[:k]
        out += [(first_q + i, r, j) for r, (_, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_nearest_against_all_pairs(spark, spread):
    rng = np.random.default_rng(int(spread))
    corpus = rng.normal(size=(8, 6))[rng.integers(0, 8, 240)] * 10 + rng.normal(size=(240, 6)) * spread
    frame = _frame(spark, corpus)
    got = similar.nearest(frame, frame, 4, block_rows=16, pivots=12)
    assert sorted((r.query_id, r["rank"], r.neighbor_id) for r in got.collect()) == _plain(corpus, corpus, 4)


def test_far_cells_do_not_meet(spark, monkeypatch):
    """Eight clusters far from one another: each meets itself alone, so an eighth of the block pairs is multiplied."""
    rng = np.random.default_rng(2)
    corpus = np.repeat(np.eye(8) * 100, 30, axis=0) + rng.normal(size=(240, 8))
    pairs = []
    plan = similar.cell_pairs
    monkeypatch.setattr(similar, "cell_pairs", lambda *a: pairs.extend(plan(*a)) or pairs)
    frame = _frame(spark, corpus)
    got = similar.nearest(frame, frame, 3, pivots=8)
    assert sorted((r.query_id, r["rank"], r.neighbor_id) for r in got.collect()) == _plain(corpus, corpus, 3)
    assert len(pairs) == 8


def test_few_rows_and_none(spark):
    frame = _frame(spark, np.eye(3))
    assert similar.nearest(frame, frame, 5).count() == 6
    assert similar.nearest(frame.filter(F.lit(False)), frame, 5).count() == 0
    assert similar.nearest(frame, frame.filter(F.lit(False)), 5).count() == 0
    same = _frame(spark, np.ones((5, 2)))
    assert similar.nearest(same, same, 2).count() == 10


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """40,000 rows of 20 vectors: no more than k + 1 of each vector meet the classes, whatever the number of copies."""
    met = []
    plan = similar.cell_pairs
    monkeypatch.setattr(similar, "cell_pairs", lambda q, c, *a: met.append((q.count(), c.count())) or plan(q, c, *a))
    frame = spark.range(40_000).select("id", F.array((F.col("id") % 20).cast("double"), F.lit(0.0)).alias("embedding"))
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in similar.nearest(frame, frame, 3).filter("query_id in (5, 25, 85, 39985)").collect()}
    for q, near in {5: [25, 45, 65], 25: [5, 45, 65], 85: [5, 25, 45], 39985: [5, 25, 45]}.items():
        assert [got[q, r] for r in (1, 2, 3)] == near
    assert met == [(20, 80)]


def test_ids_that_repeat_leave_themselves_out(spark):
    """Id 1 has three vectors, id 2 one vector twice: an id is never its own answer, copies count one by one."""
    rows = [(1, [0.0]), (1, [1.0]), (1, [2.0]), (2, [4.0]), (2, [4.0]), (3, [7.0]), (4, [0.0])]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = {}
    for r in similar.nearest(frame, frame, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    assert got == {1: [4, 4], 2: [1, 1], 3: [2, 2], 4: [1, 1]}


def test_documents_of_equal_lists(spark):
    from alarmlens.plans.reports import similar_documents

    rows = [(f"i{i}", [float(i % 2)], f"doc {i}") for i in range(8)]
    corpus = spark.createDataFrame(rows, "incident_id string, embedding array<double>, document string")
    got = {r.incident_id: r.similar_docs for r in similar_documents(corpus.drop("document"), corpus, 2).collect()}
    assert got["i0"] == ["doc 2", "doc 4"] and got["i7"] == ["doc 1", "doc 3"] and got["i5"] == got["i7"] and len(got) == 8
