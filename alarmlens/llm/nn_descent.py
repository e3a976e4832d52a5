"""Approximate nearest neighbours over a graph built by NN-descent.

Every distinct vector is a node. The graph starts from small leaves of random half-space cuts and is then improved round by
round: each node gathers its neighbours and a bounded random choice of the nodes that point at it, compares them with one another
(neighbours of neighbours through that node), and offers each its closest companions; a node keeps the
best ``degree``. Queries walk greedily from their own node: each round the nearest unvisited nodes of a
query's beam are replaced by their neighbours, until the nearest ``beam`` nodes have all been visited.

Rounds are joins of narrow rows with vectors in half precision (one scale per vector); the ranking that is returned comes from
the original vectors in double precision. A node offers and receives at most ``degree`` neighbours and ``reverse`` pointers a round,
so a node that very many point at makes no hot group; equal vectors are one node, whatever their number.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.llm.tables import bounded_sample
from alarmlens.operators.ranking import first_per_group, global_row_number
from alarmlens.runtime import is_empty, materialize

DEGREE = 24
REVERSE = 24
OFFERS = 4
ROUNDS = 4
TREES = 4
LEAF = 256
BEAM = 320
STEP = 160
CUT_SAMPLE = 2_000
_OWNERS = 256  # nodes whose gathered vectors are multiplied in one call


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``, v of doubles: rows with an id, no null or non-finite component, not all zero, of the most frequent length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _halved(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-precision components and each vector's scale."""
    scale = np.abs(v).max(axis=1)
    return (v / scale[:, None]).astype(np.float16), scale


def _restored(cells: pa.Array, scale: np.ndarray) -> np.ndarray:
    """Vectors from equally long binary cells."""
    if not len(cells):
        return np.zeros((0, 0))
    cells = cells.cast(pa.large_binary()) if not pa.types.is_large_binary(cells.type) else cells
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    raw = np.frombuffer(cells.buffers()[2], np.float16, (offsets[-1] - offsets[0]) // 2, int(offsets[0]))
    return raw.reshape(len(cells), -1).astype(np.float64) * scale[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _halves(nodes: DataFrame, cuts: np.ndarray | None = None, limits: np.ndarray | None = None) -> DataFrame:
    """``(node, half, scale)`` and, with cuts, ``codes``: one leaf per tree."""
    trees = 0 if cuts is None else len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            half, scale = _halved(v)
            out = [batch.column(0), pa.array([h.tobytes() for h in half], pa.binary()), pa.array(scale)]
            codes = np.zeros((len(v), trees), np.int64)
            for t in range(trees):
                codes[:, t] = (v @ cuts[t].T > limits[t]) @ (1 << np.arange(cuts.shape[1]))
            out.append(pa.array(list(codes), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=["node", "half", "scale", "codes"])

    return nodes.select("node", "v").mapInArrow(run, "node long, half binary, scale double, codes array<long>")


def _closest(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """[groups, members, dim] -> the nearest ``most`` other members of each, and their squared distances, which depend on the two
    vectors alone and not on the group they meet in. Members with a NaN vector fill up a group."""
    square = (v * v).sum(axis=2)
    product = square[:, :, None] + square[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    product = np.where(np.isnan(product), np.inf, product)
    n = v.shape[1]
    product[:, np.arange(n), np.arange(n)] = np.inf
    place = np.argpartition(product, most - 1, axis=2)[:, :, :most] if most < n else np.argsort(product, axis=2)[:, :, : n - 1]
    found = np.take_along_axis(v[:, None], place.reshape(len(v), 1, -1, 1), 2).reshape(*place.shape, v.shape[2])
    return place, ((v[:, :, None] - found) ** 2).sum(axis=3)


def _pairs(u: list[np.ndarray], v: list[np.ndarray], d: list[np.ndarray]) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0) for x in (u, v, d)]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["u", "v", "d"])


def _leaf_pairs(leaves: DataFrame, most: int) -> DataFrame:
    """``(u, v, d)`` inside leaves; rows come ordered by leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            if len(ids) < 2:
                return _pairs([], [], [])
            place, d = _closest(vectors[None], min(most, len(ids) - 1))
            return _pairs([np.repeat(ids, place.shape[2])], [ids[place[0]].ravel()], [d[0].ravel()])

        key, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = np.array([batch.column(i).to_numpy() for i in range(2)]).T
            node, v = batch.column(2).to_numpy(), _restored(batch.column(3), batch.column(4).to_numpy())
            edges = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]).any(axis=1)) + 1).tolist(), len(leaf)]
            for a, b in zip(edges, edges[1:]):
                if key is not None and (leaf[a] != key).any():
                    yield solved(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                key = leaf[a]
                ids.append(node[a:b])
                vectors.append(v[a:b])
        if ids:
            yield solved(np.concatenate(ids), np.concatenate(vectors))

    return leaves.select("tree", "leaf", "node", "half", "scale").mapInArrow(run, "u long, v long, d double")


def _offers(gathered: DataFrame, offers: int) -> DataFrame:
    """``(u, v, d)``: to each gathered node its closest companions, where they beat its worst neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _OWNERS):
                lists = whole.column(0).slice(at, _OWNERS)
                sizes = np.asarray(lists.value_lengths())
                width = int(sizes.max(initial=0))
                if width < 2:
                    continue
                flat = lists.flatten()
                item, worst = flat.field("item").to_numpy(), flat.field("worst").to_numpy()
                vectors = _restored(flat.field("half"), flat.field("scale").to_numpy())
                owner = np.repeat(np.arange(len(sizes)), sizes)
                nth = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
                ids = np.full((len(sizes), width), -1, np.int64)
                bound = np.zeros((len(sizes), width))
                v = np.full((len(sizes), width, vectors.shape[1]), np.nan)
                ids[owner, nth], bound[owner, nth], v[owner, nth] = item, worst, vectors
                place, d = _closest(v, min(offers, width - 1))
                other = np.take_along_axis(ids[:, None], place.reshape(len(ids), 1, -1), 2).reshape(place.shape)
                keep = d < bound[:, :, None]
                mine = np.broadcast_to(ids[:, :, None], place.shape)
                yield _pairs([mine[keep]], [other[keep]], [d[keep]])

    return gathered.select("members").mapInArrow(run, "u long, v long, d double")


def _best(pairs: DataFrame, degree: int) -> DataFrame:
    """``(node, near)``: the nearest ``degree`` of each node as an array of (d, v), ties to the smaller id."""
    near = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("d", "v")))), 1, degree)
    return pairs.groupBy(F.col("u").alias("node")).agg(near.alias("near"))


def _links(graph: DataFrame, reverse: int, seed: int) -> DataFrame:
    """``(node, item)`` both ways: own neighbours, and at most ``reverse`` of the nodes that point at one, chosen by a hash."""
    edges = graph.select("node", F.explode("near").alias("near")).select("node", F.col("near.v").alias("item"))
    chosen = first_per_group(edges, ["item"], [F.xxhash64("node", F.lit(seed)), F.col("node")], reverse).select("node", "item")
    return chosen.unionByName(chosen.select(F.col("item").alias("node"), F.col("node").alias("item"))).distinct()


def _first_graph(nodes: DataFrame, total: int, trees: int, leaf: int, degree: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(graph, halves). Half spaces are cut at the medians of a bounded sample."""
    bits = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
    sample = bounded_sample(nodes.select("node", "v"), CUT_SAMPLE, "node").select("v").limit(2 * CUT_SAMPLE).collect()
    known = np.array([r["v"] for r in sample]) if sample else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    cuts = rng.normal(size=(trees, bits, known.shape[1]))
    limits = np.array([np.median(known @ c.T, axis=0) for c in cuts])
    halves = materialize(_halves(nodes, cuts, limits), "halves")
    # Nodes in the order of their codes, cut into leaves of one size: no leaf is crowded, and none has a single node.
    placed = halves.select("node", "half", "scale", F.posexplode("codes").alias("tree", "code"))
    placed = global_row_number(placed, ["tree"], ["code", "node"], "place")
    parts = max(1, round(total / leaf))
    dealt = placed.withColumn("leaf", F.expr(f"(place - 1) * {parts}L div {max(1, total)}L"))
    dealt = dealt.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf")
    pairs = _leaf_pairs(dealt, max(1, degree // 2))
    return materialize(_best(pairs, degree), "graph"), halves.select("node", "half", "scale")


def neighbour_graph(
    nodes: DataFrame,
    degree: int = DEGREE,
    reverse: int = REVERSE,
    offers: int = OFFERS,
    rounds: int = ROUNDS,
    trees: int = TREES,
    leaf: int = LEAF,
    seed: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """``(node, near)`` for ``(node, v)`` with distinct vectors, and the halved vectors."""
    total = nodes.count()
    graph, halves = _first_graph(nodes, total, trees, leaf, degree, seed)
    for nth in range(rounds if total > leaf else 0):
        worst = F.when(F.size("near") < degree, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
        known = halves.join(graph.select("node", worst.alias("worst")), "node", "left")
        items = known.select(F.col("node").alias("item"), "half", "scale", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        gathered = _links(graph, reverse, nth).join(items, "item").groupBy("node").agg(F.collect_list(F.struct("item", "worst", "half", "scale")).alias("members"))
        better = _offers(gathered, offers)
        kept = graph.select(F.col("node").alias("u"), F.explode("near").alias("near")).select("u", "near.v", "near.d")
        graph = materialize(_best(better.unionByName(kept), degree), "graph")
    return graph, halves


def _distances(pairs: DataFrame) -> DataFrame:
    """``(q, item, d)`` of halved vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_restored(batch.column(i), batch.column(i + 1).to_numpy()) for i in (2, 4))
                d = pa.array(((a - b) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), d], names=["q", "item", "d"])

    return pairs.select("q", "item", "half", "scale", "q_half", "q_scale").mapInArrow(run, "q long, item long, d double")


def greedy_search(graph: DataFrame, halves: DataFrame, starts: DataFrame, reverse: int, beam: int, step: int) -> DataFrame:
    """``(q, item)``: the beam of each query node ``(q)`` when all of it has been visited."""
    lists = _links(graph, reverse, -1).groupBy("node").agg(F.collect_list("item").alias("items"))
    lists = materialize(lists, "links")
    own = materialize(starts.join(halves, starts["q"] == halves["node"]).select("q", F.col("half").alias("q_half"), F.col("scale").alias("q_scale")), "query_nodes")
    first = F.array(F.struct(F.lit(0.0).alias("d"), F.col("q").alias("item"), F.lit(False).alias("seen")))
    state = materialize(own.select("q", first.alias("beam")), "beams")
    finished = state.limit(0)
    while not is_empty(state):
        next_ones = F.slice(F.filter("beam", lambda x: ~x["seen"]), 1, step)
        opened = state.select("q", F.explode(next_ones).alias("x")).select("q", F.col("x.item").alias("node"))
        reached = opened.join(lists, "node").select("q", F.explode("items").alias("item"))
        reached = reached.groupBy("q").agg(F.collect_set("item").alias("items"))  # step times degree and reverse at most
        known = state.select("q", F.transform("beam", lambda x: x["item"]).alias("known"))
        fresh = reached.join(known, "q").select("q", F.explode(F.array_except("items", "known")).alias("item"))
        asked = fresh.join(halves.withColumnRenamed("node", "item"), "item").join(own, "q")
        met = _distances(asked).groupBy("q").agg(F.collect_list(F.struct("d", "item", F.lit(False).alias("seen"))).alias("met"))
        last = F.element_at(next_ones, -1)

        def visit(x: Column) -> Column:
            upto = (x["d"] < F.col("last.d")) | ((x["d"] == F.col("last.d")) & (x["item"] <= F.col("last.item")))
            return F.struct(x["d"].alias("d"), x["item"].alias("item"), (x["seen"] | upto).alias("seen"))

        visited = F.transform("beam", visit)
        none = F.array().cast("array<struct<d:double,item:long,seen:boolean>>")
        merged = F.slice(F.array_sort(F.concat(visited, F.coalesce("met", none))), 1, beam)
        moved = state.withColumn("last", last).join(met, "q", "left").select("q", merged.alias("beam"))
        moved = materialize(moved, "beams")
        open_ones = F.exists("beam", lambda x: ~x["seen"])
        finished = finished.unionByName(moved.filter(~open_ones))
        state = moved.filter(open_ones)
    return finished.select("q", F.explode("beam").alias("x")).select("q", F.col("x.item").alias("item"))


def _squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_neighbours(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    degree: int = DEGREE,
    reverse: int = REVERSE,
    rounds: int = ROUNDS,
    beam: int = BEAM,
    step: int = STEP,
    leaf: int = LEAF,
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every`` the ``k`` nearest other rows found.

    Euclidean distance of the original vectors in double precision, ties to the smaller id. Vectors that are null, empty, all zero or hold null
    or non-finite components take no part, nor do rows without id or with another length than most. Rows that share an id are one
    query for each distinct vector and never find one another (an id with more than ``k`` vectors may find fewer than ``k``); repeated rows
    count once. With fewer than two rows there is no result. Half-space cuts are fitted on about
    ``CUT_SAMPLE`` vectors; every row is indexed.
    """
    rows = materialize(usable_vectors(vectors, id_col, vec_col).distinct(), "vectors")
    by_id = W.partitionBy("v").orderBy("id")
    # Of equal vectors only the k + 1 smallest ids can be among the nearest of a query, which may be one of them.
    ranked = rows.select("id", "v", F.row_number().over(by_id).alias("nth"), F.first("id").over(by_id).alias("node"))
    ranked = materialize(ranked.filter(F.col("nth") <= k + 1), "members")
    nodes = ranked.filter("nth = 1").select("node", "v")
    queries = rows.filter(F.col("id") % every == 0)
    asked = materialize(queries.join(nodes, "v").select(F.col("id").alias("query_id"), F.col("node").alias("q")), "queries")
    graph, halves = neighbour_graph(nodes, degree, reverse, rounds=rounds, leaf=leaf)
    found = greedy_search(graph, halves, asked.select("q").distinct(), reverse, beam, step)
    vectors_of = nodes.select(F.col("node").alias("q"), F.col("v").alias("q_v"))
    exact = found.join(nodes.withColumnRenamed("node", "item"), "item").join(vectors_of, "q").select("q", "item", F.sqrt(_squared("v", "q_v")).alias("score"))
    exact = materialize(exact, "found")
    reached = exact.join(ranked.select(F.col("node").alias("item"), "id"), "item").select("q", "id", "score")
    near = materialize(first_per_group(reached, ["q"], ["score", "id"], 2 * k + 2, "at").select("q", "id", "score"), "nearest")
    pairs = asked.join(near, "q").filter(F.col("id") != F.col("query_id")).dropDuplicates(["query_id", "q", "id"])
    best = first_per_group(pairs, ["query_id", "q"], ["score", "id"], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
