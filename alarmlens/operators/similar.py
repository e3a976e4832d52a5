"""Semantic neighbours of incidents by vector distance."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.operators.ranking import first_per_group
from alarmlens.runtime import is_empty, materialize

BLOCK_CELLS = 1 << 22  # numbers in one block of vectors
TILE_ROWS = 2048
PIVOTS, MAX_PIVOTS = 64, 1024
PIVOT_SAMPLE = 4096


def _pivots(corpus: DataFrame, count: int | None) -> np.ndarray:
    """Vectors far from one another, out of a bounded sample of the corpus: each next one is the farthest from those before.

    Without ``count`` their number grows with the corpus, within bounds.
    """
    total = corpus.count()
    place = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_000))
    sample = corpus if total <= PIVOT_SAMPLE else corpus.filter(place < int(1_000_000 * PIVOT_SAMPLE / total))
    rows = [r["vector"] for r in sample.orderBy("id").limit(2 * PIVOT_SAMPLE).select("vector").collect()]
    if not rows and total:
        rows = [r["vector"] for r in corpus.limit(1).select("vector").collect()]
    if not rows:
        return np.zeros((0, 0))
    known = np.array(rows)
    if count is None:
        most = max(PIVOTS, min(MAX_PIVOTS, (1 << 18) // max(1, known.shape[1])))
        count = min(most, max(PIVOTS, total // 4096))
    chosen = [0]
    least = ((known - known[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(known)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((known - known[chosen[-1]]) ** 2).sum(1))
    return known[chosen]


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with ``cell`` and ``far``: the nearest pivot and the distance to it."""
    size = max(1, (1 << 22) // max(1, pivots.size))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["vector"].to_numpy())
                near = np.empty(len(v), np.int64)
                far = np.empty(len(v))
                for at in range(0, len(v), size):
                    d = np.sqrt(((v[at : at + size, None] - pivots[None]) ** 2).sum(2))
                    near[at : at + size] = d.argmin(1)
                    far[at : at + size] = d.min(1)
                yield pdf.assign(cell=near, far=far)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(assign, f"{kinds}, cell bigint, far double")


def cell_pairs(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Pairs of a query cell and a corpus cell that can hold one of the ``k`` nearest; all others are too far by the triangle
    inequality.

    In a query cell every query has ``k`` other corpus rows within the smallest bound that cells with that many rows
    reach; a corpus cell that lies beyond it as a whole is left out. The tables have one row per pivot.
    """
    radius = {r["cell"]: r["r"] for r in queries.groupBy("cell").agg(F.max("far").alias("r")).collect()}
    sizes = corpus.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).orderBy("cell").collect()
    cells, far, rows = (np.array([r[c] for r in sizes]) for c in ("cell", "r", "n"))
    pairs = []
    for own, reach in radius.items():
        gap = np.sqrt(((pivots[cells] - pivots[own]) ** 2).sum(1))
        upper = gap + reach + far
        order = np.argsort(upper, kind="stable")
        enough = np.cumsum(rows[order]) > k  # one of them may be the query itself
        limit = upper[order][enough.argmax()] if enough.any() else np.inf
        slack = 1e-9 * (1 + (limit if np.isfinite(limit) else 0))
        pairs += [(own, int(c)) for c in cells[gap - reach - far <= limit + slack]]
    return pairs


def _least(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` smallest finite entries of each row; of equal ones the first columns."""
    bound = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if dist.shape[1] > k else np.array([[np.inf]])
    row, col = np.nonzero((dist <= np.where(np.isnan(bound), np.inf, bound)) & np.isfinite(dist))
    order = np.lexsort((col, dist[row, col], row))
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept]


def _block_hits(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest entries of a corpus block for each class of a query block, tile by tile."""
    names = ["class", "neighbor_id", "copies", "distance"]
    if q.empty or c.empty:
        return pd.DataFrame({n: [] for n in names})
    c = c.sort_values("id", kind="stable")
    a, b = np.stack(q["vector"].to_numpy()), np.stack(c["vector"].to_numpy())
    ids, copies, square = c["id"].to_numpy(), c["copies"].to_numpy(), (b**2).sum(1)
    written = np.array([None if i is None else str(i) for i in ids], object) if q["alone"].any() else None
    pieces = []
    for at in range(0, len(a), TILE_ROWS):
        x, part = a[at : at + TILE_ROWS], q.iloc[at : at + TILE_ROWS]
        alone, own = part["alone"].to_numpy().astype(bool), part["own"].to_numpy()
        row, col, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for to in range(0, len(b), TILE_ROWS):
            y = slice(to, to + TILE_ROWS)
            dist = (x**2).sum(1)[:, None] + square[None, y] - 2 * x @ b[y].T
            if alone.any():
                dist[alone[:, None] & (own[:, None] == written[None, y])] = np.inf
            r, found = _least(dist, k)
            row, col, near = np.append(row, r), np.append(col, found + to), np.append(near, dist[r, found])
        order = np.lexsort((col, near, row))
        row, col, near = row[order], col[order], near[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, near = row[kept], col[kept], near[kept]
        pieces.append(pd.DataFrame(dict(zip(names, (part["class"].to_numpy()[row], ids[col], copies[col], near)))))
    return pd.concat(pieces)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    id_col: str = "id",
    vector_col: str = "embedding",
    block_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest corpus rows (Euclidean) of each query, itself excluded.

    Equal vectors are searched once: of the corpus rows with one vector only those with the ``k + 1`` smallest ids can be
    an answer, and queries with one vector share their ``k + 1`` nearest, from which each leaves itself out. Ids with several
    vectors in the corpus are searched on their own.

    What is left is dealt to the cells of the nearest pivots, cells are cut into blocks of bounded size, and only blocks of cell pairs that
    the triangle inequality can't rule out meet (``cell_pairs``). Each such pair is worked off in tiles that keep
    ``k + 1`` rows per query, so what reaches the final ranking is that many rows per query and block met, never all pairs. Distinct
    vectors without any structure rule nothing out; then the work is queries times corpus.
    """
    kind = queries.schema[id_col].dataType.simpleString()

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    spark = queries.sparkSession
    rows, asked = plain(corpus), plain(queries)
    entries = rows.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    entries = materialize(first_per_group(entries, ["vector"], ["id"], k + 1, "place").drop("place"), "entries")
    centres = _pivots(entries, pivots)
    if not len(centres):
        return spark.createDataFrame([], f"query_id {kind}, neighbor_id {kind}, distance double, rank int")
    mark = F.xxhash64("vector")
    spread = rows.groupBy("id").agg(F.min(mark).alias("least"), F.max(mark).alias("most")).filter("least <> most")
    spread = materialize(spread.select(F.col("id").alias("several")), "spread_ids")
    own = F.lit(None).cast("string").alias("own")
    if is_empty(spread):
        asked = asked.select("id", "vector", F.lit(False).alias("alone"), own)
    else:
        marked = asked.join(spread.withColumn("alone", F.lit(True)), F.col("id").eqNullSafe(F.col("several")), "left")
        own = F.when(F.col("alone"), F.col("id").cast("string")).alias("own")
        asked = marked.select("id", "vector", F.coalesce("alone", F.lit(False)).alias("alone"), own)
    classes = asked.select("vector", "alone", "own").distinct().withColumn("class", F.monotonically_increasing_id())
    q_cells = materialize(_in_cells(classes, centres), "query_cells")
    c_cells = materialize(_in_cells(entries, centres), "corpus_cells")
    # A class leaves out at most one entry, but those on their own every entry of their id.
    lone = q_cells.filter("alone").limit(1).count() > 0
    most = c_cells.groupBy("id").count().agg(F.max("count").alias("n")).first()["n"] if lone else 1
    pairs = cell_pairs(q_cells, c_cells, centres, k + most)
    if block_rows is None:
        block_rows = max(1024, min(65536, BLOCK_CELLS // max(1, centres.shape[1])))
    blocks = {}
    for name, cells in (("q", q_cells), ("c", c_cells)):
        counts = cells.groupBy("cell").count().collect()  # one row per pivot
        blocks[name] = {r["cell"]: max(1, -(-r["count"] // block_rows)) for r in counts}

    def side(cells: DataFrame, own: str, other: str, key: str, *columns: str) -> DataFrame:
        """Rows with the names of all block pairs in which their block takes part."""
        place = 0 if own == "q" else 1
        rows = [(p[place], blocks[own][p[place]], p[1 - place], blocks[other][p[1 - place]]) for p in pairs]  # cells, not rows
        met = spark.createDataFrame(rows, f"cell bigint, n_own bigint, {other} bigint, n_other bigint")
        joined = cells.join(met, "cell").withColumn(f"{own}b", F.pmod(F.xxhash64(key), F.col("n_own")))
        numbered = joined.withColumn(f"{other}b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_other") - 1)))
        return numbered.select(F.col("cell").alias(own), f"{own}b", other, f"{other}b", key, "vector", *columns)

    found = (
        side(q_cells, "q", "c", "class", "alone", "own")
        .groupBy("q", "qb", "c", "cb")
        .cogroup(side(c_cells, "c", "q", "id", "copies").groupBy("q", "qb", "c", "cb"))
        .applyInPandas(lambda q, c: _block_hits(q, c, k + 1), f"class bigint, neighbor_id {kind}, copies bigint, distance double")
    )
    best = first_per_group(found, ["class"], ["distance", "neighbor_id"], k + 1)
    hits = F.array_sort(F.collect_list(F.struct("rank", "distance", "neighbor_id", "copies")))
    lists = best.groupBy("class").agg(hits.alias("hits")).join(q_cells.select("class", "vector", "alone", "own"), "class")
    lists = materialize(lists.withColumnRenamed("own", "l_own").drop("class"), "class_hits")
    others = F.filter("hits", lambda h: ~h["neighbor_id"].eqNullSafe(F.col("id")))
    each = F.flatten(F.transform(others, lambda h: F.array_repeat(h, h["copies"].cast("int"))))
    same = [asked["vector"] == lists["vector"], asked["alone"] == lists["alone"], asked["own"].eqNullSafe(lists["l_own"])]
    answers = asked.join(lists, same).select("id", F.explode(F.slice(each, 1, k)).alias("h"))
    pairs_out = answers.select(F.col("id").alias("query_id"), "h.neighbor_id", "h.distance")
    return first_per_group(pairs_out, ["query_id"], ["distance", "neighbor_id"], k)


def text_vectors(documents: DataFrame, *, id_col: str = "incident_id", dims: int = 1024) -> DataFrame:
    """Normalized hashed TF-IDF vectors of a ``document`` column, when no model is at hand."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol="document", outputCol="words", pattern=r"[^\w%-]+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=dims),
            IDF(inputCol="tf", outputCol="idf"),
            Normalizer(inputCol="idf", outputCol="norm"),
        ]
    )
    fitted = stages.fit(documents).transform(documents)
    return fitted.select(id_col, vector_to_array("norm", "float32").alias("embedding"))
