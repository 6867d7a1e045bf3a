"""Approximate nearest neighbours: one vantage-point tree per shard, searched with relaxed triangle pruning.

Rows are dealt to the nearest of at most `POINTS` global vantage points, which are rows drawn by hash of their id; a point's rows make one shard, or
several, dealt by hash, where there are more than `shard_rows` of them. Each point keeps how near and how far its rows lie. A query first
learns a bound on its k-th distance from a drawn sample of rows that all tasks are told; then it goes only to shards that the triangle
inequality leaves open: nothing in a shard can be nearer than the query's distance to the point less the farthest row's, the nearest row's less
the query's, or half of what the point is farther than the query's own. So rows are shuffled once and a tree is built once, by a task that
reads its shard's rows and then, batch by batch, the queries that were sent there. One window per query joins the shards' answers.

Inside a tree, a subtree on the far side of a vantage point's sphere is skipped if `factor` times the distance to the sphere exceeds the
query's k-th distance so far; shards are skipped by the same rule. With factor 1 that is the triangle inequality and the search is
exact; larger factors skip more.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id;
only vectors of one length are compared; copies of a vector are equal neighbours, ordered by id; rows that repeat an id
and its vector count once; of query rows that repeat an id the least vector asks; very long vectors only cost memory in
proportion; extra columns are ignored; no valid row gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankfold.llm.common import materialize

FACTOR = 1.2
SHARD_ROWS, LEAF = 8192, 128
#: Global vantage points at most, and rows that bound a query's k-th distance; both are told to all tasks.
POINTS, SAMPLE = 1024, 4096


class Tree:
    """Vantage-point tree over the rows of a matrix: nodes (vantage row, radius, inner, outer), leaves arrays of rows."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.leaf = vectors, leaf
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        away = _distance(self.vectors[rows], self.vectors[rows[0]])
        # The row farthest from the first spreads distances more than a row from the middle.
        vantage = rows[int(np.argmax(away))]
        rest = rows[rows != vantage]
        away = _distance(self.vectors[rest], self.vectors[vantage])
        radius = float(np.median(away))
        inner = away <= radius
        if inner.all():
            inner = away < radius
            if not inner.any():
                return rows  # all at one distance: nothing to split
        return vantage, radius, self._build(rest[inner]), self._build(rest[~inner])

    def search(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float = FACTOR) -> "Nearest":
        best = Nearest(len(queries), k)
        norms = np.einsum("ij,ij->i", queries, queries)

        def offer(rows: np.ndarray, at: np.ndarray) -> None:
            near = norms[at, None] + self.norms[rows] - 2 * queries[at] @ self.vectors[rows].T
            slack = 1e-9 * (1 + norms[at, None] + self.norms[rows])
            q, r = np.nonzero((near <= best.limit(at)[:, None] ** 2 + slack) & (query_ids[at, None] != ids[rows]))
            if len(q):
                best.add(at[q], _distance(queries[at[q]], self.vectors[rows[r]]), ids[rows[r]])

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if not isinstance(node, tuple):
                # Large leaves (many copies of one vector) are offered in slices, so memory stays bounded.
                for i in range(0, len(node), 1024):
                    offer(node[i:i + 1024], at)
                return
            vantage, radius, inner, outer = node
            offer(np.array([vantage]), at)
            away = _distance(queries[at], self.vectors[vantage])
            within = away <= radius
            visit(inner, at[within])
            visit(outer, at[~within])
            open_ = factor * np.abs(away - radius) <= best.limit(at)
            visit(outer, at[within & open_])
            visit(inner, at[~within & open_])

        for i in range(0, len(queries), 512):
            visit(self.root, np.arange(i, min(i + 512, len(queries))))
        return best


class Nearest:
    """The k best (distance, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.distance, self.ids = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def limit(self, at: np.ndarray) -> np.ndarray:
        return self.distance[at, -1]

    def add(self, at: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        """Offers sorted by `at`, any number for each."""
        touched = np.unique(at)
        k = self.distance.shape[1]
        owner = np.concatenate([np.repeat(touched, k), at])
        d = np.concatenate([self.distance[touched].ravel(), distance])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, d, owner))
        first = np.searchsorted(owner[order], touched)
        pick = order[(first[:, None] + np.arange(k)).ravel()].reshape(-1, k)
        self.distance[touched], self.ids[touched] = d[pick], i[pick]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Points:
    """Global vantage points and the sample, by vector length. Cell numbers count all points; rows of a length without a point have a cell by length."""

    def __init__(self, sample: list, cells: int):
        self.ids, self.vectors, self.points, self.first = {}, {}, {}, {}
        for size in sorted({r["size"] for r in sample}):
            mine = [r for r in sample if r["size"] == size]
            self.ids[size] = np.array([r["id"] for r in mine], dtype=np.int64)
            self.vectors[size] = np.array([r["v"] for r in mine], dtype=float)
            share = max(1, round(cells * len(mine) / len(sample)))
            self.points[size] = np.unique(self.vectors[size][:share], axis=0)
            self.first[size] = sum(len(p) for s, p in self.points.items() if s < size)

    def away(self, vectors: np.ndarray) -> np.ndarray:
        """Distances to the points of this length, a column each."""
        points = self.points[vectors.shape[1]]
        return np.column_stack([_distance(vectors, p) for p in points])

    def limit(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """Distance within which at least k rows of the sample lie, the query's own id left out."""
        size = vectors.shape[1]
        if len(self.ids[size]) < k:
            return np.full(len(ids), np.inf)
        out = np.empty(len(ids))
        for i in range(len(ids)):
            d = np.where(self.ids[size] == ids[i], np.inf, _distance(self.vectors[size], vectors[i]))
            out[i] = np.partition(d, k - 1)[k - 1]
        return out


def _by_size(batch: pa.RecordBatch, column: int):
    """`(rows, matrix)` of the vectors of each length."""
    vectors = batch.column(column)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_column: str = "vec_id",
            vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, points: int = POINTS, sample: int = SAMPLE) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: up to k nearest rows of every query row, the row with the query's id left out."""

    def narrow(df: DataFrame) -> DataFrame:
        vector = F.col(vector_column).cast("array<double>")
        df = df.select(F.col(id_column).cast("long").alias("id"), vector.alias("v"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("v")))

    rows = narrow(rows)
    queries = narrow(queries).groupBy("id").agg(F.min("v").alias("v"))
    cells = max(1, min(points, math.ceil(rows.count() / shard_rows)))
    drawn = rows.select("id", "v", F.size("v").alias("size")).orderBy(F.xxhash64("id"), "id", "v").limit(max(sample, cells)).collect()
    told = Points(drawn, cells)

    def place(batches):
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for at, vectors in _by_size(batch, 1):
                size = vectors.shape[1]
                if size not in told.points:
                    cell[at] = -size
                    continue
                away = told.away(vectors)
                best = away.argmin(axis=1)
                cell[at], far[at] = told.first[size] + best, away[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    placed = materialize(rows.mapInArrow(place, "id long, v array<double>, cell int, far double"))
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()  # a row per point or length
    parts = {r["cell"]: math.ceil(r["n"] / shard_rows) for r in held}
    reach = {r["cell"]: (r["near"], r["far"]) for r in held}

    def send(batches):
        """Each query to the shards that stay open."""
        for batch in batches:
            asked, cell = [], []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, vectors in _by_size(batch, 1):
                size = vectors.shape[1]
                if size not in told.points:
                    if -size in parts:
                        asked.append(at)
                        cell.append(np.full(len(at), -size))
                    continue
                away, limit = told.away(vectors), told.limit(ids[at], vectors, k)
                own = away.min(axis=1)
                for j in range(away.shape[1]):
                    number = told.first[size] + j
                    if number in reach:
                        near, far = reach[number]
                        least = np.maximum.reduce([away[:, j] - far, near - away[:, j], (away[:, j] - own) / 2])
                        open_ = factor * least <= limit + 1e-9 * (1 + away[:, j])
                        asked.append(at[open_])
                        cell.append(np.full(int(open_.sum()), number))
            asked, cell = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asked, cell))
            copies = np.array([parts[c] for c in cell.tolist()], dtype=np.int64)
            which = np.repeat(np.arange(len(asked)), copies)
            part = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
            at = pa.array(asked[which])
            yield pa.RecordBatch.from_arrays([pa.array(cell[which].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(which), dtype=bool)),
                                              batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "part", "asks", "id", "v"])

    many = F.element_at(F.create_map(*[F.lit(x) for c, n in parts.items() for x in (c, n)]), F.col("cell")) if parts else F.lit(1)
    shards = placed.select("cell", F.pmod(F.xxhash64("id"), many.cast("long")).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    sent = queries.mapInArrow(send, "cell int, part int, asks boolean, id long, v array<double>")
    cellwise = shards.unionByName(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks", "id")

    def answer(batches):
        shard, gathered, tree, ids = None, [], None, None
        for batch in batches:
            cell, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            key = np.column_stack([cell, part, asks.astype(np.int64)])
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, int)
            for a, b in zip(starts, np.r_[starts[1:], len(key)]):
                if shard != (cell[a], part[a]):
                    shard, gathered, tree = (cell[a], part[a]), [], None
                run = batch.slice(a, b - a)
                numbers = run.column(3).to_numpy(zero_copy_only=False)
                vectors = run.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
                if not asks[a]:
                    gathered.append((numbers, vectors))
                    continue
                if tree is None and gathered:
                    ids, rows_of = np.concatenate([i for i, _ in gathered]), np.concatenate([v for _, v in gathered])
                    order = np.lexsort((*rows_of.T[::-1], ids))
                    ids, rows_of = ids[order], rows_of[order]
                    new = np.r_[True, (ids[1:] != ids[:-1]) | (rows_of[1:] != rows_of[:-1]).any(axis=1)]
                    ids, tree, gathered = ids[new], Tree(rows_of[new]), []
                if tree is not None:
                    best = tree.search(ids, vectors, numbers, k, factor)
                    q, r = np.nonzero(np.isfinite(best.distance))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(best.ids[q, r]), pa.array(best.distance[q, r])], names=["query_id", "vec_id", "score"])

    found = cellwise.mapInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
