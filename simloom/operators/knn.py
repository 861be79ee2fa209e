"""Exact nearest neighbours by blocked matrix products.

Vertices that fit one broadcast are scanned by every task; queries are dealt so
that a task measures about ``TASK_PAIRS`` distances. More are dealt to
cells around sampled centres; a cell's centre and radius bound the distance of
any query to its rows from below. Each query first scans the nearest cells that
hold enough rows, which bounds its k-th distance from above, and then those other
cells that the two bounds leave possible. Cells are cut into tiles of ``TILE``
bytes at most and meet tiles of as many queries, so a vector is copied once for each
tile of queries that asks for its cell, and a task holds two tiles and MEASURED
distances. The answer doesn't depend on centres or sizes; they decide how much
is skipped, which in high dimensions without clusters may be nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.plans import durable

SMALL, TILE, MOST_CELLS, MEASURED, TASK_PAIRS, MOST_TASKS = 64 << 20, 32 << 20, 4096, 1 << 20, 1 << 26, 4096


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """A bound of each row's k-th smallest value from above, which few others reach: the k-th smallest of the least values of runs of columns."""
    run = d.shape[1] // (16 * k)
    if run > 1:
        d = d[:, : d.shape[1] // run * run].reshape(len(d), -1, run).min(2)
    return np.partition(d, k - 1, 1)[:, k - 1]


def _top(q_ids, q, ids, x, k: int, metric: str, skip_self: bool, far: np.ndarray | None = None) -> pd.DataFrame:
    """Each query's k nearest rows of one block, ties by id; ``far`` are the rows' squares."""
    far, near_by = (x * x).sum(1) if far is None else far, (q * q).sum(1)
    if metric == "dot":
        d = -q @ x.T
    else:
        d = (-2 * q) @ x.T  # less the query's own square, which changes no order
        d += far
    if skip_self:
        d[q_ids[:, None] == ids[None]] = np.inf
    if not (np.isfinite(far).all() and np.isfinite(near_by).all()):
        d[~np.isfinite(d)] = np.inf
    if k < d.shape[1]:  # all rows that rounding may have put behind the k-th, however many tie
        scale = near_by + far.max()
        margin = 8 * np.finfo(float).eps * (x.shape[1] + 8) * np.where(np.isfinite(scale), scale, np.inf)
        keep = d <= np.minimum(_kth(d, k) + margin, np.finfo(float).max)[:, None]
    else:
        keep = np.isfinite(d)
    rows, cols = np.divmod(np.flatnonzero(keep.ravel()), d.shape[1])
    near = np.empty(len(rows))
    step = max(1, MEASURED // max(x.shape[1], 1))
    for i in range(0, len(rows), step):  # measured again row by row, so that equal vectors have equal distances
        a, b = q[rows[i : i + step]], x[cols[i : i + step]]
        near[i : i + step] = -(a * b).sum(1) if metric == "dot" else ((b - a) ** 2).sum(1)
    order = np.lexsort((ids[cols], near, rows))
    rows, cols, near = rows[order], cols[order], near[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return pd.DataFrame({"query_id": q_ids[rows[first]], "vertex_id": ids[cols[first]], "distance": near[first]})


SCHEMA = "query_id long, vertex_id long, distance double"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _scan(q_ids, q, ids, x, k: int, metric: str, skip_self: bool) -> list[pd.DataFrame]:
    """Each query's k nearest of some rows, so many queries at a time that MEASURED distances are held."""
    if not len(q_ids) or not len(ids):
        return []
    step, far = max(1, MEASURED // len(ids)), (x * x).sum(1)
    return [_top(q_ids[i : i + step], q[i : i + step], ids, x, k, metric, skip_self, far) for i in range(0, len(q), step)]


def nearest(vertices: DataFrame, queries: DataFrame, k: int = 1, metric: str = "l2", skip_self: bool = False, tile_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vertex_id, distance), rank from 0; ties go to the smaller vertex id.

    ``tile_rows`` are the rows of a tile where vertices are too many to broadcast; None takes as many as fit TILE bytes.
    """
    n, width = vertices.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    vertices = vertices.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    queries = queries.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    if n * width * 8 <= SMALL:  # measured: all vertices fit in one broadcast
        rows = vertices.toArrow()
        held = vertices.sparkSession.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("vec"))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = held.value
            for batch in batches:
                for part in _scan(batch.column("id").to_numpy(), _matrix(batch.column("vec")), ids, x, k, metric, skip_self):
                    yield pa.RecordBatch.from_pandas(part, preserve_index=False)

        # dealt by work: a small file of queries may ask for many distances
        tasks = max(1, min(MOST_TASKS, -(-queries.count() * n // TASK_PAIRS)))
        near = queries.repartition(tasks).mapInArrow(scan, SCHEMA)
    else:
        cells = Cells.of(vertices, n, width, tile_rows)
        first = durable.table(cells.routed(queries, k + skip_self), "routed")
        found = durable.table(cells.scanned(first, k, metric, skip_self), "near")
        worst = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vertex_id"))).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("worst"))
        more = cells.routed(first.join(worst, "id", "left"), None, metric)
        near = found.unionByName(cells.scanned(durable.table(more, "routed"), k, metric, skip_self))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vertex_id")) - 1)
    return ranked.where(F.col("rank") < k).select("query_id", "rank", "vertex_id", "distance")


@dataclass
class Cells:
    """Vertices (id, vec, cell) as a written table, with the centre, radius and number of rows of each cell."""

    vertices: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    tile: int

    @classmethod
    def of(cls, vertices: DataFrame, n: int, width: int, tile_rows: int | None = None) -> "Cells":
        cores = vertices.sparkSession.sparkContext.defaultParallelism
        # so many tiles that pairs of them keep all cores busy
        tile = tile_rows or max(256, min(TILE // (8 * max(width, 1)), -(-n // math.isqrt(4 * cores))))
        count = min(MOST_CELLS, 2 * -(-n // tile))
        chosen = vertices.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(n)) < count).select("vec").toArrow()  # about count rows
        centres = _matrix(chosen.column("vec")) if chosen.num_rows else np.zeros((1, width))
        centres = centres[np.isfinite(centres).all(1)] if np.isfinite(centres).all(1).any() else np.zeros((1, width))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _far(_matrix(batch.column("vec")), centres) if batch.num_rows else np.zeros((0, 1))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "vec", "cell", "r"])

        table = durable.table(vertices.mapInArrow(deal, "id long, vec array<double>, cell int, r double"), "cells")
        radius, rows = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in table.groupBy("cell").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # MOST_CELLS rows
            radius[r["cell"]], rows[r["cell"]] = r["r"], r["n"]
        return cls(table, centres, radius, rows, tile)

    def routed(self, queries: DataFrame, enough: int | None, metric: str = "l2") -> DataFrame:
        """(id, vec, cells) of the cells that each query scans.

        With ``enough`` these are the nearest that hold so many rows; without, all
        others that may hold a row nearer than ``worst``, of ``queries`` (id, vec, cells, worst).
        """
        centres, radius, rows = self.centres, self.radius, self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("vec"))
                if not len(q):
                    continue
                d = _far(q, centres)
                if enough is not None:
                    order = d.argsort(1)
                    held = np.cumsum(rows[order], 1)
                    told = [o[: int(np.searchsorted(h, enough)) + 1] for o, h in zip(order, held, strict=True)]
                else:
                    slack = 1e-9 * (1 + d + radius)
                    low = -(q @ centres.T) - np.sqrt((q * q).sum(1))[:, None] * radius - slack * (1 + np.abs(q).max(1))[:, None] if metric == "dot" else np.maximum(d - radius - slack, 0) ** 2
                    worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(float)
                    open_ = ~(low > worst[:, None]) & (rows > 0)  # an unknown bound skips nothing
                    for i, seen in enumerate(batch.column("cells").to_pylist()):
                        open_[i, seen] = False
                    told = [np.flatnonzero(o) for o in open_]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array([t.astype(np.int32) for t in told], pa.list_(pa.int32()))], ["id", "vec", "cells"])

        return queries.mapInArrow(run, "id long, vec array<double>, cells array<int>")

    def scanned(self, routed: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
        """(query_id, vertex_id, distance): each query's k nearest of every tile that it scans."""
        asked = routed.select("id", "vec", F.explode("cells").alias("cell"))
        demand = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_CELLS rows
        parts = [(i, max(1, -(-int(n) // self.tile)), max(1, -(-demand.get(i, 0) // self.tile))) for i, n in enumerate(self.rows) if i in demand]
        cut = F.broadcast(routed.sparkSession.createDataFrame(parts, "cell int, tiles int, turns int"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        left = self.vertices.join(cut, "cell").select("id", "vec", "cell", own("tiles").alias("tile"), every("turns").alias("turn"))
        right = asked.join(cut, "cell").select("id", "vec", "cell", own("turns").alias("turn"), every("tiles").alias("tile"))

        def pair(xs: pa.Table, qs: pa.Table) -> pa.Table:
            found = _scan(qs.column("id").to_numpy(), _matrix(qs.column("vec")), xs.column("id").to_numpy(), _matrix(xs.column("vec")), k, metric, skip_self) if xs.num_rows and qs.num_rows else []
            parts = [pa.Table.from_pandas(f, preserve_index=False) for f in found]
            return pa.concat_tables(parts) if parts else pa.table({"query_id": pa.array([], pa.int64()), "vertex_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

        keys = ["cell", "tile", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, SCHEMA)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows and centres."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0))


def knn_graph(vertices: DataFrame, degree: int = 8, metric: str = "l2") -> DataFrame:
    """edges(from_id, slot, to_id): each vertex' nearest others, nearest first."""
    return nearest(vertices, vertices, degree, metric, skip_self=True).select(F.col("query_id").alias("from_id"), F.col("rank").alias("slot"), F.col("vertex_id").alias("to_id"))
