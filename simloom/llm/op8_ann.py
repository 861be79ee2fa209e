"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are dealt to lists by their nearest k-means centre; a random rotation
spreads their variance over all dimensions. Inside each probed list a query
reads the rotated vectors in column blocks. After each block a hypothesis test
compares a candidate's partial distance with what a candidate as near as the
present tenth-best would show on so many dimensions, and abandons it if it is
significantly farther. Survivors are measured exactly on the original vectors.

Centres and the number of probes are fitted on at most ``SAMPLE`` vectors, those
of the smallest id hashes; every vector is indexed. The number of probes is the
smallest that finds ``AIM`` of the sample's own true neighbours. Lists are cut
into blocks of about ``BLOCK_ROWS`` vectors, and each block's queries likewise,
so a task's memory is bounded however many vectors share a list.

Defined results: vectors null, zero, or holding null or non-finite components
take no part, nor do those of another length than the most frequent one. Rows
of one vec_id are one vector; a query's own vec_id is no candidate. Ties go to
the smaller vec_id. Without valid queries or candidates the result is empty.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.plans import durable

SAMPLE, MAX_LISTS, BLOCK_ROWS, AIM = 8192, 1024, 4096, 0.97
COLUMNS, EPSILON, FIRST = 16, 2.1, 64


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, aim: float) -> int:
    """Probed lists that find ``aim`` of the k true neighbours of sample vectors."""
    q = x[:256]
    d = _squared(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    true = np.argpartition(d, k - 1, 1)[:, :k]
    home = _squared(x, c).argmin(1)
    place = np.empty((len(q), len(c)), np.int64)
    np.put_along_axis(place, _squared(q, c).argsort(1), np.arange(len(c))[None], 1)
    at = np.sort(np.take_along_axis(place, home[true], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(aim * len(at))) - 1)]) + 1


def scan_block(q: np.ndarray, q_rot: np.ndarray, own: int, x: np.ndarray, x_rot: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of one block by adaptive dimension scan: ids and distances.

    The first rows, in id order, are measured in full and set the bound.
    """
    n, dim = x_rot.shape
    alive = np.flatnonzero(ids != own)
    head = alive[: max(FIRST, k)]
    bound = np.inf
    if len(head) >= k:
        bound = np.partition(((x_rot[head] - q_rot) ** 2).sum(1), k - 1)[k - 1]
    part = np.zeros(len(alive))
    for at in range(0, dim, COLUMNS):
        to = min(at + COLUMNS, dim)
        part += ((x_rot[alive, at:to] - q_rot[at:to]) ** 2).sum(1)
        if to < dim and np.isfinite(bound):
            stay = part <= bound * (to / dim) * (1 + EPSILON / to**0.5) ** 2
            alive, part = alive[stay], part[stay]
    if len(alive) > k:
        limit = np.partition(part, k - 1)[k - 1]
        stay = part <= limit * (1 + 1e-6) + 1e-12
        alive = alive[stay]
    dist = np.sqrt(((x[alive] - q) ** 2).sum(1))
    order = np.lexsort((ids[alive], dist))[:k]
    return ids[alive][order], dist[order]


def valid(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(finite & F.exists("vec", lambda v: v != 0))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest ``vectors``."""
    spark, rows = vectors.sparkSession, valid(vectors, vec_id, vec)
    out = "query_id long, vec_id long, score double"
    top = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = top[0]["dim"], top[0]["count"]
    rows = rows.where(F.size("vec") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    x = np.stack(sample["vec"].to_numpy())
    lists = max(1, min(MAX_LISTS, int(n**0.5) // 2, len(x) // 16))
    centres, turn = k_means(x, lists), rotation(dim)
    probes = probes_needed(x, centres, k, AIM)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vec"), dim) if batch.num_rows else np.zeros((0, dim))
            near = np.concatenate([_squared(v[i : i + 2048], centres).argmin(1) for i in range(0, len(v), 2048)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(near.astype(np.int32))], ["vec_id", "vec", "list"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vec"), dim) if batch.num_rows else np.zeros((0, dim))
            order = _squared(v, centres).argsort(1)[:, :probes].astype(np.int32)
            lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), lists_of], ["query_id", "query", "lists"])

    dealt = durable.table(rows.mapInArrow(deal, "vec_id long, vec array<double>, list int").dropDuplicates(["vec_id"]), "dealt")
    asked = valid(queries, vec_id, vec).where(F.size("vec") == dim).dropDuplicates(["vec_id"])
    routed = durable.table(asked.mapInArrow(route, "query_id long, query array<double>, lists array<int>"), "routed")
    sizes = {r[0]: r[1] for r in dealt.groupBy("list").count().collect()}  # one row for each of at most MAX_LISTS
    blocks = F.array(*(F.lit(max(1, -(-sizes.get(i, 0) // BLOCK_ROWS))) for i in range(lists)))
    parts = max(1, -(-routed.count() * probes // (lists * BLOCK_ROWS)))
    block = F.pmod(F.xxhash64("vec_id"), F.get(blocks, F.col("list"))).cast("int")
    left = dealt.select("vec_id", "vec", "list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = routed.select("query_id", "query", F.explode("lists").alias("list"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)).alias("block"))

    def scan(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(xs) and len(qs):
            xs = xs.sort_values("vec_id")
            ids, v = xs["vec_id"].to_numpy(), np.stack(xs["vec"].to_numpy())
            q = np.stack(qs["query"].to_numpy())
            v_rot, q_rot = v @ turn, q @ turn
            for i, own in enumerate(qs["query_id"].to_numpy()):
                got, dist = scan_block(q[i], q_rot[i], own, v, v_rot, ids, k)
                found.append(pd.DataFrame({"query_id": own, "vec_id": got, "score": dist}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ["list", "block", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, out)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
