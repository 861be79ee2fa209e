"""Hard-negative mining with a vector-approximation file.

Every dimension is cut into at most ``CELLS`` cells; the approximation of a
vector is the number of its cell in each, one byte a dimension. For a query, a
table gives each cell's least and greatest contribution to the inner product,
and sums over the table, looked up by cell numbers, bound a row's score from
both sides. Only rows that these bounds leave possible are scored exactly:

1. positives: a row whose upper bound is below the (k+1)-th largest lower bound
   of the anchor's label can't be among the anchor's k positives;
2. negatives: a row whose bounds miss the window below a positive's score is out,
   and so is one whose upper bound is below the k-th largest lower bound among
   the rows that are inside the window for certain.

Both hold whatever the cells are, so the answer is exact; cells only decide how
many rows are scored. Inner marks are quantiles of about ``SAMPLE`` vectors, the
outermost cells end at the true least and greatest component of all.

Rows of equal vector and label are one unit with its first ids, and equal
anchors are searched once, so a vector that a third of all rows hold is one row
of the scan. Scans pair blocks of approximations with blocks of anchors: what is
copied once for each block of anchors is the approximations, not the vectors.

Defined results: rows with a null vec_id, label or vector, or any null or
non-finite component take no part, nor do vectors of another length than the
most frequent (the smaller of two) or with a component whose products might not
fit a long. Of several rows of one vec_id the one with the least vector, then
label, counts. Ties go to the smaller vec_id. An anchor without positives, or a
positive without negatives in its window, has no row; so has an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.plans import durable

CELLS, SAMPLE, BLOCK_ROWS, ANCHOR_ROWS, TOGETHER = 256, 8192, 4096, 256, 16
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame, label: Column, scale: int = 256, vec_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, v in whole numbers, and the number of dimensions."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec).cast("array<double>").alias("x")).dropna()
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    top = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = top[0]["dim"] if top else 0
    limit = float(int(((2**63 - 1) / (100 * max(dim, 1))) ** 0.5))
    rows = rows.where(F.size("x") == dim).withColumn("x", F.transform("x", lambda c: c * scale)).where(F.forall("x", lambda c: F.abs(c) < limit))
    rows = rows.select("vec_id", F.struct(F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"), "label").alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v"), dim


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def fit_marks(units: DataFrame, dim: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The inner marks of each dimension, and the least and greatest component of each of its cells."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dim, 2**62), np.full(dim, -(2**62))
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dim)
                lo, hi = np.minimum(lo, v.min(0)), np.maximum(hi, v.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(lo), pa.array(hi)], ["j", "lo", "hi"])

    span = units.select("v").mapInArrow(ends, "j int, lo long, hi long").groupBy("j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("j").collect()  # a row for each dimension
    share = min(1.0, min(SAMPLE, (1 << 25) // dim) / max(units.count(), 1))
    some = units.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toPandas()
    x = np.stack(some["v"].to_numpy()) if len(some) else np.array([[r["lo"] for r in span]])
    marks, least, most = [], np.zeros((dim, CELLS), np.int64), np.zeros((dim, CELLS), np.int64)
    for j, r in enumerate(span):
        inner = np.unique(np.quantile(x[:, j], np.arange(1, CELLS) / CELLS, method="higher")).astype(np.int64)
        inner = inner[(inner > r["lo"]) & (inner <= r["hi"])]
        marks.append(inner)
        n = len(inner) + 1
        least[j, :n], most[j, :n] = np.r_[r["lo"], inner], np.r_[inner - 1, r["hi"]]
    return marks, least, most


def approximations(units: DataFrame, marks: list[np.ndarray], blocks: int) -> DataFrame:
    """(unit, label, cells, block): a byte for each dimension of each vector."""
    dim = len(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            told = np.stack([np.searchsorted(m, v[:, j], "right") for j, m in enumerate(marks)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("label"), pa.array([r.tobytes() for r in told], pa.binary())], ["unit", "label", "cells"])

    told = units.select("unit", "label", "v").mapInArrow(run, "unit long, label long, cells binary")
    return told.withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))


def bounds(q: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's inner product with each row, by table lookup; ``cells`` has a row a dimension."""
    low, high = np.zeros((len(q), cells.shape[1]), np.int64), np.zeros((len(q), cells.shape[1]), np.int64)
    for j, at in enumerate(cells):
        a, b = q[:, j, None] * least[j], q[:, j, None] * most[j]
        low += np.take(np.minimum(a, b), at, 1)
        high += np.take(np.maximum(a, b), at, 1)
    return low, high


def _largest(x: np.ndarray, k: int) -> int:
    """The k-th largest value, or less than any where there are fewer."""
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -(2**62)


def positives_possible(k: int) -> Callable:
    """For one anchor of a block: (score of the window, rows, their lower bounds) that may be among the first k + 1 of its label."""

    def some(anchor, same, low, high):
        rows = np.flatnonzero(same)
        rows = rows[high[rows] >= _largest(low[rows], k + 1)]
        yield 0, rows, low[rows]

    return some


def negatives_possible(k: int, least_share: int) -> Callable:
    """For one anchor of a block and each of its windows: the rows that may be among the first k inside, with lower bounds of those certain to be."""

    def some(anchor, same, low, high):
        others = np.flatnonzero(~same)
        for top in anchor.windows:
            floor = -(-least_share * top // 100)
            rows = others[(high[others] >= floor) & (low[others] <= top)]
            sure = (low[rows] >= floor) & (high[rows] <= top)
            stay = high[rows] >= _largest(low[rows][sure], k)
            yield top, rows[stay], np.where(sure, low[rows], -(2**62))[stay]

    return some


def scan(cells: DataFrame, anchors: DataFrame, least: np.ndarray, most: np.ndarray, blocks: int, n_anchors: int, some: Callable, k: int) -> DataFrame:
    """(a, top, unit) of the rows that are possible by their bounds, for anchors(a, label, v, windows)."""
    parts = max(1, -(-n_anchors // ANCHOR_ROWS))
    left = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64),) * 5]
        if len(xs) and len(qs):
            units, labels = xs["unit"].to_numpy(), xs["label"].to_numpy()
            told = np.ascontiguousarray(np.frombuffer(b"".join(xs["cells"]), np.uint8).reshape(len(xs), -1).T)
            for i in range(0, len(qs), TOGETHER):
                part = qs.iloc[i : i + TOGETHER]
                low, high = bounds(np.stack(part["v"].to_numpy()).astype(np.int64), told, least, most)
                for n, anchor in enumerate(part.itertuples()):
                    for top, rows, sure in some(anchor, labels == anchor.label, low[n], high[n]):
                        found.append((np.full(len(rows), anchor.a), np.full(len(rows), top), units[rows], sure, high[n][rows]))
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("a", "top", "unit", "sure", "high"))})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(pair, "a long, top long, unit long, sure long, high long")
    met = durable.table(met, "possible")
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("a", "top").orderBy(F.desc("sure")))).where(F.col("r") <= k)
    bar = ranked.groupBy("a", "top").agg(F.max(F.when(F.col("r") == k, F.col("sure"))).alias("bar"))
    return met.join(bar, ["a", "top"]).where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("a", "top", "unit")


def scored(pairs: DataFrame, anchors: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (a, top, unit) with their exact score, and the first ids of the unit."""
    names = ["a", "top", "ids"]
    both = pairs.join(units.select("unit", "ids", "v"), "unit").join(anchors.select("a", F.col("v").alias("q")), "a").select(*names, "v", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, q = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64) for c in "vq")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array((v * q).sum(1))], [*names, "score"])

    return both.mapInArrow(run, "a long, top long, ids array<long>, score long")


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 5, least_share: int = 80, scale: int = 256, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each of an anchor's first positives, the first rows of other labels that
    score at least ``least_share`` hundredths of the positive's score, but not
    more than it. ``anchor`` is a condition on vec_id; components are floor(scale x).
    """
    spark = vectors.sparkSession
    rows, dim = prepared(vectors, label, scale, vec_id, vec)
    if not dim:
        return spark.createDataFrame([], RESULT)
    rows = durable.table(rows, "rows")
    held = max(n_positives + 1, n_negatives)
    place = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    units = rows.withColumn("n", place).where(F.col("n") <= held).groupBy("v", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # held ids at most
    units = durable.table(units.select(F.get("ids", F.lit(0)).alias("unit"), "label", "v", "ids"), "units")
    asked = rows.where(anchor)
    anchors = durable.table(asked.groupBy("v", "label").agg(F.min("vec_id").alias("a")), "anchors")
    count, n_anchors = units.count(), anchors.count()
    if not count or not n_anchors:
        return spark.createDataFrame([], RESULT)
    marks, least, most = fit_marks(units, dim)
    blocks = -(-count // BLOCK_ROWS)
    cells = durable.table(approximations(units, marks, blocks), "cells")

    first = scan(cells, anchors, least, most, blocks, n_anchors, positives_possible(n_positives), n_positives + 1)
    near = scored(first, anchors, units).select("a", F.explode("ids").alias("positive_id"), F.col("score").alias("positive_score"))
    best = lambda by, score, i: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), i)).cast("int")
    near = near.withColumn("n", best(["a"], "positive_score", "positive_id")).where(F.col("n") <= n_positives + 1)
    own = asked.join(anchors, ["v", "label"]).select(F.col("vec_id").alias("anchor_id"), "a")
    pairs = own.join(near.drop("n"), "a").where("anchor_id <> positive_id")
    pairs = pairs.withColumn("n", best(["anchor_id"], "positive_score", "positive_id")).where(F.col("n") <= n_positives).drop("n")
    pairs = durable.table(pairs, "positives")

    windows = pairs.where("positive_score >= 0").groupBy("a").agg(F.collect_set("positive_score").alias("windows"))  # n_positives + 1 at most
    second = scan(cells, anchors.join(windows, "a"), least, most, blocks, n_anchors, negatives_possible(n_negatives, least_share), n_negatives)
    far = scored(second, anchors, units).where((F.col("score") <= F.col("top")) & (F.col("score") * 100 >= F.col("top") * least_share))
    far = far.select("a", F.col("top").alias("positive_score"), F.explode("ids").alias("negative_id"), F.col("score").alias("negative_score"))
    far = far.withColumn("rank", best(["a", "positive_score"], "negative_score", "negative_id")).where(F.col("rank") <= n_negatives)
    return pairs.join(far, ["a", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the label after its own."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
