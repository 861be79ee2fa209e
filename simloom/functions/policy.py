"""The edge policy: a small network over the two vectors of an edge, in numpy.

concat(from, to) -> linear -> ELU -> linear -> ELU -> linear -> logit f;
theta = sigmoid(f) (1 - 2 eps) + eps, and log probabilities [log theta,
log(1 - theta)]. Column 1, that is 1 - theta, is the probability to keep an
edge. Gradients and Fisher products are written out by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PROB = 1e-4


class Policy:
    """What decides over edges. ``score`` adds prob, the probability to keep each of ``edges`` (from_id, slot, to_id and more)."""

    def score(self, edges: DataFrame, vertices: DataFrame, greedy: bool = False) -> DataFrame:
        raise NotImplementedError


class EveryEdge(Policy):
    """Keeps every edge."""

    def score(self, edges: DataFrame, vertices: DataFrame, greedy: bool = False) -> DataFrame:
        return edges.withColumn("prob", F.lit(1.0))


class EdgePolicy(Policy):
    """Parameters as one flat vector, with views for the layers."""

    def __init__(self, vertex_size: int, hidden_size: int, seed: int = 0, flat: np.ndarray | None = None):
        self.d, self.h = vertex_size, hidden_size
        self.shapes = [(2 * vertex_size, hidden_size), (hidden_size,), (hidden_size, hidden_size), (hidden_size,), (hidden_size, 1), (1,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            fans = [s[0] if len(s) == 2 else p[0] for s, p in zip(self.shapes, [self.shapes[i - i % 2] for i in range(6)], strict=True)]
            flat = np.concatenate([rng.uniform(-(f**-0.5), f**-0.5, n) for f, n in zip(fans, sizes, strict=True)])
        self.flat = np.array(flat, np.float64)
        self.cuts = np.cumsum([0, *sizes])

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        flat = self.flat if flat is None else flat
        return [flat[a:b].reshape(s) for a, b, s in zip(self.cuts, self.cuts[1:], self.shapes, strict=False)]

    def score(self, edges: DataFrame, vertices: DataFrame, greedy: bool = False) -> DataFrame:
        return keep_probabilities(edges, vertices, self, greedy)

    def logits(self, x: np.ndarray, flat: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        w1, b1, w2, b2, w3, b3 = self.parts(flat)
        z1 = x @ w1 + b1
        a1 = np.where(z1 > 0, z1, np.expm1(np.minimum(z1, 0)))
        z2 = a1 @ w2 + b2
        a2 = np.where(z2 > 0, z2, np.expm1(np.minimum(z2, 0)))
        return (a2 @ w3 + b3)[:, 0], (x, z1, a1, z2, a2)

    @staticmethod
    def theta(f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-f)) * (1 - 2 * MIN_PROB) + MIN_PROB

    def logp(self, x: np.ndarray, flat: np.ndarray | None = None) -> np.ndarray:
        t = self.theta(self.logits(x, flat)[0])
        return np.stack([np.log(t), np.log1p(-t)], 1)

    def backward(self, cache: tuple, df: np.ndarray, flat: np.ndarray | None = None) -> np.ndarray:
        """Gradient of sum(df * f) by all parameters, flat."""
        x, z1, a1, z2, a2 = cache
        _, _, w2, _, w3, _ = self.parts(flat)
        d2 = (df[:, None] * w3[:, 0]) * np.where(z2 > 0, 1, np.exp(np.minimum(z2, 0)))
        d1 = (d2 @ w2.T) * np.where(z1 > 0, 1, np.exp(np.minimum(z1, 0)))
        return np.concatenate([(x.T @ d1).ravel(), d1.sum(0), (a1.T @ d2).ravel(), d2.sum(0), a2.T @ df, [df.sum()]])

    def forward_product(self, cache: tuple, v: np.ndarray, flat: np.ndarray | None = None) -> np.ndarray:
        """Directional derivative of f along parameters v, for each row."""
        x, z1, a1, z2, a2 = cache
        _, _, w2, _, w3, _ = self.parts(flat)
        v1, c1, v2, c2, v3, c3 = self.parts(v)
        r1 = (x @ v1 + c1) * np.where(z1 > 0, 1, np.exp(np.minimum(z1, 0)))
        r2 = (a1 @ v2 + r1 @ w2 + c2) * np.where(z2 > 0, 1, np.exp(np.minimum(z2, 0)))
        return (a2 @ v3 + r2 @ w3)[:, 0] + c3[0]


def with_vectors(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edges`` with the vectors of both ends."""
    a = vertices.select(F.col("id").alias("from_id"), F.col("vec").cast("array<double>").alias("from_vec"))
    b = vertices.select(F.col("id").alias("to_id"), F.col("vec").cast("array<double>").alias("to_vec"))
    return edges.join(a, "from_id").join(b, "to_id")


def pairs_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy().reshape(-1, d) if batch.num_rows else np.zeros((0, d)) for c in ("from_vec", "to_vec"))
    return np.concatenate([a, b], 1)


def keep_probabilities(edges: DataFrame, vertices: DataFrame, policy: EdgePolicy, greedy: bool = False) -> DataFrame:
    """``edges`` with column prob: the probability to keep each, or 1 and 0 if greedy."""
    names = edges.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields] + ["prob double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logp = policy.logp(pairs_of(batch, policy.d))
            prob = (logp[:, 1] > logp[:, 0]).astype(np.float64) if greedy else np.exp(logp[:, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prob)], [*names, "prob"])

    return with_vectors(edges, vertices).select(*names, "from_vec", "to_vec").mapInArrow(run, schema)
