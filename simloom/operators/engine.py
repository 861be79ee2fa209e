"""The session engine: a graph whose edges are scored by a policy, searched, and evolved."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.policy import Policy
from simloom.operators import beam
from simloom.operators import edges as E
from simloom.plans import durable


def worker_count(n: int | None) -> int:
    """None means all cores; negative numbers count back from them, -1 being all."""
    cores = os.cpu_count() or 1
    return cores if n is None else n if n >= 0 else cores + 1 + n


@dataclass
class SessionEngine:
    """Edges (from_id, slot, to_id, confidence) of a flat graph, kept as a written table, with candidates two hops away.

    ``prepare`` scores edges. In training it also moves their confidence and
    appends the virtual edges, in the slots behind a vertex's own. Each kind of
    table is kept in its last version: what ``prepare`` returned reads files that
    the next call, or :meth:`update_edges`, deletes.
    """

    vertices: DataFrame
    edges: DataFrame
    k: int = 1
    ef: int = 1
    max_trajectory: int = 80
    edge_patience: int = 100
    n_hop_virtual: int = 0
    initial_vertex_id: int = 0
    max_degree: int | None = None
    metric: str = "auto"
    seed: int = 0
    graph_type: str = "nsw"
    n_jobs: int | None = None
    batches: int = 0  # training batches so far; each draws its own numbers
    virtual: DataFrame | None = field(default=None, repr=False)
    confidence: DataFrame | None = field(default=None, repr=False)  # of some edges by their ends, where edges have no such column
    _held: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.graph_type == "hnsw":
            raise ValueError("graphs with levels are entered by beam.enter")
        if self.max_degree is None:
            self.max_degree = self.edges.groupBy("from_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        told = self.edges
        if "confidence" not in told.columns:
            told = told.withColumn("confidence", F.lit(0.0)) if self.confidence is None else E.with_confidence(told, self.confidence)
        self.edges = self.keep("edges", told.select("from_id", "slot", "to_id", F.col("confidence").cast("double").alias("confidence")))
        if self.virtual is None:
            self.resample()

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version of a table and delete the one before."""
        new, old = durable.table(df, name), self._held.get(name)
        self._held[name] = new
        durable.drop(old)
        return new

    def close(self) -> None:
        """Delete the engine's tables."""
        for df in self._held.values():
            durable.drop(df)
        self._held.clear()

    def resample(self) -> None:
        """Draw the virtual edges anew from what lies two hops away."""
        if self.n_hop_virtual:
            self.virtual = self.keep("virtual", E.virtual_candidates(self.edges, self.n_hop_virtual, self.seed))

    def prepare(self, policy: Policy, evaluate: bool = False, greedy: bool = False) -> DataFrame:
        """(from_id, slot, to_id, prob) of all edges under ``policy``."""
        scored = E.score(policy.score(self.edges, self.vertices, greedy), self.edge_patience, train=not evaluate)
        if evaluate:
            return scored.select("from_id", "slot", "to_id", "prob")
        scored = self.keep("edges", scored)
        self.edges = scored.select("from_id", "slot", "to_id", "confidence")
        out = scored.select("from_id", "slot", "to_id", "prob")
        if self.n_hop_virtual:
            degree = self.edges.groupBy("from_id").agg(F.count(F.lit(1)).cast("int").alias("_d"))
            more = policy.score(self.virtual, self.vertices, greedy).join(degree, "from_id")
            out = out.unionByName(more.select("from_id", (F.col("slot") + F.col("_d")).alias("slot"), "to_id", "prob"))
        return out

    def sessions(self, policy: Policy, queries: DataFrame, evaluate: bool = False, greedy: bool = False) -> DataFrame:
        """A session for each query (id, vec), as a written table, which the caller drops."""
        edges = self.prepare(policy, evaluate, greedy)
        if not evaluate:
            self.batches += 1
        some = queries if self.n_jobs is None else queries.repartition(worker_count(self.n_jobs))
        found = beam.search(self.vertices, edges, some, self.k, self.ef, self.max_trajectory, self.initial_vertex_id, self.metric, self.seed + self.batches)
        return durable.table(found, "sessions")

    def update_edges(self, policy: Policy) -> int:
        """Take out edges that were frozen out, promote the best virtual edges to free slots, and tell how many were promoted."""
        if not self.n_hop_virtual:
            candidates = self.edges.limit(0).select("from_id", "slot", "to_id", F.lit(0.0).alias("prob"))
        else:
            candidates = policy.score(self.virtual, self.vertices)
        kept = E.pruned(self.edges, self.edge_patience)
        before, left = self.edges.count(), kept.count()
        new = E.evolved(self.edges, candidates, self.edge_patience, self.max_degree)
        self.edges = self.keep("edges", new.select("from_id", F.col("slot").cast("int").alias("slot"), "to_id", "confidence"))
        promoted = self.edges.count() - left
        if promoted or left < before:
            self.resample()
        return promoted
