"""The state of a graph's edges: confidence, candidates two hops away, evolution and export."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import vectors as V
from simloom.plans import ranks


ORDER = 1000003  # places of the order that candidates are drawn in


def degree_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """n_vertices, n_edges, max_degree, mean_degree, isolated."""
    deg = vertices.select("id").join(edges.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left")
    d = F.coalesce("d", F.lit(0))
    return deg.agg(F.count(F.lit(1)).alias("n_vertices"), F.sum(d).alias("n_edges"), F.max(d).alias("max_degree"), F.avg(d).alias("mean_degree"), F.sum((d == 0).cast("long")).alias("isolated"))


def adjacency(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, neighbors) of every vertex in slot order; vertices without edges have an empty list."""
    lists = edges.groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("slot", "to_id"))).alias("s"))
    return vertices.select("id").join(lists, "id", "left").select("id", F.coalesce(F.transform("s", lambda s: s["to_id"]), F.array().cast("array<long>")).alias("neighbors"))


def padded(lists: DataFrame, width: int) -> DataFrame:
    """Neighbour lists filled up with -1."""
    return lists.select("id", F.concat("neighbors", F.array_repeat(F.lit(-1).cast("long"), F.lit(width) - F.size("neighbors"))).alias("neighbors"))


def with_confidence(edges: DataFrame, confidence: DataFrame) -> DataFrame:
    """``edges`` with their confidence, 0 where none is known."""
    return edges.join(confidence.select("from_id", "to_id", "confidence"), ["from_id", "to_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def with_confidence(edges: DataFrame, confidence: DataFrame) -> DataFrame:
    """``edges`` with their confidence (from_id, to_id, confidence), 0 where none is known."""
    known = confidence.select("from_id", "to_id", F.col("confidence").cast("double").alias("confidence"))
    return edges.join(known, ["from_id", "to_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def score(edges: DataFrame, patience: int, train: bool = True) -> DataFrame:
    """``edges`` (prob, confidence) after freezing, and in training with their next confidence."""
    out = edges.withColumn("prob", V.frozen(F.col("prob"), F.col("confidence"), patience))
    return out.withColumn("confidence", V.next_confidence(F.col("prob"), F.col("confidence"))) if train else out


def two_hops(edges: DataFrame) -> DataFrame:
    """(from_id, to_id): vertices two hops away that are neither the vertex nor its neighbours."""
    a, b = edges.alias("a"), edges.alias("b")
    far = a.join(b, F.col("a.to_id") == F.col("b.from_id")).select(F.col("a.from_id").alias("from_id"), F.col("b.to_id").alias("to_id"))
    return far.where("from_id <> to_id").distinct().join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def mix(a: Column, b: Column, seed: int) -> Column:
    """A reproducible order of pairs."""
    return (a.cast("long") * 7919 + b.cast("long") * 104729 + F.lit(seed * 15485863).cast("long")) % ORDER


def virtual_candidates(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(from_id, slot, to_id): at most ``n`` two-hop candidates a vertex, drawn by hash; ids aren't negative.

    In the order of :func:`mix` all vertices see the ends of another's edges in
    one cyclic order, each from a place of its own. So an edge asks its end's
    list, in that order, for as many as may be among the vertex' first n, which is
    n and one for each of its neighbours and itself; what lies two hops away of
    a hub isn't written out.
    """
    own = edges.groupBy("from_id").agg((F.count(F.lit(1)) + n + 1).alias("_need"))
    turn = F.pmod(F.col("to_id").cast("long") * 104729, F.lit(ORDER))
    lists = edges.groupBy(F.col("from_id").alias("_via")).agg(F.sort_array(F.collect_set(F.struct(turn.alias("b"), F.col("to_id").alias("to_id")))).alias("_near"))
    asked = edges.select("from_id", F.col("to_id").alias("_via")).distinct().join(own, "from_id").join(lists, "_via")
    start = F.pmod(-(F.col("from_id").cast("long") * 7919 + F.lit(seed * 15485863).cast("long")), F.lit(ORDER))
    asked = asked.withColumn("_start", start)
    asked = asked.withColumn("_before", F.size(F.filter("_near", lambda x: x["b"] < F.col("_start"))))
    ahead = F.slice("_near", F.col("_before") + 1, F.col("_need").cast("int"))
    behind = F.slice("_near", F.lit(1), F.least(F.col("_before"), F.greatest(F.col("_need").cast("int") - F.size(ahead), F.lit(0))))
    far = asked.select("from_id", F.explode(F.transform(F.concat(ahead, behind), lambda x: x["to_id"])).alias("to_id")).where("from_id <> to_id").distinct()
    far = far.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    w = Window.partitionBy("from_id").orderBy(mix(F.col("from_id"), F.col("to_id"), seed), "to_id")
    return far.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < n).select("from_id", "slot", "to_id")


def pruned(edges: DataFrame, patience: int) -> DataFrame:
    """Edges that stay: those whose confidence is above -patience, slots closed up."""
    w = Window.partitionBy("from_id").orderBy("slot")
    return edges.where(F.col("confidence") > -patience).withColumn("slot", F.row_number().over(w) - 1)


def promoted(kept: DataFrame, candidates: DataFrame, max_degree: int) -> DataFrame:
    """(from_id, slot, to_id, confidence 0): the best-scored candidates for all free slots of each vertex.

    ``candidates`` has from_id, slot, to_id, prob; better ones first, ties by slot.
    """
    degree = kept.groupBy("from_id").agg(F.count(F.lit(1)).alias("d"))
    new = candidates.join(kept.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").join(degree, "from_id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    new = new.withColumn("r", F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("prob"), "slot")))
    return new.where(F.col("r") <= max_degree - F.col("d")).select("from_id", (F.col("d") + F.col("r") - 1).alias("slot"), "to_id", F.lit(0.0).alias("confidence"))


def evolved(edges: DataFrame, candidates: DataFrame, patience: int, max_degree: int) -> DataFrame:
    """One step of topology evolution: prune, then promote."""
    kept = pruned(edges, patience).select("from_id", "slot", "to_id", F.col("confidence").cast("double").alias("confidence"))
    return kept.unionByName(promoted(kept, candidates, max_degree))


def exported(edges: DataFrame, vertices: DataFrame, patience: int) -> DataFrame:
    """(id, neighbors) of the final graph: edges kept greedily or frozen in, less those frozen out."""
    keep = ((F.col("prob") > 0.5) | (F.col("confidence") == patience)) & (F.col("confidence") != -patience)
    return adjacency(edges.where(keep), vertices)


def edge_batches(edges: DataFrame, batch_size: int) -> DataFrame:
    """(from_id, degree, batch): whole vertices, in order, until a batch has ``batch_size`` edges.

    A batch ends with the vertex that fills it, so its number depends on all
    before. Vertices are cut into ranges; each range tells in one pass what it
    makes of any number of edges that are open before it (how many batches end,
    how many edges are open after), in runs of equal outcome. Following these
    from the first range gives each its start, and ranges then number themselves.
    """
    size = max(batch_size, 1)  # a vertex fills smaller ones

    def outcomes(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        sums = np.r_[0, np.cumsum(rows.column("degree").to_numpy())]
        m = len(sums) - 1
        end = np.minimum(np.searchsorted(sums, sums[:-1] + size), m + 1)  # first vertex behind a batch that begins here
        ended, left = [0] * (m + 1), [0] * (m + 1)
        for s in range(m - 1, -1, -1):
            e = int(end[s])
            ended[s], left[s] = (0, int(sums[m] - sums[s])) if e > m else (1 + ended[e], left[e])
        runs = [(0, 0, int(sums[m]), True)] if sums[m] < size else []  # nothing ends; what is open stays open
        for j in range(m, 0, -1):  # open edges from size - sums[j] on end a batch with vertex j
            low = max(int(size - sums[j]), 0)
            if low < size - sums[j - 1]:
                told = (low, 1 + ended[j], left[j], False)
                if not runs or runs[-1][1:] != told[1:]:
                    runs.append(told)
        n = len(runs)
        return pa.table({"_range": pa.array([rows.column("_range")[0].as_py()] * n, pa.int32()), **{c: pa.array([r[i] for r in runs], pa.bool_() if c == "open" else pa.int64()) for i, c in enumerate(("low", "ended", "left", "open"))}})

    deg = edges.groupBy(F.col("from_id").cast("long").alias("from_id")).agg(F.count(F.lit(1)).alias("degree"))
    dealt = ranks.ordered(deg, "from_id")
    maps = dealt.groupBy("_range").applyInArrow(outcomes, "_range int, low long, ended long, left long, open boolean")
    starts, batch, held, at, hit = [], 0, 0, None, None
    for r in [*maps.orderBy("_range", "low").toLocalIterator(), None]:  # a few runs a range, one part at a time
        if r is None or r["_range"] != at:
            if hit is not None:
                batch, held = batch + hit["ended"], hit["left"] + (held if hit["open"] else 0)
            if r is None:
                break
            at, hit = r["_range"], None
            starts.append((at, batch, held))
        if r["low"] <= held:
            hit = r
    first = edges.sparkSession.createDataFrame(starts, "_range int, _batch long, _held long")

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        sums = np.cumsum(rows.column("degree").to_numpy())
        batch, told, i, base = rows.column("_batch")[0].as_py(), np.empty(len(sums), np.int32), 0, -rows.column("_held")[0].as_py()
        while i < len(sums):
            j = int(np.searchsorted(sums, base + size))
            told[i : j + 1] = batch
            if j < len(sums):
                batch, base = batch + 1, int(sums[j])
            i = j + 1
        return rows.select(["from_id", "degree"]).append_column("batch", pa.array(told))

    return dealt.join(F.broadcast(first), "_range").groupBy("_range").applyInArrow(number, "from_id long, degree long, batch int")


def _styled(rows: DataFrame, keys: list[str], style: dict, hover: list[str], defaults: dict) -> DataFrame:
    """``rows`` with a column for each style, a column expression or one value for all; null gives the default."""
    shown = {n: style.get(n, v) for n, v in defaults.items()} | {n: v for n, v in style.items() if n not in defaults}
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(*keys, *(F.coalesce(column(v), F.lit(defaults[n])).alias(n) if n in defaults else column(v).alias(n) for n, v in shown.items()), *(c for c in hover if c not in keys))


def plot_tables(edges: DataFrame, points: DataFrame, edge_style: dict | None = None, vertex_style: dict | None = None, hover: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, vertices): one row for each edge with both ends, one for each vertex, with their styles.

    A style is one value for all or a column of ``edges`` (``points``), so it may
    differ by edge or vertex; ``hover`` names columns of ``points`` to show with a vertex.
    """
    a, b = points.select(F.col("id").alias("from_id"), F.col("x").alias("x0"), F.col("y").alias("y0")), points.select(F.col("id").alias("to_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    ends = edges.join(a, "from_id").join(b, "to_id")
    segments = _styled(ends, ["from_id", "to_id", "x0", "y0", "x1", "y1"], edge_style or {}, [], {"color": "#aaaaaa", "alpha": 1.0, "width": 1.0})
    return segments, _styled(points, ["id", "x", "y"], vertex_style or {}, hover or [], {"color": "#1f77b4", "marker": "circle", "radius": 10.0, "alpha": 0.25})
