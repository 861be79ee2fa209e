"""Beam search over a proximity graph, many queries in parallel.

The kernel keeps the ``ef`` nearest visited vertices; each hop expands the
nearest one not expanded yet and admits its unvisited neighbours that the edge
policy lets through. It stops when all are expanded or at the hop cap. A pruned
neighbour isn't visited, so another vertex may still reach it; edges of
probability above 1 are traversed without leaving a sample, below 0 never.
Order is total: by distance, then id.

A graph whose measured size is at most ``SMALL`` is packed by tasks and
broadcast; a batch of queries steps through it together, hop by hop, in numpy.
Each Python worker holds one copy of the graph and VISITED bytes for its batch.
Larger graphs are searched by :func:`frontier_search`, which joins the frontiers
of all queries and widths with edges and vectors, hop by hop.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from simloom.functions import vectors as V
from simloom.plans import durable

SMALL, VISITED = 256 << 20, 64 << 20
SAMPLES = "array<struct<hop:int,slot:int,from_id:long,to_id:long,action:int>>"
SESSION = f"query_id long, best_ids array<long>, dcs int, hops int, trajectory array<long>, samples {SAMPLES}"


@dataclass
class PackedGraph:
    """Vectors by id, and neighbours with probabilities by vertex, as arrays."""

    vectors: np.ndarray
    begin: np.ndarray
    neighbors: np.ndarray
    slots: np.ndarray
    probs: np.ndarray

    @classmethod
    def collect(cls, vertices: DataFrame, edges: DataFrame) -> "PackedGraph":
        """From vertices(id dense from 0, vec) and edges(from_id, slot, to_id[, prob])."""
        prob = F.col("prob") if "prob" in edges.columns else F.lit(2.0)
        ids, flat = _packed_columns(vertices.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")))
        x = np.zeros((len(ids), len(flat) // max(len(ids), 1)))
        x[ids] = flat.reshape(x.shape)
        start, slot, to, p = _packed_columns(edges.select(*(F.col(c).cast("long") for c in ("from_id", "slot", "to_id")), prob.cast("double").alias("prob")))
        order = np.lexsort((slot, start))
        return cls(x, np.searchsorted(start[order], np.arange(len(ids) + 1)), to[order], slot[order], p[order])


def _packed_columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small table, long, double or lists of double, as arrays that tasks have packed."""
    names, kinds = df.columns, [np.int64 if t == "bigint" else np.float64 for _, t in df.dtypes]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [c.flatten() if pa.types.is_list(c.type) else c for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).tobytes()], pa.binary()) for c in held], names)

    got = df.mapInArrow(pack, ", ".join(f"`{c}` binary" for c in names)).toArrow()
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in got.column(c))]) for c, kind in zip(names, kinds, strict=True)]


def enter(vertices: DataFrame, levels: DataFrame, queries: DataFrame, start: int = 0, metric: str = "l2") -> DataFrame:
    """(query_id, enter): where a greedy walk down ``levels`` (level, from_id, to_id), lowest number first, ends for each query.

    On a level the walk moves to the nearest neighbour, of equal ones the smaller
    id, while that is strictly nearer. Only vertices of the levels travel; where
    they are too many to broadcast, each move of all queries is a join.
    """
    ends = levels.select(F.explode(F.array("from_id", "to_id")).alias("id")).unionByName(levels.sparkSession.createDataFrame([(start,)], "id long")).distinct()
    points = vertices.join(ends, "id").select(F.col("id").cast("long"), F.col("vec").cast("array<double>"))
    names = [r[0] for r in levels.select("level").distinct().orderBy("level").collect()]
    asked = queries.select(F.col("id").cast("long"), F.col("vec").cast("array<double>"))
    n, dim = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if n * dim * 8 + levels.count() * 24 > SMALL:
        return _enter_by_joins(points, levels, asked, names, start, metric)
    ids, flat = _packed_columns(points)
    order = np.argsort(ids)
    ids, x = ids[order], flat.reshape(len(ids), -1)[order]
    at, frm, to = _packed_columns(levels.select(*(F.col(c).cast("long") for c in ("level", "from_id", "to_id"))))
    parts = []
    for name in names:
        a, b = (np.searchsorted(ids, e[at == name]) for e in (frm, to))
        o = np.lexsort((b, a))
        parts.append((np.searchsorted(a[o], np.arange(len(ids) + 1)), b[o]))
    held = levels.sparkSession.sparkContext.broadcast((ids, x, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, parts = held.value
        for batch in batches:
            q = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, x.shape[1]))
            near = lambda r, v: -(x[v] * q[r]).sum(1) if metric == "dot" else ((x[v] - q[r]) ** 2).sum(1)  # noqa: E731, B023
            pos = np.full(len(q), np.searchsorted(ids, start))
            best = near(np.arange(len(q)), pos)
            for begin, neighbors in parts:
                rows = np.arange(len(q))
                while len(rows):
                    degree = begin[pos[rows] + 1] - begin[pos[rows]]
                    own = np.repeat(rows, degree)
                    v = neighbors[np.arange(len(own)) + np.repeat(begin[pos[rows]] - np.cumsum(degree) + degree, degree)]
                    d = near(own, v)
                    o = np.lexsort((v, d, own))
                    own, v, d = own[o], v[o], d[o]
                    first = np.r_[True, own[1:] != own[:-1]][: len(own)] & (d < best[own])
                    rows = own[first]
                    pos[rows], best[rows] = v[first], d[first]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[pos])], ["query_id", "enter"])

    return asked.mapInArrow(run, "query_id long, enter long")


def _enter_by_joins(points: DataFrame, levels: DataFrame, queries: DataFrame, names: list, start: int, metric: str) -> DataFrame:
    """The same walks; each move is a written table of all queries' places."""
    point = points.select(F.col("id").alias("to_id"), F.col("vec").alias("x"))
    begin = points.where(F.col("id") == start).select(F.col("vec").alias("x"))
    state = queries.select(F.col("id").alias("query_id"), "vec").join(F.broadcast(begin), F.lit(True))
    state = durable.table(state.select("query_id", "vec", F.lit(start).cast("long").alias("pos"), V.distance("vec", "x", metric).alias("best"), F.lit(True).alias("moved")), "walk")
    for name in names:
        edges = levels.where(F.col("level") == name).select("from_id", "to_id")
        state_of, moving = state, True
        while moving:
            live = state_of.where("moved")
            met = live.join(edges, F.col("pos") == F.col("from_id")).join(point, "to_id")
            best = met.groupBy("query_id").agg(F.min(F.struct(V.distance("vec", "x", metric).alias("d"), F.col("to_id").alias("v"))).alias("b"))
            nxt = state_of.join(best, "query_id", "left").withColumn("moved", F.col("moved") & F.coalesce(F.col("b.d") < F.col("best"), F.lit(False)))
            nxt = nxt.select("query_id", "vec", F.when(F.col("moved"), F.col("b.v")).otherwise(F.col("pos")).alias("pos"), F.when(F.col("moved"), F.col("b.d")).otherwise(F.col("best")).alias("best"), "moved")
            new = durable.table(nxt, "walk")
            durable.drop(state)
            state = state_of = new
            moving = bool(state.where("moved").limit(1).count())
        state_of = state = _again(state)
    return state.select("query_id", F.col("pos").alias("enter"))


def _again(state: DataFrame) -> DataFrame:
    """All queries on their way again, on the next level."""
    new = durable.table(state.withColumn("moved", F.lit(True)), "walk")
    durable.drop(state)
    return new


def lists_of(owner: np.ndarray, n: int, *columns) -> pa.ListArray:
    """An Arrow list for each of ``n`` owners, of values or of structs (name, values, type), in the order they come."""
    order = np.argsort(owner, kind="stable")
    at = pa.array(np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32))
    arrays = [pa.array(v[order], kind) for _, v, kind in columns]
    return pa.ListArray.from_arrays(at, arrays[0] if len(arrays) == 1 else pa.StructArray.from_arrays(arrays, [c for c, *_ in columns]))


def search_batch(g: PackedGraph, ids: np.ndarray, q: np.ndarray, start: int, ef: int, k: int, max_trajectory: int, metric: str, seed: int) -> pa.RecordBatch:
    """Sessions of a batch of queries, which take each hop together: answers, distance computations, hops, trajectory and samples."""
    m, n = len(ids), len(g.vectors)
    near = lambda rows, to: -(g.vectors[to] * q[rows]).sum(1) if metric == "dot" else ((g.vectors[to] - q[rows]) ** 2).sum(1)
    each = np.arange(m)
    dist, top, open_ = np.full((m, ef), np.inf), np.full((m, ef), n), np.zeros((m, ef), bool)
    dist[:, 0], top[:, 0], open_[:, 0] = near(each, np.full(m, start)), start, True
    visited = np.zeros((m, n), bool)
    visited[:, start] = True
    dcs, path, taken = np.ones(m, np.int32), [], []
    for hop in range(max_trajectory):
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        place = open_[rows].argmax(1)
        at = top[rows, place]
        open_[rows, place] = False
        path.append((rows, at))
        degree = g.begin[at + 1] - g.begin[at]
        own = np.repeat(np.arange(len(rows)), degree)
        e = np.arange(len(own)) + np.repeat(g.begin[at] - np.cumsum(degree) + degree, degree)
        own, e = (x[~visited[rows[own], g.neighbors[e]] & (g.probs[e] >= 0)] for x in (own, e))
        to, slot, prob = g.neighbors[e], g.slots[e], g.probs[e]
        u = ((ids[rows[own]] * 7919 + hop * 104729 + slot * 1299709 + seed * 15485863) % 1000003 + 0.5) / 1000003
        go = prob > u
        key = own * n + to
        order = np.argsort(key, kind="stable")
        if (np.diff(key[order]) == 0).any():  # of edges to one vertex those after the first that is taken don't count
            first = np.r_[True, np.diff(key[order]) != 0]
            before = np.cumsum(go[order]) - go[order]
            free = np.empty(len(key), bool)
            free[order] = before == np.maximum.accumulate(np.where(first, before, 0))
            own, to, slot, prob, go = (x[free] for x in (own, to, slot, prob, go))
        some = prob <= 1
        taken.append((rows[own[some]], np.full(some.sum(), hop), slot[some], at[own[some]], to[some], go[some]))
        own, to = own[go], to[go]
        visited[rows[own], to] = True
        many = np.bincount(own, minlength=len(rows))
        dcs[rows] += many.astype(np.int32)
        wide = (len(rows), ef + int(many.max(initial=0)))
        d, v, o = np.full(wide, np.inf), np.full(wide, n), np.zeros(wide, bool)
        d[:, :ef], v[:, :ef], o[:, :ef] = dist[rows], top[rows], open_[rows]
        col = ef + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        d[own, col], v[own, col], o[own, col] = near(rows[own], to), to, True
        best = np.lexsort((v, d), axis=1)[:, :ef]
        dist[rows], top[rows], open_[rows] = (np.take_along_axis(x, best, 1) for x in (d, v, o))
    flat = lambda parts, i: np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64)
    answer = top[:, :k] < n
    long, short = pa.int64(), pa.int32()
    owner = flat(path, 0)
    told = {
        "query_id": pa.array(ids),
        "best_ids": lists_of(np.repeat(each, answer.sum(1)), m, ("id", top[:, :k][answer], long)),
        "dcs": pa.array(dcs),
        "hops": pa.array(np.bincount(owner, minlength=m).astype(np.int32)),
        "trajectory": lists_of(owner, m, ("id", flat(path, 1), long)),
        "samples": lists_of(flat(taken, 0), m, *((c, flat(taken, i + 1), kind) for i, (c, kind) in enumerate((("hop", short), ("slot", short), ("from_id", long), ("to_id", long), ("action", short))))),
    }
    return pa.RecordBatch.from_arrays(list(told.values()), list(told))


def search(vertices: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 1, ef: int = 1, max_trajectory: int = 80, initial_vertex_id: int = 0, metric: str = "auto", seed: int = 0) -> DataFrame:
    """sessions(query_id, best_ids, dcs, hops, trajectory, samples) of every query (id, vec).

    Edges without column ``prob`` are always traversed and leave no samples.
    """
    if k > ef:
        raise ValueError("k is at most ef")
    metric, fits = _plan(vertices, edges, metric)
    found = (_packed if fits else frontier_search)(vertices, edges, queries, [ef], k, max_trajectory, initial_vertex_id, metric, seed)
    return found.drop("ef")


def _plan(vertices: DataFrame, edges: DataFrame, metric: str) -> tuple[str, bool]:
    """The metric, and whether the measured graph may be broadcast."""
    n, dim = vertices.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    return ("dot" if dim == 300 else "l2") if metric == "auto" else metric, n * dim * 8 + edges.count() * 32 <= SMALL


def _packed(vertices: DataFrame, edges: DataFrame, queries: DataFrame, efs: list[int], k: int, max_trajectory: int, initial_vertex_id: int, metric: str, seed: int) -> DataFrame:
    """Sessions of every query for each width, with column ef, over one broadcast graph."""
    spark: SparkSession = vertices.sparkSession
    held = spark.sparkContext.broadcast(PackedGraph.collect(vertices, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        together = max(1, min(256, VISITED // max(len(g.vectors), 1)))
        for batch in batches:
            ids = batch.column("id").to_numpy()
            q = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            for i in range(0, len(ids), together):
                for ef in efs:
                    out = search_batch(g, ids[i : i + together], q[i : i + together], initial_vertex_id, ef, k, max_trajectory, metric, seed)
                    yield out.append_column("ef", pa.array(np.full(out.num_rows, ef, np.int32)))

    parallel = queries.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).repartition(spark.sparkContext.defaultParallelism)
    return parallel.mapInArrow(run, SESSION + ", ef int")


SALTS, TRACKED = 64, 100
OFF = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def _one_job(spark: SparkSession) -> Iterator[None]:
    """Every action inside is one job: no adaptive stages, no broadcasts of their own."""
    before = {k: spark.conf.get(k) for k in OFF}
    try:
        for k, v in OFF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _tops(key: str, live: Column) -> Column:
    """The most frequent values of ``key`` among ``live`` rows, told while a table is written."""
    return F.to_json(F.call_function("approx_top_k", F.when(live, F.col(key)), F.lit(TRACKED), F.lit(10000)))


def _hot(told: str | None, rows: int) -> list[int]:
    """The values that hold more than a TRACKED-th of the rows, TRACKED at most."""
    return [x["item"] for x in json.loads(told or "[]") if "item" in x and x["count"] * TRACKED > rows]


def _met(rows: DataFrame, table: DataFrame, key: str, by: list[str], hot: list[int]) -> DataFrame:
    """``rows`` joined with ``table``, which is bucketed by id; rows of ``hot`` keys are spread over SALTS places."""
    cold = rows.where(~F.col(key).isin(hot)) if hot else rows
    out = cold.join(table, F.col(key) == F.col("id"), "left").drop("id")
    if hot:
        spread = rows.where(F.col(key).isin(hot)).withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
        few = table.where(F.col("id").isin(hot)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.unionByName(spread.join(few, (F.col(key) == F.col("id")) & (F.col("_salt") == F.col("_s")), "left").drop("id", "_s", "_salt"))
    return out


def frontier_search(vertices: DataFrame, edges: DataFrame, queries: DataFrame, efs: list[int], k: int, max_trajectory: int, initial_vertex_id: int = 0, metric: str = "l2", seed: int = 0) -> DataFrame:
    """The same sessions, with column ef, for graphs too large to broadcast; returned as a written table.

    Adjacency lists and vectors are written once, bucketed by id, so hops move
    sessions and not the graph. A hop of all queries and widths is two jobs: one
    meets the lists and logs every decision, one meets the vectors and writes the
    sessions' next state, apart for those that are finished, which are not read
    again until the end. Vertices that many sessions are at, as all are at first,
    are told while the state is written, and the sessions there are spread.
    """
    spark = vertices.sparkSession
    folder, names = f"{durable.shared_dir(spark)}/simloom/frontier-{uuid.uuid4().hex}", {}
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        names[name] = f"simloom_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, "id").sortBy("id").option("path", f"{folder}/{name}").saveAsTable(names[name])
        return spark.table(names[name])

    prob = F.col("prob") if "prob" in edges.columns else F.lit(2.0)
    by = ["query_id", "ef"]
    states: list[str] = []
    logs: list[str] = []
    try:
        lists = edges.groupBy(F.col("from_id").cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("to_id").cast("long").alias("to_id"), prob.cast("double").alias("prob")))).alias("out"))
        adjacency = bucketed(lists, "adjacency")
        points = bucketed(vertices.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("x")), "points")
        begin = vertices.where(F.col("id") == initial_vertex_id).select(F.col("vec").alias("x"))
        first = F.array(F.struct(V.distance("vec", "x", metric).alias("d"), F.lit(initial_vertex_id).cast("long").alias("id"), F.lit(False).alias("done")))
        state = queries.select(F.col("id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"), F.explode(F.array(*map(F.lit, efs))).alias("ef")).join(F.broadcast(begin), F.lit(True))
        at = F.get(F.filter("top", lambda t: ~t["done"]), F.lit(0))["id"]
        state = state.select(*by, "vec", first.alias("top"), F.array(F.lit(initial_vertex_id).cast("long")).alias("seen"), F.lit(1).alias("dcs"), at.alias("at"))
        kind, live, hot = state.schema, 1, [initial_vertex_id]

        def write(df: DataFrame, hop: int) -> tuple[int, list[int]]:
            told = Observation()
            path = f"{folder}/state{hop}"
            df = df.withColumn("live", F.col("at").isNotNull())
            df.observe(told, F.sum(F.col("live").cast("long")).alias("n"), _tops("at", F.col("live")).alias("top")).write.partitionBy("live").parquet(path)
            if states:
                durable.remove(spark, f"{states[-1]}/live=true")
            states.append(path)
            n = told.get["n"] or 0
            return n, _hot(told.get["top"], n)

        live, hot = write(state, 0)
        for hop in range(max_trajectory):
            if not live:
                break
            now = spark.read.schema(kind).parquet(f"{states[-1]}/live=true")
            u = lambda s: V.uniform(F.col("query_id"), F.lit(hop), s["slot"], seed)  # noqa: E731, B023
            step = _met(now.select(*by, "seen", "at"), adjacency, "at", by, hot)
            # of edges to one vertex those after the first that is taken don't count
            free = F.filter(F.coalesce("out", F.array().cast("array<struct<slot:int,to_id:long,prob:double>>")), lambda s: (s["prob"] >= 0))
            new = F.array_except(F.transform("free", lambda s: s["to_id"]), "seen")
            step = step.withColumn("free", free).withColumn("new", new)
            step = step.withColumn("free", F.filter("free", lambda s: F.array_contains("new", s["to_id"])))
            step = step.withColumn("free", F.when(F.size("free") == F.size("new"), F.col("free")).otherwise(F.filter("free", lambda s: ~F.exists("free", lambda t: (t["to_id"] == s["to_id"]) & (t["slot"] < s["slot"]) & (t["prob"] > u(t))))))
            told = F.transform("free", lambda s: F.struct(s["slot"].alias("slot"), s["to_id"].alias("to_id"), (s["prob"] <= 1).alias("sampled"), (s["prob"] > u(s)).cast("int").alias("action")))
            log = step.select(*by, F.lit(hop).alias("hop"), F.col("at").alias("from_id"), F.inline_outer(told))
            seen_most = Observation()
            path = f"{folder}/log{hop}"
            with _one_job(spark):
                log.observe(seen_most, F.count("to_id").alias("n"), _tops("to_id", F.col("action") == 1).alias("top")).write.parquet(path)
                logs.append(path)
                goes = spark.read.schema(log.schema).parquet(path).where("action = 1").select(*by, "to_id")
                found = _met(goes, points, "to_id", by, _hot(seen_most.get["top"], seen_most.get["n"]))
                found = found.groupBy(*by).agg(F.collect_list(F.struct("to_id", "x")).alias("go"))  # the degree of a vertex
                marked = F.transform("top", lambda t: F.struct(t["d"].alias("d"), t["id"].alias("id"), (t["done"] | (t["id"] == F.col("at"))).alias("done")))
                reached = F.transform(F.coalesce("go", F.array().cast("array<struct<to_id:long,x:array<double>>>")), lambda g: F.struct(V.distance(F.col("vec"), g["x"], metric).alias("d"), g["to_id"].alias("id"), F.lit(False).alias("done")))
                nxt = now.join(found, by, "left").withColumn("top", F.slice(F.sort_array(F.concat(marked, reached)), 1, F.col("ef")))
                ids = F.coalesce(F.transform("go", lambda g: g["to_id"]), F.array().cast("array<long>"))
                nxt = nxt.select(*by, "vec", "top", F.concat("seen", ids).alias("seen"), (F.col("dcs") + F.size(ids)).alias("dcs"), at.alias("at"))
                live, hot = write(nxt, hop + 1)
        ended = [f"{p}/live=false" for p in states] + [f"{states[-1]}/live=true"]
        parts = [p for p in ended if durable.exists(spark, p)]
        last = spark.read.schema(kind).parquet(*parts) if parts else spark.createDataFrame([], kind)
        best = F.slice(F.transform("top", lambda t: t["id"]), 1, k)
        out = last.select(*by, best.alias("best_ids"), "dcs")
        if logs:
            every = spark.read.schema(log.schema).parquet(*logs)
            way = F.transform(F.array_sort(F.collect_set(F.struct("hop", "from_id"))), lambda s: s["from_id"])
            drawn = F.array_sort(F.collect_list(F.when(F.col("sampled"), F.struct("hop", "slot", "from_id", "to_id", "action"))))
            out = out.join(every.groupBy(*by).agg(way.alias("trajectory"), drawn.alias("samples")), by, "left")
        else:
            out = out.withColumns({"trajectory": F.lit(None).cast("array<long>"), "samples": F.lit(None).cast(SAMPLES)})
        path, samples = F.coalesce("trajectory", F.array().cast("array<long>")), F.coalesce("samples", F.array().cast(SAMPLES))
        return durable.table(out.select("query_id", "best_ids", "dcs", F.size(path).alias("hops"), path.alias("trajectory"), samples.alias("samples"), "ef"), "sessions")
    finally:
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        durable.remove(spark, folder)


def samples_of(sessions: DataFrame) -> DataFrame:
    """(query_id, hop, slot, from_id, to_id, action): the decisions that training uses."""
    return sessions.select("query_id", F.inline("samples"))


def sweep(vertices: DataFrame, edges: DataFrame, queries: DataFrame, efs: list[int], k: int = 1, max_trajectory: int = 80, initial_vertex_id: int = 0, metric: str = "auto", seed: int = 0) -> DataFrame:
    """Sessions for each beam width, with column ef; the graph is collected, or written, once for all widths."""
    if k > min(efs):
        raise ValueError("k is at most ef")
    metric, fits = _plan(vertices, edges, metric)
    return (_packed if fits else frontier_search)(vertices, edges, queries, efs, k, max_trajectory, initial_vertex_id, metric, seed)


__all__ = ["SESSION", "PackedGraph", "enter", "frontier_search", "samples_of", "search", "search_batch", "sweep"]
