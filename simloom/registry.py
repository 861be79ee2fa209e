"""All queries of the similarity-graph engine and their DuckDB SQL.

The vectors of ``embeddings`` take roles by vec_id % 10: 0 test queries, 1 to 3
learn queries, the rest vertices; ids are dense in order of vec_id. The initial
graph is the exact 8-nearest-neighbour graph of the vertices.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import policy, vectors as V
from simloom.operators import beam, edges as E, knn, learning as L, training
from simloom.operators.engine import SessionEngine
from simloom.plans import dataset, durable
from simloom.plans.experiment import Experiment
from simloom.session import read
from simloom.sources import vecs

DEGREE, PATIENCE, HIDDEN = 8, 3, 4
WIDTHS = range(12, 121, 4)  # of the beam-width sweep


_HELD: dict[tuple, DataFrame] = {}


def held(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries start from, written once for each state of the data in ``sf``."""
    key = (spark.sparkContext.applicationId, sf, name, durable.changed(spark, f"{sf.rstrip('/')}/embeddings.parquet"))
    if key not in _HELD or not durable.exists(spark, _HELD[key]._written):
        _HELD[key] = durable.table(make(), name)
    return _HELD[key]


def role(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """(id, vec) of the vertices, the learn or the test queries."""
    m = F.col("vec_id") % 10
    keep = {"base": m >= 4, "learn": (m >= 1) & (m <= 3), "test": m == 0}[which]
    rows = lambda: read(spark, sf, "embeddings").where(keep).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return held(spark, sf, which, lambda: dataset.dense_ids(rows()).select("id", "vec"))


def graph(spark: SparkSession, sf: str) -> DataFrame:
    return held(spark, sf, "graph", lambda: knn.knn_graph(role(spark, sf, "base"), DEGREE))


def truth(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    near = held(spark, sf, f"near{k}", lambda: knn.nearest(role(spark, sf, "base"), role(spark, sf, "test"), k))
    return near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vertex_id"))), lambda x: x["vertex_id"]).alias("truth"))


def r6(c) -> F.Column:
    return F.round(V.col(c), 6)


# Arithmetic stand-ins for learned state, equal in both engines.
def state_of(e: DataFrame) -> DataFrame:
    """Edges with a probability and a confidence worked out from their ids."""
    n = F.col("from_id") * 31 + F.col("to_id") * 17
    p = F.when(n % 11 == 0, F.lit(0.99995)).when(n % 11 == 1, F.lit(0.00005)).otherwise((n % 100) / 100.0)
    return e.withColumn("prob", p).withColumn("confidence", ((F.col("from_id") * 13 + F.col("to_id") * 7) % 7 - 3).cast("double"))


STATE = "CASE WHEN (from_id*31+to_id*17) % 11 = 0 THEN 0.99995 WHEN (from_id*31+to_id*17) % 11 = 1 THEN 0.00005 ELSE ((from_id*31+to_id*17) % 100) / 100.0 END::DOUBLE AS prob, ((from_id*13+to_id*7) % 7 - 3)::DOUBLE AS confidence"


def action_prob(e: DataFrame) -> DataFrame:
    """Edges with probabilities of which some are frozen (1.1 and -0.1)."""
    n = F.col("from_id") * 31 + F.col("to_id") * 17
    return e.withColumn("prob", F.when(n % 20 == 0, F.lit(1.1)).when(n % 20 == 1, F.lit(-0.1)).otherwise((n % 100) / 100.0))


ACTION = "CASE WHEN (from_id*31+to_id*17) % 20 = 0 THEN 1.1 WHEN (from_id*31+to_id*17) % 20 = 1 THEN -0.1 ELSE ((from_id*31+to_id*17) % 100) / 100.0 END::DOUBLE AS prob"


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training samples worked out from the edges: session_index, query_id, from_id, to_id, action, reward, logp, old_logp, freqs."""
    e = graph(spark, sf)
    n = F.col("from_id") * 3 + F.col("to_id") * 5 + F.col("slot")
    return e.select(
        (F.col("from_id") % 40).alias("session_index"), "from_id", F.col("to_id"), "slot", (n % 2).cast("int").alias("action"), ((n % 13) / 4.0).alias("advantage"),
        (0.1 + (n % 17) / 20.0).alias("p_new"), (0.1 + (n % 19) / 22.0).alias("p_old"), (1 + n % 5).alias("freqs"),
    )


SAMPLES = "samples AS (SELECT from_id % 40 AS session_index, from_id, to_id, slot, ((from_id*3+to_id*5+slot) % 2)::INT AS action, ((from_id*3+to_id*5+slot) % 13) / 4.0::DOUBLE AS advantage, 0.1::DOUBLE + ((from_id*3+to_id*5+slot) % 17) / 20.0::DOUBLE AS p_new, 0.1::DOUBLE + ((from_id*3+to_id*5+slot) % 19) / 22.0::DOUBLE AS p_old, 1 + (from_id*3+to_id*5+slot) % 5 AS freqs FROM edges)"

PRE = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS vec, vec_id % 10 AS m FROM embeddings),
base AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec FROM e WHERE m >= 4),
learn AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec FROM e WHERE m BETWEEN 1 AND 3),
test AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec FROM e WHERE m = 0),
edges AS MATERIALIZED (SELECT from_id, rk - 1 AS slot, to_id FROM (SELECT a.id AS from_id, b.id AS to_id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rk FROM base a JOIN base b ON a.id <> b.id) WHERE rk <= 8),
near AS MATERIALIZED (SELECT * FROM (SELECT q.id AS query_id, b.id AS vertex_id, list_distance(q.vec, b.vec) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, b.vec), b.id) - 1 AS rank FROM test q JOIN base b ON true) WHERE rank < 10),
truth AS (SELECT query_id, list(vertex_id ORDER BY rank) AS truth FROM near GROUP BY query_id),
"""
TWO = "two AS (SELECT DISTINCT a.from_id, b.to_id FROM edges a JOIN edges b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id AND NOT EXISTS (SELECT 1 FROM edges c WHERE c.from_id = a.from_id AND c.to_id = b.to_id)), virtual AS (SELECT from_id, row_number() OVER (PARTITION BY from_id ORDER BY (from_id*7919+to_id*104729) % 1000003, to_id) - 1 AS slot, to_id FROM two)"


def beam_sql(ef: str, cap: int = 80, prob: str = "2.0::DOUBLE AS prob") -> str:
    """The search as a recursion over one row a query; ``ef`` may be a column of the starting rows."""
    return f"""adj AS MATERIALIZED (SELECT from_id, list({{'slot': slot, 'id': to_id, 'p': prob, 'vec': vec}} ORDER BY slot) AS nb FROM (SELECT from_id, slot, to_id, {prob} FROM edges) x JOIN base ON base.id = x.to_id GROUP BY from_id),
starts AS (SELECT t.id AS query_id, t.vec AS q, ef FROM test t, (SELECT unnest([{ef}]) AS ef)),
walk AS (
  SELECT query_id, q, ef, 0 AS hop, [{{'d': list_distance(q, b.vec), 'id': b.id, 'x': false}}] AS top, [b.id] AS seen, 1 AS dcs, []::BIGINT[] AS path, []::STRUCT(hop INTEGER, slot BIGINT, from_id BIGINT, to_id BIGINT, action INTEGER)[] AS taken FROM starts, base b WHERE b.id = 0
  UNION ALL
  SELECT query_id, q, ef, hop + 1,
    list_sort(list_concat(list_transform(top, lambda t: {{'d': t.d, 'id': t.id, 'x': t.x OR t.id = cur}}), list_transform(go, lambda n: {{'d': list_distance(q, n.vec), 'id': n.id, 'x': false}})))[1:ef],
    list_concat(seen, list_transform(go, lambda n: n.id)), dcs + len(go)::INT, list_append(path, cur),
    list_concat(taken, list_transform(list_filter(fresh, lambda n: n.p <= 1), lambda n: {{'hop': hop, 'slot': n.slot, 'from_id': cur, 'to_id': n.id, 'action': (n.p > ((query_id*7919 + hop*104729 + n.slot*1299709) % 1000003 + 0.5) / 1000003.0)::INT}}))
  FROM (SELECT *, list_filter(fresh, lambda n: n.p > ((query_id*7919 + hop*104729 + n.slot*1299709) % 1000003 + 0.5) / 1000003.0) AS go
    FROM (SELECT w.*, list_filter(coalesce(adj.nb, []), lambda n: NOT list_contains(w.seen, n.id) AND n.p >= 0) AS fresh
      FROM (SELECT *, list_filter(top, lambda t: NOT t.x)[1].id AS cur FROM walk WHERE hop < {cap}) w LEFT JOIN adj ON adj.from_id = w.cur WHERE w.cur IS NOT NULL))
),
sessions AS MATERIALIZED (SELECT query_id, ef, hop AS hops, dcs, list_transform(top, lambda t: t.id) AS ids, path, taken FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ef ORDER BY hop DESC) AS n FROM walk) WHERE n = 1)
"""


def found(spark: SparkSession, sf: str, k: int = 10, ef: int = 10, **options) -> DataFrame:
    return beam.search(role(spark, sf, "base"), graph(spark, sf), role(spark, sf, "test"), k=k, ef=ef, **options)


def with_truth(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).join(truth(spark, sf), "query_id")


def small_policy(dim: int) -> policy.EdgePolicy:
    """Weights worked out from their places."""
    i, j = np.meshgrid(np.arange(2 * dim), np.arange(HIDDEN), indexing="ij")
    w1 = ((i * 7 + j * 13) % 17 - 8) / 32
    a, b = np.meshgrid(np.arange(HIDDEN), np.arange(HIDDEN), indexing="ij")
    w2 = ((a * 5 + b * 3) % 7 - 3) / 4
    return policy.EdgePolicy(dim, HIDDEN, flat=np.concatenate([w1.ravel(), np.arange(HIDDEN) / 8 - 0.2, w2.ravel(), np.arange(HIDDEN) / 16 - 0.1, (np.arange(HIDDEN) - 1.5) / 2, [0.05]]))


POLICY = """pairs AS (SELECT from_id, slot, to_id, list_concat(a.vec, b.vec) AS x FROM edges JOIN base a ON a.id = from_id JOIN base b ON b.id = to_id),
l1 AS (SELECT *, list_transform(range(4), lambda j: list_sum(list_transform(range(len(x)), lambda i: x[i+1] * (((i*7 + j*13) % 17) - 8) / 32.0::DOUBLE)) + j / 8.0::DOUBLE - 0.2::DOUBLE) AS z1 FROM pairs),
l2 AS (SELECT *, list_transform(z1, lambda z: CASE WHEN z > 0 THEN z ELSE exp(z) - 1 END) AS a1 FROM l1),
l3 AS (SELECT *, list_transform(range(4), lambda j: list_sum(list_transform(range(4), lambda i: a1[i+1] * (((i*5 + j*3) % 7) - 3) / 4.0::DOUBLE)) + j / 16.0::DOUBLE - 0.1::DOUBLE) AS z2 FROM l2),
l4 AS (SELECT *, list_sum(list_transform(range(4), lambda i: (CASE WHEN z2[i+1] > 0 THEN z2[i+1] ELSE exp(z2[i+1]) - 1 END) * (i - 1.5::DOUBLE) / 2)) + 0.05::DOUBLE AS f FROM l3),
kept AS (SELECT from_id, slot, to_id, 1 - (1 / (1 + exp(-f)) * (1 - 2e-4) + 1e-4) AS prob FROM l4)"""


def _policy_edges(spark, sf, greedy=False):
    base = role(spark, sf, "base")
    dim = len(base.first()["vec"])
    return policy.keep_probabilities(graph(spark, sf), base, small_policy(dim), greedy)


def _roundtrip(spark: SparkSession, df: DataFrame, form: str, **options) -> DataFrame:
    folder = f"{vecs.local(durable.shared_dir(spark))}/simloom/files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    vecs.write(df, f"{folder}/x.{form}", form, part_bytes=1 << 16, **options)
    return vecs.read(spark, f"{folder}/x.{form}", form)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "learn").select(F.col("id").alias("step"), ((F.col("id") * 37 % 101) / 10.0).alias("reward"))


def _evolution(spark, sf):
    e = state_of(graph(spark, sf)).withColumn("confidence", F.when((F.col("from_id") + F.col("to_id")) % 5 == 0, F.lit(-3.0)).otherwise(F.col("confidence")))
    c = E.virtual_candidates(graph(spark, sf), 6).withColumn("prob", ((F.col("from_id") * 29 + F.col("to_id") * 23) % 97) / 97.0)
    return e, c


EVOLVE = "st AS (SELECT from_id, slot, to_id, CASE WHEN (from_id+to_id) % 5 = 0 THEN -3.0 ELSE ((from_id*13+to_id*7) % 7 - 3)::DOUBLE END AS confidence FROM edges), " + TWO + """, keep AS (SELECT from_id, row_number() OVER (PARTITION BY from_id ORDER BY slot) - 1 AS slot, to_id, confidence FROM st WHERE confidence > -3),
cand AS (SELECT v.from_id, v.slot, v.to_id, ((v.from_id*29+v.to_id*23) % 97) / 97.0 AS prob, coalesce(d, 0) AS d FROM virtual v LEFT JOIN (SELECT from_id, count(*) AS d FROM keep GROUP BY 1) k ON k.from_id = v.from_id WHERE v.slot < 6 AND NOT EXISTS (SELECT 1 FROM keep x WHERE x.from_id = v.from_id AND x.to_id = v.to_id)),
prom AS (SELECT from_id, d + r - 1 AS slot, to_id, 0.0::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY prob DESC, slot) AS r FROM cand) WHERE r <= 8 - d)"""


def _train(spark, sf, kind, **options):
    """One step on sessions over all learn queries, under a mean baseline."""
    base = role(spark, sf, "base")
    dim = len(base.first()["vec"])
    engine = SessionEngine(base, graph(spark, sf), k=1, ef=10, edge_patience=400)
    near = held(spark, sf, "learned1", lambda: knn.nearest(base, role(spark, sf, "learn"), 1)).select(F.col("query_id").alias("id"), F.array("vertex_id").alias("truth"))
    run = Experiment(engine, kind(policy.EdgePolicy(dim, 8, seed=1), **options), L.MeanBaseline(), V.reward_max_dcs)
    run.train_step(role(spark, sf, "learn").join(near, "id"))
    return run.metrics()


def _entry(spark, sf):
    """Greedy descent over two upper levels: the 4-nearest-neighbour graphs of every 16th and every 4th vertex."""
    base = role(spark, sf, "base")
    level = lambda i, step: knn.knn_graph(base.where(F.col("id") % step == 0), 4).select(F.lit(i).alias("level"), "from_id", "to_id")
    return beam.enter(base, level(0, 16).unionByName(level(1, 4)), role(spark, sf, "test"))


ENTRY = """lv AS (SELECT 0 AS level, 16 AS step UNION ALL SELECT 1, 4),
ring AS MATERIALIZED (SELECT level, a.id AS id, b.id AS nb FROM lv JOIN base a ON a.id % step = 0 JOIN base b ON b.id % step = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY level, a.id ORDER BY list_distance(a.vec, b.vec), b.id) <= 4),
hop AS (
  SELECT id AS query_id, vec AS q, 0 AS level, 0::BIGINT AS pos, 0 AS n FROM test
  UNION ALL
  SELECT query_id, q, CASE WHEN better THEN level ELSE level + 1 END, CASE WHEN better THEN nb ELSE pos END, n + 1 FROM (
    SELECT w.query_id, w.q, w.level, w.pos, w.n, r.nb, list_distance(w.q, b.vec) < list_distance(w.q, a.vec) AS better,
      row_number() OVER (PARTITION BY w.query_id ORDER BY list_distance(w.q, b.vec), r.nb) AS rk
    FROM hop w JOIN ring r ON r.level = w.level AND r.id = w.pos JOIN base b ON b.id = r.nb JOIN base a ON a.id = w.pos WHERE w.level < 2) WHERE rk = 1
)"""


def _batches(spark, sf):
    return E.edge_batches(graph(spark, sf), 50)


def _summary_sql(k10: bool) -> str:
    return "count(*) AS n_sessions, round(avg((ids[1] = truth[1])::INT), 6) AS recall_at_1, round(avg(dcs), 6) AS mean_dcs, round(avg(hops), 6) AS mean_hops, round(avg((ids[1] = truth[1])::INT / dcs), 6) AS recall_per_dcs" + (", round(avg(len(list_intersect(ids[1:10], truth[1:10])) / 10.0), 6) AS recall_at_10, round(avg(len(list_intersect(ids[1:10], truth[1:10])) / 10.0 / dcs), 6) AS recall_10_per_dcs" if k10 else "")


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sessions_flat(df: DataFrame, k: int) -> DataFrame:
    return df.select("query_id", F.posexplode(F.slice("best_ids", 1, k)).alias("rank", "vertex_id"), "dcs", "hops")


def _pairs(spark, sf, f):
    """The distance between the ends of every edge."""
    a, b = (role(spark, sf, "base").alias(x) for x in "ab")
    e = graph(spark, sf).join(a, F.col("from_id") == F.col("a.id")).join(b, F.col("to_id") == F.col("b.id"))
    return e.select("from_id", "to_id", r6(f(F.col("a.vec"), F.col("b.vec"))).alias("distance"))


def _normalized(spark, sf, how):
    (out,) = dataset.normalise(role(spark, sf, "base"), [], how)
    return out.select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", r6("x").alias("x"))


def _losses(spark, sf):
    s = sample_rows(spark, sf)
    p = lambda c, a: F.when(F.col("action") == 1, F.col(c)).otherwise(1 - F.col(c)) if a else F.col(c)
    return s.withColumn("logp", F.log(p("p_new", 1))).withColumn("old_logp", F.log(p("p_old", 1))).withColumn("advantages", F.col("advantage") - 1.5)


LOSS = "loss AS (SELECT *, ln(CASE WHEN action = 1 THEN p_new ELSE 1 - p_new END) - ln(CASE WHEN action = 1 THEN p_old ELSE 1 - p_old END) AS lr, advantage - 1.5 AS adv FROM samples)"


def _mean_baseline(spark, sf):
    b = L.MeanBaseline()
    for i in (1, 2, 3):  # of 43 sessions, three are without samples
        b.update(sample_rows(spark, sf).select("session_index", (F.col("advantage") * i).alias("reward")), 43)
    return spark.createDataFrame([(round(b.value, 6),)], "value double")


def _session_baseline(spark, sf):
    r = sample_rows(spark, sf).groupBy(F.col("session_index").alias("query_id")).agg(F.avg("advantage").alias("reward"))
    start = spark.range(50).select(F.col("id").alias("query_id"), F.lit(1.0).alias("value"), (F.col("id") >= 45).alias("updated"))
    return L.session_baseline(start, r, 0.25).withColumn("value", r6("value"))


def _colors(spark, sf):
    x = (F.col("id") * 7 % 11) / 10.0
    return role(spark, sf, "base").select("id", V.hex_color(F.array(x, (F.col("id") % 5) / 4.0, F.lit(0.25), F.lit(1.0))).alias("color"))


def _plot(spark, sf):
    pts = role(spark, sf, "base").select("id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    width = F.when(F.col("slot") < 3, F.col("slot") + 0.5)
    seg, _ = E.plot_tables(graph(spark, sf), pts, {"width": width, "color": "#111111"})
    return seg.select("from_id", "to_id", *(r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")), "color", "width")


def _plot_vertices(spark, sf):
    pts = role(spark, sf, "base").select("id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"), (F.col("id") % 3).alias("third"))
    shown = E.plot_tables(graph(spark, sf), pts, None, {"color": F.when(F.col("third") == 0, F.lit("#ff0000")), "radius": 4.0}, ["third"])[1]
    return shown.withColumn("x", r6("x")).withColumn("y", r6("y"))


def _agg_samples(spark, sf):
    s = sample_rows(spark, sf).select((F.col("from_id") % 50).alias("from_id"), (F.col("to_id") % 20).alias("to_id"), "action", "advantage")
    return L.aggregate_samples(s)


def _gumbel(spark, sf):
    u = V.uniform(F.col("from_id"), F.col("to_id"), F.col("action"))
    keyed = _agg_samples(spark, sf).withColumn("key", F.round(L.gumbel_key(F.col("freqs"), u), 9))
    return L.weighted_order(keyed, "key", "from_id", "to_id", "action").select("from_id", "to_id", "action", "freqs", F.col("place").cast("int").alias("place"))


AGG = "agg AS (SELECT from_id % 50 AS from_id, to_id % 20 AS to_id, action, sum(advantage) AS advantages, count(*) AS freqs FROM samples GROUP BY ALL)"


def _reward(spark, sf, f):
    return with_truth(spark, sf).select("query_id", r6(f(F.col("best_ids"), F.col("truth"), F.col("dcs"))).alias("reward"))


def _sweep(spark, sf):
    got = beam.sweep(role(spark, sf, "base"), graph(spark, sf), role(spark, sf, "test"), list(WIDTHS), k=1, max_trajectory=300).join(truth(spark, sf), "query_id")
    r1 = (F.get("best_ids", F.lit(0)) == F.get("truth", F.lit(0))).cast("double")
    return _round_all(got.groupBy("ef").agg(F.avg(r1).alias("recall_at_1"), F.avg("dcs").alias("mean_dcs"), F.avg("hops").alias("mean_hops")))


def _pruned_search(spark, sf):
    return beam.search(role(spark, sf, "base"), action_prob(graph(spark, sf)), role(spark, sf, "test"), k=10, ef=10)


def _frontier(spark, sf):
    return _sessions_flat(beam.frontier_search(role(spark, sf, "base"), graph(spark, sf), role(spark, sf, "test"), [4], 3, 80), 3)


def _export(spark, sf):
    e = _policy_edges(spark, sf).withColumn("confidence", ((F.col("from_id") * 13 + F.col("to_id") * 7) % 7 - 3).cast("double"))
    return E.exported(e, role(spark, sf, "base"), PATIENCE).select("id", F.posexplode_outer("neighbors").alias("slot", "to_id"))


def queries() -> dict:
    return {
        "session_summary": lambda s, d: _round_all(L.summary(with_truth(s, d), 10)),
        "mean_norm": lambda s, d: role(s, d, "base").agg(r6(F.avg(V.norm("vec"))).alias("mean_norm")),
        "normalize_global": lambda s, d: _normalized(s, d, "global"),
        "normalize_instance": lambda s, d: _normalized(s, d, "instance"),
        "l2_distance": lambda s, d: _pairs(s, d, V.squared_l2),
        "neg_dot_distance": lambda s, d: _pairs(s, d, V.negative_dot),
        "knn_ground_truth": lambda s, d: knn.nearest(role(s, d, "base"), role(s, d, "test"), 10).select("query_id", "rank", "vertex_id", r6(F.sqrt("distance")).alias("distance")),
        "knn_top1": lambda s, d: knn.nearest(role(s, d, "base"), role(s, d, "test"), 1).select("query_id", "vertex_id"),
        "query_split": lambda s, d: dataset.split(role(s, d, "learn"), role(s, d, "learn").count() // 5).select("id", "split"),
        "graph_edges": graph,
        "degree_stats": lambda s, d: _round_all(E.degree_stats(graph(s, d), role(s, d, "base"))),
        "padded_adjacency": lambda s, d: E.padded(E.adjacency(graph(s, d), role(s, d, "base")), DEGREE).select("id", F.posexplode("neighbors").alias("slot", "to_id")),
        "edge_batches": _batches,
        "hop2_candidates": lambda s, d: E.two_hops(graph(s, d)),
        "virtual_candidates": lambda s, d: E.virtual_candidates(graph(s, d), 6),
        "edge_keep_prob": lambda s, d: _policy_edges(s, d).select("from_id", "slot", "to_id", r6("prob").alias("prob")),
        "greedy_edges": lambda s, d: _policy_edges(s, d, True).select("from_id", "slot", "to_id", "prob"),
        "confidence_update": lambda s, d: state_of(graph(s, d)).select("from_id", "to_id", V.next_confidence(F.col("prob"), F.col("confidence")).alias("confidence")),
        "edge_confidence": lambda s, d: E.with_confidence(graph(s, d), state_of(graph(s, d)).where("(from_id + to_id) % 3 = 0")).select("from_id", "slot", "to_id", "confidence"),
        "freeze_override": lambda s, d: E.score(state_of(graph(s, d)), PATIENCE).select("from_id", "to_id", "prob", "confidence"),
        "edges_pruned": lambda s, d: E.pruned(_evolution(s, d)[0], PATIENCE).select("from_id", "slot", "to_id", "confidence"),
        "edges_promoted": lambda s, d: E.promoted(E.pruned(_evolution(s, d)[0], PATIENCE), _evolution(s, d)[1], DEGREE),
        "edges_evolved": lambda s, d: E.evolved(*_evolution(s, d), PATIENCE, DEGREE),
        "beam_search": lambda s, d: _sessions_flat(found(s, d, k=1), 1),
        "beam_search_topk": lambda s, d: _sessions_flat(found(s, d), 10),
        "beam_search_pruned": lambda s, d: _sessions_flat(_pruned_search(s, d), 10),
        "beam_search_frontier": _frontier,
        "session_samples": lambda s, d: beam.samples_of(_pruned_search(s, d)),
        "samples_per_hop": lambda s, d: L.samples_per_hop(beam.samples_of(_pruned_search(s, d))),
        "trajectories": lambda s, d: found(s, d).select("query_id", F.posexplode("trajectory").alias("hop", "vertex_id")),
        "enterpoint_descent": _entry,
        "reward_max_dcs": lambda s, d: _reward(s, d, lambda b, t, c: V.reward_max_dcs(b, t, c, 1000, 5)),
        "reward_recall": lambda s, d: _reward(s, d, lambda b, t, c: V.reward_recall(b, t)),
        "reward_none": lambda s, d: _reward(s, d, V.reward_none),
        "reward_weighted_recall": lambda s, d: _reward(s, d, lambda b, t, c: V.reward_weighted_recall(b, t)),
        "recall_at_k": lambda s, d: with_truth(s, d).select("query_id", r6(V.recall(F.col("best_ids"), F.col("truth"), 10)).alias("recall")),
        "ef_sweep": _sweep,
        "mean_baseline": _mean_baseline,
        "session_baseline": _session_baseline,
        "aggregate_samples": lambda s, d: _agg_samples(s, d).withColumn("advantages", r6("advantages")),
        "gumbel_order": _gumbel,
        "advantage_standardized": lambda s, d: L.standardized(sample_rows(s, d)).select("from_id", "to_id", r6("advantage").alias("advantage")),
        "ppo_surrogate": lambda s, d: _losses(s, d).agg(r6(L.ppo_loss()).alias("loss")),
        "trpo_surrogate": lambda s, d: _losses(s, d).agg(r6(L.trpo_loss()).alias("loss")),
        "policy_entropy": lambda s, d: _losses(s, d).agg(r6(L.weighted(L.entropy(F.col("p_new"), 1 - F.col("p_new")), F.col("freqs"))).alias("entropy")),
        "policy_kl": lambda s, d: _losses(s, d).agg(r6(L.weighted(L.kl(F.col("p_old"), 1 - F.col("p_old"), F.col("p_new"), 1 - F.col("p_new")), F.col("freqs"))).alias("kl")),
        "reward_ewm": lambda s, d: L.adjusted_ewm(_history(s, d)).withColumn("ewm", r6("ewm")),
        "reward_trailing_mean": lambda s, d: L.trailing_mean(_history(s, d)).select("step", F.round("trailing", 9).alias("mean_reward")),
        "graph_export": _export,
        "fvecs_roundtrip": lambda s, d: _roundtrip(s, role(s, d, "base"), "fvecs").select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", r6(F.col("x").cast("double")).alias("x")),
        "ivecs_roundtrip": lambda s, d: _roundtrip(s, truth(s, d), "ivecs").select("id", F.posexplode("vec").alias("rank", "vertex_id")),
        "adjacency_roundtrip": lambda s, d: _roundtrip(s, E.adjacency(graph(s, d), role(s, d, "base")), "adjacency").select("id", F.posexplode_outer("neighbors").alias("slot", "to_id")),
        "nsg_roundtrip": lambda s, d: _roundtrip(s, E.adjacency(graph(s, d), role(s, d, "base")), "nsg", width="8", enterpoint="0").select("id", F.posexplode("neighbors").alias("slot", "to_id")),
        "rgba_hex": _colors,
        "graph_plot_tables": _plot,
        "graph_plot_vertices": _plot_vertices,
        "train_step_ppo": lambda s, d: _train(s, d, training.PPO),
        "train_step_optimized_ppo": lambda s, d: _train(s, d, training.OptimizedPPO),
        "train_step_memory_efficient_ppo": lambda s, d: _train(s, d, training.MemoryEfficientPPO),
        "train_step_trpo": lambda s, d: _train(s, d, training.TRPO),
        "train_step_efficient_trpo": lambda s, d: _train(s, d, training.EfficientTRPO, samples_in_batch=1000, fvp_min_batches=2),
    }


def oracle_sql() -> dict:
    b10, pruned = beam_sql("10"), beam_sql("10", prob=ACTION)
    flat = lambda k: f"SELECT query_id, rank::INT AS rank, ids[rank+1] AS vertex_id, dcs, hops FROM (SELECT *, unnest(range(least({k}, len(ids)))) AS rank FROM sessions)"
    sess = "SELECT {} FROM sessions JOIN truth USING (query_id)"
    some = "part AS (SELECT * FROM edges)"
    deg = "deg AS (SELECT id, count(to_id) AS d FROM base LEFT JOIN part ON from_id = id GROUP BY id)"
    lists = "lists AS (SELECT id, coalesce(list(to_id ORDER BY slot) FILTER (to_id IS NOT NULL), []) AS nb FROM base LEFT JOIN part ON from_id = id GROUP BY id)"
    upd = "CASE WHEN s2 < 0 AND p > 0.00011 THEN 0.0 ELSE s2 END"
    step = "(SELECT *, CASE WHEN s1 > 0 AND p < 0.99989 THEN 0.0 ELSE s1 END AS s2 FROM (SELECT *, c + (CASE WHEN p < 1 AND p > 0.99989 THEN 1.0 ELSE 0 END) - (CASE WHEN p > 0 AND p < 0.00011 THEN 1.0 ELSE 0 END) AS s1 FROM ({}) a) b)"
    st = f"st AS (SELECT from_id, slot, to_id, {STATE} FROM edges)"
    sqls = {
        "session_summary": b10 + sess.format(_summary_sql(True)),
        "mean_norm": "x AS (SELECT 1) SELECT round(avg(sqrt(list_sum(list_transform(vec, lambda v: v*v)))), 6) AS mean_norm FROM base",
        "normalize_global": "n AS (SELECT avg(sqrt(list_sum(list_transform(vec, lambda v: v*v)))) AS m FROM base) SELECT id, i::INT AS i, round(vec[i+1] / m, 6) AS x FROM (SELECT id, vec, m, unnest(range(len(vec))) AS i FROM base, n)",
        "normalize_instance": "x AS (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda v: v*v))) AS m, unnest(range(len(vec))) AS i FROM base) SELECT id, i::INT AS i, round(vec[i+1] / m, 6) AS x FROM x",
        "l2_distance": "x AS (SELECT 1) SELECT from_id, to_id, round(pow(list_distance(a.vec, b.vec), 2), 6) AS distance FROM edges JOIN base a ON a.id = from_id JOIN base b ON b.id = to_id",
        "neg_dot_distance": "x AS (SELECT 1) SELECT from_id, to_id, round(-list_inner_product(a.vec, b.vec), 6) AS distance FROM edges JOIN base a ON a.id = from_id JOIN base b ON b.id = to_id",
        "knn_ground_truth": "x AS (SELECT 1) SELECT query_id, rank::INT AS rank, vertex_id, round(dist, 6) AS distance FROM near",
        "knn_top1": "x AS (SELECT 1) SELECT query_id, vertex_id FROM near WHERE rank = 0",
        "query_split": "n AS (SELECT count(*) AS n FROM learn) SELECT id, CASE WHEN id >= n - n // 5 THEN 'val' ELSE 'train' END AS split FROM learn, n",
        "graph_edges": "x AS (SELECT 1) SELECT from_id, slot::INT AS slot, to_id FROM edges",
        "degree_stats": f"{some}, {deg} SELECT count(*) AS n_vertices, sum(d)::BIGINT AS n_edges, max(d) AS max_degree, round(avg(d), 6) AS mean_degree, sum((d = 0)::INT)::BIGINT AS isolated FROM deg",
        "padded_adjacency": f"{some}, {lists} SELECT id, slot::INT AS slot, coalesce(nb[slot+1], -1) AS to_id FROM (SELECT id, nb, unnest(range(8)) AS slot FROM lists)",
        "edge_batches": f"{some}, d AS (SELECT from_id, count(*) AS degree, row_number() OVER (ORDER BY from_id) AS n FROM part GROUP BY from_id), r AS (SELECT n, from_id, degree, 0 AS batch, degree AS s FROM d WHERE n = 1 UNION ALL SELECT d.n, d.from_id, d.degree, CASE WHEN r.s >= 50 THEN batch + 1 ELSE batch END, CASE WHEN r.s >= 50 THEN d.degree ELSE r.s + d.degree END FROM r JOIN d ON d.n = r.n + 1) SELECT from_id, degree, batch FROM r",
        "hop2_candidates": f"{TWO} SELECT from_id, to_id FROM two",
        "virtual_candidates": f"{TWO} SELECT from_id, slot::INT AS slot, to_id FROM virtual WHERE slot < 6",
        "edge_keep_prob": f"{POLICY} SELECT from_id, slot::INT AS slot, to_id, round(prob, 6) AS prob FROM kept",
        "greedy_edges": f"{POLICY} SELECT from_id, slot::INT AS slot, to_id, (prob > 0.5)::INT::DOUBLE AS prob FROM kept",
        "confidence_update": f"{st} SELECT from_id, to_id, {upd} AS confidence FROM " + step.format("SELECT from_id, to_id, prob AS p, confidence AS c FROM st"),
        "edge_confidence": f"{st} SELECT from_id, slot::INT AS slot, to_id, CASE WHEN (from_id + to_id) % 3 = 0 THEN confidence ELSE 0.0 END AS confidence FROM st",
        "freeze_override": f"{st} SELECT from_id, to_id, p AS prob, {upd} AS confidence FROM " + step.format("SELECT from_id, to_id, CASE WHEN confidence = 3 THEN 1.1 WHEN confidence = -3 THEN -0.1 ELSE prob END AS p, confidence AS c FROM st"),
        "edges_pruned": f"{EVOLVE} SELECT from_id, slot::INT AS slot, to_id, confidence FROM keep",
        "edges_promoted": f"{EVOLVE} SELECT from_id, slot, to_id, confidence FROM prom",
        "edges_evolved": f"{EVOLVE} SELECT from_id, slot, to_id, confidence FROM keep UNION ALL SELECT from_id, slot, to_id, confidence FROM prom",
        "beam_search": b10 + flat(1),
        "beam_search_topk": b10 + flat(10),
        "beam_search_pruned": pruned + flat(10),
        "beam_search_frontier": beam_sql("4") + flat(3),
        "session_samples": pruned + "SELECT query_id, s.hop, s.slot::INT AS slot, s.from_id, s.to_id, s.action FROM (SELECT query_id, unnest(taken) AS s FROM sessions)",
        "samples_per_hop": pruned + "SELECT query_id, s.hop AS hop, count(*) AS n_samples FROM (SELECT query_id, unnest(taken) AS s FROM sessions) GROUP BY 1, 2",
        "trajectories": b10 + "SELECT query_id, hop::INT AS hop, path[hop+1] AS vertex_id FROM (SELECT query_id, path, unnest(range(len(path))) AS hop FROM sessions)",
        "enterpoint_descent": ENTRY + " SELECT query_id, pos AS enter FROM hop WHERE level = 2",
        "reward_max_dcs": b10 + sess.format("query_id, round(len(list_intersect(ids[1:5], truth[1:5])) / 5.0 * greatest(1000 - dcs, 1), 6) AS reward"),
        "reward_recall": b10 + sess.format("query_id, (ids[1] = truth[1])::INT::DOUBLE AS reward"),
        "reward_none": b10 + sess.format("query_id, 0.0::DOUBLE AS reward"),
        "reward_weighted_recall": b10 + sess.format("query_id, round(CASE WHEN list_contains(truth, ids[1]) THEN pow(0.5, list_position(truth, ids[1]) - 1) ELSE 0.0 END, 6) AS reward"),
        "recall_at_k": b10 + sess.format("query_id, round(len(list_intersect(ids[1:10], truth[1:10])) / 10.0, 6) AS recall"),
        "ef_sweep": beam_sql(", ".join(map(str, WIDTHS)), cap=300) + sess.format("ef, round(avg((ids[1] = truth[1])::INT), 6) AS recall_at_1, round(avg(dcs), 6) AS mean_dcs, round(avg(hops), 6) AS mean_hops") + " GROUP BY ef",
        "mean_baseline": f"{SAMPLES}, m AS (SELECT sum(r) / 43 AS m FROM (SELECT avg(advantage) AS r FROM samples GROUP BY session_index)) SELECT round(0.15*(0.05*m + 0.95*2*m) + 0.85*3*m, 6) AS value FROM m",
        "session_baseline": f"{SAMPLES}, r AS (SELECT session_index AS query_id, avg(advantage) AS reward FROM samples GROUP BY 1), o AS (SELECT range AS query_id, CASE WHEN reward IS NULL THEN 1.0 ELSE 0.75 + 0.25 * reward END AS value, range >= 45 OR reward IS NOT NULL AS updated FROM range(50) LEFT JOIN r ON r.query_id = range) SELECT query_id, round(value, 6) AS value, updated AND NOT (SELECT bool_and(updated) FROM o) AS updated FROM o",
        "aggregate_samples": f"{SAMPLES}, {AGG} SELECT from_id, to_id, action, round(advantages, 6) AS advantages, freqs FROM agg",
        "gumbel_order": f"{SAMPLES}, {AGG} SELECT from_id, to_id, action, freqs, (row_number() OVER (ORDER BY round(ln(freqs) - ln(-ln(((from_id*7919 + to_id*104729 + action*1299709) % 1000003 + 0.5) / 1000003)), 9) DESC, from_id, to_id, action))::INT AS place FROM agg",
        "advantage_standardized": f"{SAMPLES} SELECT from_id, to_id, round((advantage - avg(advantage) OVER ()) / (stddev_samp(advantage) OVER () + 1e-8), 6) AS advantage FROM samples",
        "ppo_surrogate": f"{SAMPLES}, {LOSS} SELECT round(-sum(freqs * least(exp(lr) * adv, least(greatest(exp(lr), 0.8), 1.2) * adv)) / sum(freqs), 6) AS loss FROM loss",
        "trpo_surrogate": f"{SAMPLES}, {LOSS} SELECT round(-sum(exp(lr) * adv) / sum(freqs), 6) AS loss FROM loss",
        "policy_entropy": f"{SAMPLES} SELECT round(sum(-freqs * (p_new * ln(p_new) + (1-p_new) * ln(1-p_new))) / sum(freqs), 6) AS entropy FROM samples",
        "policy_kl": f"{SAMPLES} SELECT round(sum(freqs * (p_old * (ln(p_old) - ln(p_new)) + (1-p_old) * (ln(1-p_old) - ln(1-p_new)))) / sum(freqs), 6) AS kl FROM samples",
        "reward_ewm": "h AS (SELECT id AS step, (id * 37 % 101) / 10.0 AS reward FROM learn) SELECT a.step, round(sum(b.reward * pow(1 - 2/51.0, a.step - b.step)) / sum(pow(1 - 2/51.0, a.step - b.step)), 6) AS ewm FROM h a JOIN h b ON b.step <= a.step GROUP BY a.step",
        "reward_trailing_mean": "h AS (SELECT id AS step, ((id * 37 % 101) / 10.0)::DOUBLE AS reward FROM learn) SELECT step, round(avg(reward) OVER (ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean_reward FROM h",
        "graph_export": f"{POLICY}, part AS (SELECT *, (from_id*13+to_id*7) % 7 - 3 AS c FROM kept), sel AS (SELECT from_id, slot AS s0, to_id FROM part WHERE (prob > 0.5 OR c = 3) AND c <> -3) SELECT id, CASE WHEN to_id IS NOT NULL THEN (row_number() OVER (PARTITION BY id ORDER BY s0) - 1)::INT END AS slot, to_id FROM base LEFT JOIN sel ON from_id = id",
        "fvecs_roundtrip": "x AS (SELECT id, vec, unnest(range(len(vec))) AS i FROM base) SELECT id, i::INT AS i, round(vec[i+1], 6) AS x FROM x",
        "ivecs_roundtrip": "x AS (SELECT 1) SELECT query_id AS id, rank::INT AS rank, vertex_id::INT AS vertex_id FROM near",
        "adjacency_roundtrip": f"{some} SELECT id, CASE WHEN to_id IS NOT NULL THEN (row_number() OVER (PARTITION BY id ORDER BY slot) - 1)::INT END AS slot, to_id FROM base LEFT JOIN part ON from_id = id",
        "nsg_roundtrip": "x AS (SELECT 1) SELECT from_id AS id, slot::INT AS slot, to_id FROM edges",
        "rgba_hex": "x AS (SELECT id, [(id * 7 % 11) / 10.0, (id % 5) / 4.0, 0.25, 1.0]::DOUBLE[] AS c FROM base) SELECT id, '#' || array_to_string(list_transform(c, lambda v: lpad(lower(printf('%x', round_even(v * 255, 0)::BIGINT)), 2, '0')), '') AS color FROM x",
        "graph_plot_tables": "x AS (SELECT 1) SELECT from_id, to_id, round(a.vec[1], 6) AS x0, round(a.vec[2], 6) AS y0, round(b.vec[1], 6) AS x1, round(b.vec[2], 6) AS y1, '#111111' AS color, CASE WHEN slot < 3 THEN slot + 0.5::DOUBLE ELSE 1.0 END::DOUBLE AS width FROM edges JOIN base a ON a.id = from_id JOIN base b ON b.id = to_id",
        "graph_plot_vertices": "x AS (SELECT 1) SELECT id, round(vec[1], 6) AS x, round(vec[2], 6) AS y, CASE WHEN id % 3 = 0 THEN '#ff0000' ELSE '#1f77b4' END AS color, 'circle' AS marker, 4.0::DOUBLE AS radius, 0.25::DOUBLE AS alpha, id % 3 AS third FROM base",
    }
    return {k: PRE + v for k, v in sqls.items()}
