"""The similarity-graph engine against hand-made cases, a two-heap search and finite differences."""

import heapq
import os
import struct
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions import policy, vectors as V
from simloom.operators import beam, edges as E, knn, learning as L, training
from simloom.plans import dataset, durable, ranks
from simloom.sources import vecs


def packed(x, lists, probs=None):
    begin = np.r_[0, np.cumsum([len(n) for n in lists])]
    flat = np.array([v for n in lists for v in n], np.int64)
    p = np.full(len(flat), 2.0) if probs is None else np.array([v for n in probs for v in n])
    return beam.PackedGraph(np.asarray(x, float), begin, flat, np.array([i for n in lists for i in range(len(n))]), p)


def search_one(g, query_id, q, start, ef, k, cap, metric, seed):
    """The session of one query."""
    (row,) = beam.search_batch(g, np.array([query_id]), np.asarray(q)[None], start, ef, k, cap, metric, seed).to_pylist()
    return *(row[c] for c in ("query_id", "best_ids", "dcs", "hops", "trajectory")), [tuple(s.values()) for s in row["samples"]]


def two_heaps(g, query_id, q, start, ef, k, cap):
    """Independent search with a candidate heap and a result heap."""
    d = lambda v: float(((g.vectors[v] - q) ** 2).sum())
    cand, top, seen, dcs, path, samples = [(d(start), start)], [(-d(start), -start)], {start}, 1, [], []
    while cand and len(path) < cap:
        dist, at = heapq.heappop(cand)
        if (dist, at) > (-top[0][0], -top[0][1]):
            break
        for e in range(g.begin[at], g.begin[at + 1]):
            to, p, slot = int(g.neighbors[e]), g.probs[e], int(g.slots[e])
            if to in seen or p < 0:
                continue
            u = ((query_id * 7919 + len(path) * 104729 + slot * 1299709) % 1000003 + 0.5) / 1000003
            if p <= 1:
                samples.append((len(path), slot, at, to, int(p > u)))
            if p <= u:
                continue
            seen.add(to)
            dcs += 1
            if len(top) < ef or (d(to), to) < (-top[0][0], -top[0][1]):
                heapq.heappush(cand, (d(to), to))
                heapq.heappush(top, (-d(to), -to))
                if len(top) > ef:
                    heapq.heappop(top)
        path.append(at)
    best = [v for _, v in sorted((-a, -b) for a, b in top)][:k]
    return query_id, best, dcs, len(path), path, samples


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.booleans(), st.integers(1, 12))
def test_set_form_equals_heap_form(seed, ef, ties, cap):
    rng = np.random.default_rng(seed)
    n = 25
    x = rng.integers(0, 3, (n, 2)).astype(float) if ties else rng.normal(size=(n, 3))
    lists = [rng.choice(n, rng.integers(0, 5), replace=seed % 2 == 0).tolist() for _ in range(n)]
    probs = [[float(rng.choice([1.1, -0.1, rng.random()])) for _ in row] for row in lists]
    g = packed(x, lists, probs)
    q = x.mean(0)
    k = min(ef, 3)
    assert search_one(g, 5, q, 0, ef, k, cap, "l2", 0) == two_heaps(g, 5, q, 0, ef, k, cap)
    many = beam.search_batch(g, np.arange(7), x[:7] + 0.25, 0, ef, k, cap, "l2", 0).to_pylist()
    told = [(*list(r.values())[:5], [tuple(s.values()) for s in r["samples"]]) for r in many]
    assert told == [two_heaps(g, i, x[i] + 0.25, 0, ef, k, cap) for i in range(7)]


def test_line_graph_and_hop_cap():
    g = packed([[i] for i in range(6)], [[1], [0, 2], [1, 3], [2, 4], [3, 5], [4]])
    assert search_one(g, 0, np.array([5.0]), 0, 1, 1, 80, "l2", 0)[1:5] == ([5], 6, 6, [0, 1, 2, 3, 4, 5])
    assert search_one(g, 0, np.array([5.0]), 0, 1, 1, 2, "l2", 0)[1:5] == ([2], 3, 2, [0, 1])


def test_ties_short_answers_and_frozen_edges():
    g = packed([[1, 1], [1, -1], [-1, 1], [-1, -1]], [[1, 2, 3]] * 4)
    assert search_one(g, 0, np.zeros(2), 0, 4, 4, 80, "l2", 0)[1] == [0, 1, 2, 3]
    g = packed([[0], [1], [2]], [[1], [], []])
    assert search_one(g, 0, np.array([2.0]), 0, 3, 3, 80, "l2", 0)[1] == [1, 0]
    g = packed([[0], [1], [2]], [[1, 2], [], []], [[1.1, -0.1], [], []])
    out = search_one(g, 0, np.array([2.0]), 0, 3, 3, 80, "l2", 0)
    assert out[1] == [1, 0] and out[5] == []


def test_pruned_is_not_visited():
    g = packed([[0], [1], [3]], [[2, 1], [2], []], [[0.0, 1.1], [1.1], []])
    out = search_one(g, 0, np.array([3.0]), 0, 3, 1, 80, "l2", 0)
    assert out[1] == [2] and out[5] == [(0, 0, 0, 2, 0)]


def test_searches_agree(spark):
    """Whole sessions, of two widths at once; two jobs a hop, and nothing left but the result."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    vertices = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(4)], "id long, vec array<double>")
    edges = durable.table(knn.knn_graph(vertices, 4).withColumn("prob", F.lit(0.8)), "edges")
    edges = edges.unionByName(edges.where("slot < 2").withColumn("slot", F.col("slot") + 9))  # a vertex may be named twice
    folder = Path(durable.shared_dir(spark).removeprefix("file://")) / "simloom"
    before = set(folder.iterdir())
    jobs = []
    for cap in (2, 6):
        spark.sparkContext.setJobGroup(f"cap{cap}", "a search")
        got = beam.frontier_search(vertices, edges, queries, [2, 3], 2, cap)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cap{cap}")))
        spark.sparkContext.setJobGroup("", "")
        assert len(set(folder.iterdir()) - before) == 1
        told = got.collect()
        for ef in (2, 3):
            want = {r["query_id"]: r for r in beam.search(vertices, edges, queries, k=2, ef=ef, max_trajectory=cap, metric="l2").collect()}
            assert {r["query_id"]: r[:-1] for r in told if r["ef"] == ef} == {i: tuple(r) for i, r in want.items()}
        durable.drop(got)
    assert jobs[1] - jobs[0] <= 2 * 4


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_cells_of_knn(spark, monkeypatch, metric):
    """Cells and tiles give what one scan gives, ties and a hot vector included; clusters leave most cells unscanned."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(1, 4)), 30, 0), rng.normal(size=(400, 4)) * 0.01 + rng.normal(size=(8, 4)).repeat(50, 0) * 9])
    df = durable.table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), "x")
    rows = lambda k, skip: sorted(map(tuple, knn.nearest(df, df, k, metric, skip, tile_rows=20).select("query_id", "rank", "vertex_id").collect()))
    whole = {(k, skip): rows(k, skip) for k, skip in ((3, True), (1, False))}
    d = -(x @ x.T) if metric == "dot" else ((x[:, None] - x[None]) ** 2).sum(2)
    if metric == "l2":
        np.fill_diagonal(d, np.inf)
        assert [v for _, _, v in whole[3, True]] == np.argsort(d, 1, kind="stable")[:, :3].ravel().tolist()
    for name, value in (("SMALL", 0), ("MEASURED", 300)):
        monkeypatch.setattr(knn, name, value)
    assert {(k, skip): rows(k, skip) for k, skip in whole} == whole
    assert len(rows(1000, True)) == 490 * 489
    if metric == "l2":
        cells = knn.Cells.of(df, len(x), 4, 20)
        first = cells.routed(df.where("id >= 90"), 4)
        near = cells.routed(first.withColumn("worst", F.lit(0.01)), None)
        met = near.agg(F.avg(F.size("cells"))).first()[0]
        assert len(cells.centres) > 10 and met < len(cells.centres) / 2


def test_candidates_of_a_hub(spark):
    """As drawn from all that lies two hops away, with a vertex of degree 2,000 that most others know."""
    rng = np.random.default_rng(6)
    n = 2001
    lists = {0: list(range(1, n))} | {i: [0, *rng.choice(n, 3).tolist()] for i in range(1, 400)}
    edges = spark.createDataFrame([(i, s, int(v)) for i, near in lists.items() for s, v in enumerate(near)], "from_id long, slot int, to_id long")
    for seed in (0, 5):
        got = {}
        for r in E.virtual_candidates(edges, 6, seed).collect():
            got.setdefault(r["from_id"], []).append((r["slot"], r["to_id"]))
        for i, near in lists.items():
            far = {w for v in near for w in lists.get(v, [])} - {i, *near}
            want = sorted(far, key=lambda w: ((i * 7919 + w * 104729 + seed * 15485863) % 1000003, w))[:6]
            assert sorted(got.get(i, [])) == list(enumerate(want))


def test_confidence_grid(spark):
    rows = [(c, p) for c in (-3.0, 0.0, 3.0) for p in (0.00005, 0.5, 0.99995, 0.00011, 0.99989, 1.1, -0.1)]

    def rule(c, p):
        if p < 1 and p > V.UPPER:
            c += 1
        if p > 0 and p < V.LOWER:
            c -= 1
        if c > 0 and p < V.UPPER:
            c = 0.0
        if c < 0 and p > V.LOWER:
            c = 0.0
        return c

    got = spark.createDataFrame(rows, "c double, p double").select("c", "p", V.next_confidence(F.col("p"), F.col("c")).alias("n")).collect()
    # frozen probabilities stand with the confidence at the patience of their sign
    assert all(r["n"] == rule(r["c"], r["p"]) for r in got)


def test_evolution(spark):
    edges = spark.createDataFrame([(0, 0, 1, 0.0), (0, 1, 2, -3.0), (0, 2, 3, 1.0)], "from_id long, slot int, to_id long, confidence double")
    cand = spark.createDataFrame([(0, 0, 3, 0.9), (0, 1, 4, 0.5), (0, 2, 5, 0.8)], "from_id long, slot int, to_id long, prob double")
    assert sorted(map(tuple, E.evolved(edges, cand, 3, 3).collect())) == [(0, 0, 1, 0.0), (0, 1, 3, 1.0), (0, 2, 5, 0.0)]


def test_files(spark, tmp_path):
    lists = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "id long, neighbors array<long>")
    for form, extra in (("adjacency", {}), ("nsg", {"width": "2", "enterpoint": "1"})):
        path = str(tmp_path / form)
        vecs.write(lists, path, form, **extra)
        assert sorted(map(tuple, vecs.read(spark, path, form, partbytes="8").collect())) == [(0, [1, 2]), (1, []), (2, [0])]
    assert vecs.nsg_header(str(tmp_path / "nsg")) == {"width": 2, "enterpoint_node": 1}
    path = str(tmp_path / "v.fvecs")
    with open(path, "wb") as f:
        for row in ([1.0, 2.0], [3.0, 4.5], [5.0, 6.0]):
            f.write(struct.pack("<i2f", 2, *row))
    assert sorted(map(tuple, vecs.read(spark, path, "fvecs", partbytes="12").collect())) == [(0, [1.0, 2.0]), (1, [3.0, 4.5]), (2, [5.0, 6.0])]
    assert vecs.read(spark, path, "fvecs", limit="2").count() == 2
    assert os.path.getsize(path) == 36


def test_dataset(spark, tmp_path):
    rng = np.random.default_rng(3)
    frame = lambda n: spark.createDataFrame([(i, rng.normal(size=20).tolist()) for i in range(n)], "id long, vec array<double>")
    paths = {}
    for name, n in (("base", 12), ("train", 6), ("test", 3)):
        paths[name] = str(tmp_path / name)
        vecs.write(frame(n), paths[name], "fvecs")
    paths["edges"] = str(tmp_path / "edges")
    vecs.write(spark.createDataFrame([(i, [(i + 1) % 12, (i + 2) % 12]) for i in range(12)], "id long, neighbors array<long>"), paths["edges"], "adjacency")
    data = dataset.GraphDataset.load(spark, paths["base"], paths["edges"], paths["train"], paths["test"], val_queries_size=2, ground_truth_n_neighbors=2)
    assert data.max_degree == 2 and data.edges.count() == 24
    assert {r[0]: r[1] for r in data.queries.groupBy("split").count().collect()} == {"train": 4, "val": 2, "test": 3}
    assert abs(data.vertices.agg(F.avg(V.norm("vec"))).first()[0] - 1) < 1e-9
    with pytest.raises(ValueError):
        dataset.GraphDataset.load(spark, paths["base"], paths["edges"], paths["train"], paths["test"], graph_type="hnsw")


def test_metric_rule_and_tail(spark):
    df = spark.createDataFrame([([1.0] * 20, [0.0] * 20)], "a array<double>, b array<double>")
    assert df.select(V.distance("a", "b", "auto", 20)).first()[0] == 20.0
    assert df.select(V.distance("a", "a", "auto", 300)).first()[0] == -20.0


def test_gradient_and_fisher():
    net = policy.EdgePolicy(3, 4, seed=2)
    rng = np.random.default_rng(0)
    x, df = rng.normal(size=(7, 6)), rng.normal(size=7)
    f, cache = net.logits(x)
    g = net.backward(cache, df)
    v = rng.normal(size=len(net.flat))
    eps = 1e-6
    up, down = (net.logits(x, net.flat + s * eps * v)[0] for s in (1, -1))
    assert np.allclose(g @ v, df @ (up - down) / (2 * eps), rtol=1e-5)
    assert np.allclose(net.forward_product(cache, v), (up - down) / (2 * eps), rtol=1e-5)


def test_conjugate_gradient_and_line_search():
    a = np.array([[4.0, 1], [1, 3]])
    assert np.allclose(training.conjugate_gradient(lambda v: a @ v, np.array([1.0, 2])), np.linalg.solve(a, [1, 2]))
    x = training.line_search(lambda p: (float((p[0] - 1) ** 2), float(abs(p[0]))), np.array([0.0]), np.array([1.5]), 2.0, 1.0)
    assert abs(x[0] - 1) <= 0.5


def test_baselines(spark):
    s = spark.createDataFrame([(0, 1.0), (0, 3.0), (2, 4.0)], "session_index long, reward double")
    one = L.MeanBaseline().update(s, 4)
    assert one.value == one.mean_reward == 1.5
    assert abs(one.update(s, 8).value - (0.05 * 1.5 + 0.95 * 0.75)) < 1e-12
    base = spark.createDataFrame([(0, 1.0, False), (1, 1.0, True)], "query_id long, value double, updated boolean")
    out = L.session_baseline(base, spark.createDataFrame([(0, 3.0)], "query_id long, reward double"), 0.5)
    assert sorted(map(tuple, out.collect())) == [(0, 2.0, False), (1, 1.0, False)]


def test_colors(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0],), ([0.0, 0.0, 0.0, 1.0],), ([2.0, 0.0, 0.0],)], "c array<double>")
    assert [r[0] for r in df.select(V.hex_color(F.col("c"))).collect()] == ["#0080ff", "#000000ff", None]


def test_stream(spark, tmp_path):
    from simloom.streaming import search as S

    vertices = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id long, vec array<double>")
    edges = spark.createDataFrame([(i, 0, i + 1) for i in range(5)], "from_id long, slot int, to_id long")
    spark.createDataFrame([(0, [4.2])], "id long, vec array<double>").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id long, vec array<double>").parquet(str(tmp_path / "in"))
    S.search_stream(stream, vertices, edges, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), k=1, ef=2, metric="l2").awaitTermination()
    assert [r["best_ids"] for r in got] == [[4]]


def test_knn_many_ties():
    from simloom.operators import knn

    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(2, 64)), 200, 0)
    ids = rng.permutation(400)
    for metric in ("l2", "dot"):
        got = knn._top(np.array([900]), x[:1] + 0.1, ids, x, 5, metric, False)
        assert got["vertex_id"].tolist() == sorted(ids[:200])[:5]


def test_ragged_lists_and_batches(spark, monkeypatch):
    """Vertices of 0 to 5 edges, against plain loops."""
    lists = {i: [(i + j + 1) % 12 for j in range(i % 6)] for i in range(12)}
    edges = spark.createDataFrame([(i, s, t) for i, ts in lists.items() for s, t in enumerate(ts)], "from_id long, slot int, to_id long")
    vertices = spark.range(12)
    n = [len(t) for t in lists.values()]
    assert tuple(E.degree_stats(edges, vertices).first()) == (12, sum(n), max(n), sum(n) / 12, n.count(0))
    assert {r["id"]: r["neighbors"] for r in E.padded(E.adjacency(edges, vertices), 5).collect()} == {i: t + [-1] * (5 - len(t)) for i, t in lists.items()}
    for size, batch_rows in ((1, 4), (2, 3), (7, 3), (7, 10_000), (100, 2)):
        want, batch, held = [], 0, 0
        for i, t in lists.items():
            if t:
                want.append((i, len(t), batch))
                held += len(t)
                if held >= size:
                    batch, held = batch + 1, 0
        monkeypatch.setattr(ranks, "RANGE_ROWS", batch_rows)
        got = E.edge_batches(edges, size).select("from_id", "degree", "batch").collect()
        assert sorted(tuple(r) for r in got) == want
    assert not E.edge_batches(edges.limit(0), 7).count()


def test_cluster_needs_a_shared_folder():
    def session(master: str, folder: str | None) -> SimpleNamespace:
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: folder or other), sparkContext=SimpleNamespace(master=master, applicationId="test"))

    assert durable.shared_dir(session("spark://one:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert durable.shared_dir(session("local[2]", None)).startswith("file://")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(session("spark://one:7077", None))


def test_sweep_is_searches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    frame = lambda n: spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(n)], "id long, vec array<double>")
    vertices, queries = frame(40), frame(3)
    edges = knn.knn_graph(vertices, 4)
    rows = lambda df: sorted((r["ef"], r["query_id"], tuple(r["best_ids"]), r["dcs"], r["hops"]) for r in df.collect())
    swept = rows(beam.sweep(vertices, edges, queries, [2, 5]))
    assert swept == sorted(x for ef in (2, 5) for x in rows(beam.search(vertices, edges, queries, ef=ef).withColumn("ef", F.lit(ef))))
    monkeypatch.setattr(beam, "SMALL", 0)
    assert rows(beam.sweep(vertices, edges, queries, [2, 5])) == swept


def test_knn_dealt_by_work(spark, monkeypatch):
    """One file of queries is no one task, and its rows are those of brute force, infinite vectors aside."""
    x = np.random.default_rng(3).integers(0, 4, (300, 3)).astype(float)
    x[7] = np.inf
    df = durable.table(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1), "one")
    monkeypatch.setattr(knn, "TASK_PAIRS", 300 * 300 // 8)
    near = knn.nearest(df, df, 5)
    assert "RoundRobinPartitioning(8)" in near._jdf.queryExecution().toString()
    got = {(r["query_id"], r["rank"]): r["vertex_id"] for r in near.collect()}
    with np.errstate(invalid="ignore"):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in set(range(300)) - {7}:
        assert [got[i, r] for r in range(5)] == [j for j in np.lexsort((np.arange(300), d[i])) if j != 7][:5]


def test_knn_of_infinite_products():
    x = np.array([[1.0, 1], [np.inf, 1], [2, 2], [0, 1]])
    got = knn._top(np.array([9]), np.ones((1, 2)), np.arange(4), x, 2, "dot", False)
    assert got["vertex_id"].tolist() == [2, 0]
