"""Training steps against small numpy versions of their rules, and a run that goes on from its checkpoint."""

import concurrent.futures
import itertools
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import policy, vectors as V
from simloom.operators import learning as L, training
from simloom.operators.engine import SessionEngine, worker_count
from simloom.plans import durable
from simloom.plans.experiment import Experiment, minibatches, name_of
from simloom.plans.ring import Ring

D, H = 3, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, D))
    rows = [(int(a), int(b), int(c), float(v)) for a, b, c, v in zip(rng.integers(0, 12, 90), rng.integers(0, 12, 90), rng.integers(0, 2, 90), rng.normal(size=90), strict=True)]
    rows += rows[:30]
    vertices = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()
    return x, rows, spark.createDataFrame(rows, "from_id long, to_id long, action int, advantage double").cache(), vertices


def numeric(f, flat, eps=1e-6):
    """The gradient of f by central differences."""
    out = np.empty_like(flat)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += eps
        down[i] -= eps
        out[i] = (f(up) - f(down)) / (2 * eps)
    return out


def arrays(x, rows, standardise, aggregate):
    """Inputs, actions, advantages and frequencies of the samples a trainer works on."""
    adv = np.array([r[3] for r in rows])
    if standardise:
        adv = (adv - adv.mean()) / (adv.std(ddof=1) + 1e-8)
    if not aggregate:
        return np.array([np.r_[x[a], x[b]] for a, b, *_ in rows]), np.array([r[2] for r in rows]), adv, np.ones(len(rows))
    held = {}
    for r, v in zip(rows, adv, strict=True):
        one = held.setdefault(r[:3], [0.0, 0])
        one[0] += v
        one[1] += 1
    keys = list(held)
    return np.array([np.r_[x[a], x[b]] for a, b, _ in keys]), np.array([k[2] for k in keys]), np.array([held[k][0] for k in keys]), np.array([held[k][1] for k in keys], float)


@pytest.mark.parametrize("kind", [training.PPO, training.OptimizedPPO, training.MemoryEfficientPPO])
def test_ppo(data, kind):
    x, rows, samples, vertices = data
    net = policy.EdgePolicy(D, H, seed=2)
    inputs, act, adv, w = arrays(x, rows, kind.standardise, kind.aggregate)
    old = net.logp(inputs)
    i = np.arange(len(act))

    def parts(flat):
        logp = net.logp(inputs, flat)
        r = np.exp(logp[i, act] - old[i, act])
        surrogate = (w * np.minimum(r * adv, np.clip(r, 0.8, 1.2) * adv)).sum() / w.sum()
        entropy = (w * -(np.exp(logp) * logp).sum(1)).sum() / w.sum()
        return -surrogate - 0.01 * entropy, (w * (np.exp(old) * (old - logp)).sum(1)).sum() / w.sum(), entropy

    flat, m, s, told = net.flat.copy(), 0, 0, []
    for t in range(1, 4):
        told.append(parts(flat))
        g = numeric(lambda p: parts(p)[0], flat)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        flat = flat - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    out = kind(net, lr=0.01, epochs=3, target_kl=None).step(samples, vertices)
    assert np.allclose(net.flat, flat, atol=2e-5)
    assert np.allclose([out["loss"], out["kl"], out["entropy"]], np.mean(told, 0), atol=1e-6)


def test_early_stop_after_the_epoch(data):
    *_, samples, vertices = data
    one, many = (policy.EdgePolicy(D, H, seed=2) for _ in range(2))
    training.OptimizedPPO(one, lr=0.5, epochs=2, target_kl=None).step(samples, vertices)
    out = training.OptimizedPPO(many, lr=0.5, epochs=9, target_kl=1e-6).step(samples, vertices)
    assert out["epochs"] == 2 and np.allclose(one.flat, many.flat)  # the first epoch is measured at the old policy


def alone(t, rows, x, workers):
    """All of a step's rows as one task has them, in the order that ``workers`` tasks number them."""
    held = rows.orderBy(F.pmod(F.xxhash64("row"), F.lit(workers)), "row").toPandas()
    columns = {c: held[c].to_numpy() for c in ("from_id", "to_id", "action", "advantages", "freqs")}
    return training.Shard(Ring(), columns | {"row": np.arange(len(held))}, np.arange(len(x)), x)


def test_mini_batches(data):
    """Batches of exactly the size told, dealt anew in each epoch; the stage's numbers are those of plain numpy."""
    x, _, samples, vertices = data
    make = lambda: training.PPO(policy.EdgePolicy(D, H, seed=2), samples_in_batch=25, epochs=3, lr=0.01, workers=3, target_kl=9.0)
    one, many = make(), make()
    rows = many.rows(samples)
    shard = alone(one, rows, x, 3)
    dealt = [list(one.batches(shard, e)) for e in (0, 1)]
    assert [len(b) for b in dealt[0]] == [25] * 4 + [20] and all(sorted(np.concatenate(d)) == list(range(120)) for d in dealt)
    assert [list(b) for b in dealt[0]] != [list(b) for b in dealt[1]]
    told, want = many.stage(rows, vertices), one.update(shard)
    assert many._t == one._t == 15 and np.allclose(many.policy.flat, one.policy.flat, atol=1e-12)
    assert all(np.isclose(told[k], want[k]) for k in want) and np.allclose(many._s, one._s)


def test_places():
    for n in (1, 2, 7, 1000, 4097):
        got = training.places(np.arange(n), n, (1, 2, 3))
        assert sorted(got) == list(range(n))
    far = np.abs(np.diff(training.places(np.arange(4096), 4096, (0, 0, 1)))).mean()
    assert 1200 < far < 1530  # a third of the length, as in a random order


def test_ring():
    """Tasks that are threads: totals of all sizes of arrays, the same bits everywhere."""
    size, told = 4, [None] * 4
    meet = threading.Barrier(size)

    def task(rank):
        def gather(x):
            told[rank] = x
            meet.wait()
            return list(told)

        ring = Ring(rank, ("127.0.0.1",) * size, gather, b"secret")
        rng = np.random.default_rng(rank)
        got = [ring.total(rng.normal(size=n)) for n in (0, 1, 3, 4, 1001, 300_000)] + [ring.total(np.arange(5) * rank)]
        ring.close()
        return got

    with concurrent.futures.ThreadPoolExecutor(size) as pool:
        out = list(pool.map(task, range(size)))
    rngs = [np.random.default_rng(r) for r in range(size)]
    want = [sum(r.normal(size=n) for r in rngs) for n in (0, 1, 3, 4, 1001, 300_000)]
    assert all(np.allclose(a, b) for a, b in zip(out[0], want, strict=False)) and out[0][-1].tolist() == [0, 6, 12, 18, 24]
    assert all(a.tobytes() == b.tobytes() for o in out[1:] for a, b in zip(out[0], o, strict=True))


def test_steps_without_samples(data):
    """No samples, none of known vertices, and fewer than tasks: defined results, and the rest of the samples counts alone."""
    *_, samples, vertices = data
    for some in (samples.limit(0), samples.withColumn("to_id", F.lit(99))):
        t = training.PPO(policy.EdgePolicy(D, H, seed=2), workers=2)
        before = t.policy.flat.copy()
        assert t.step(some, vertices)["loss"] == 0.0 and np.array_equal(t.policy.flat, before)
    a, b = (training.PPO(policy.EdgePolicy(D, H, seed=2), workers=w, epochs=2) for w in (1, 3))
    two = samples.limit(2).cache()
    a.step(two, vertices)
    b.step(two.unionByName(two.withColumn("from_id", F.lit(77))), vertices)
    assert np.allclose(a.policy.flat, b.policy.flat, atol=1e-12)


@pytest.mark.parametrize("kind", [training.TRPO, training.EfficientTRPO])
def test_trpo(data, kind):
    x, rows, samples, vertices = data
    net = policy.EdgePolicy(D, H, seed=2)
    reg = 0.02 if kind is training.EfficientTRPO else 0.0
    inputs, act, adv, w = arrays(x, rows, False, True)
    old, start = net.logp(inputs), net.flat.copy()
    i = np.arange(len(act))

    def parts(flat):
        logp = net.logp(inputs, flat)
        loss = -(np.exp(logp[i, act] - old[i, act]) * adv).sum() / w.sum()
        entropy = (w * -(np.exp(logp) * logp).sum(1)).sum() / w.sum()
        return loss - reg * entropy, (w * (np.exp(logp) * (logp - old)).sum(1)).sum() / w.sum()

    # d theta / d parameters by differences gives the Fisher matrix
    j = np.stack([(np.exp(net.logp(inputs, start + e)[:, 0]) - np.exp(net.logp(inputs, start - e)[:, 0])) / 2e-6 for e in np.eye(len(start)) * 1e-6], 1)
    t = np.exp(old[:, 0])
    fisher = (j * (w / (t * (1 - t)))[:, None]).T @ j / w.sum()
    product = lambda v: fisher @ v + 0.1 * v
    way = training.conjugate_gradient(product, -numeric(lambda p: parts(p)[0], start), 10)
    want = training.line_search(parts, start, way / np.sqrt(way @ product(way) / 2 / 0.01), 0.01, parts(start)[0])
    assert not np.allclose(want, start)
    out = kind(net, **({"entropy_reg": reg} if reg else {})).step(samples, vertices)
    assert np.allclose(net.flat, want, atol=1e-4)
    assert np.allclose((out["loss"], out["kl"]), parts(want), atol=1e-5)


def test_trpo_leading_rows(data):
    x, _, samples, _ = data
    t = training.EfficientTRPO(policy.EdgePolicy(D, H, seed=2), samples_in_batch=10, fvp_speedup=3, fvp_min_batches=2)
    shard = alone(t, t.rows(samples), x, 1)
    u = V.uniform(F.col("from_id"), F.col("to_id"), F.col("action"), 0)
    rows = L.aggregate_samples(samples).orderBy(F.desc(L.gumbel_key(F.col("freqs"), u)))
    keyed = [tuple(r) for r in rows.select("from_id", "to_id", "action").collect()]
    take = max(-(-len(keyed) // 10) // 3, 2) * 10
    got = t.leading(shard)
    assert sorted(zip(*(shard.held[c][got].tolist() for c in ("from_id", "to_id", "action")), strict=True)) == sorted(keyed[:take])
    assert training.EfficientTRPO(t.policy, fvp_type="forward").leading(shard) is None
    tied = shard.first(np.repeat([1.0, -2.0, 0.5], [10, 20, shard.n - 30]), 12)
    assert np.flatnonzero(tied).tolist() == [*range(10), 30, 31]


def test_baselines_of_queries(spark):
    b = L.SessionBaseline.of(spark.range(3))
    s = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0)], "session_index long, reward double")
    b.update(s.where("session_index = 0"), spark.createDataFrame([(0,), (2,)], "query_id long"))
    assert sorted(map(tuple, b.table.collect())) == [(0, 2.0, True), (1, 0.0, False), (2, 0.0, True)] and b.mean_reward == 2.0 and b.step == 0
    b.update(s.where("session_index = 1"), spark.createDataFrame([(1,)], "query_id long"))
    assert sorted(map(tuple, b.table.collect())) == [(0, 2.0, False), (1, 4.0, False), (2, 0.0, False)] and b.step == 1
    assert sorted((r["session_index"], r["advantage"]) for r in b.advantages(s).collect()) == [(0, -1.0), (0, 1.0), (1, 0.0)]


def experiment(spark, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, D))
    d = ((x[:, None] - x) ** 2).sum(2) + np.eye(40) * 99
    vertices = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    edges = spark.createDataFrame([(i, s, int(v)) for i in range(40) for s, v in enumerate(np.argsort(d[i])[:4])], "from_id long, slot int, to_id long")
    q = rng.normal(size=(30, D))
    near = ((q[:, None] - x) ** 2).sum(2).argmin(1)
    queries = spark.createDataFrame([(i, v.tolist(), [int(n)]) for i, (v, n) in enumerate(zip(q, near, strict=True))], "id long, vec array<double>, truth array<long>")
    engine = SessionEngine(vertices, edges, k=1, ef=4, edge_patience=2, n_hop_virtual=3)
    run = Experiment(engine, training.PPO(policy.EdgePolicy(D, H, seed=1), epochs=1), L.SessionBaseline.of(queries), V.reward_max_dcs)
    return run, queries


def state(run):
    """Its numbers, apart from names; sums over partitions may be added in any order."""
    edges, told = (np.array(sorted(map(tuple, df.collect())), float).ravel() for df in (run.engine.edges, run.baseline.table))
    return [run.step, *run.trainer.policy.flat, *edges, *told, *(v for *_, v in sorted(run.log))], sorted(r[:3] for r in run.log)


def test_run_goes_on_from_a_checkpoint(spark, tmp_path):
    run, queries = experiment(spark)
    run.train_step(queries)
    run.save(str(tmp_path / "one"))
    run.train_step(queries)
    other, _ = experiment(spark)
    other.restore(str(tmp_path / "one"))
    other.train_step(queries)
    (got, names), (want, same) = state(other), state(run)
    assert names == same and np.allclose(got, want, rtol=1e-9)
    assert {r["name"] for r in run.metrics().where("prefix = 'train'").collect()} >= {"mean_reward", "recall_at_1", "loss", "kl", "entropy", "baseline", "advantage"}
    assert run.history().count() == 2


def test_training_loop(spark, tmp_path):
    run, queries = experiment(spark)
    best = run.run(queries, queries, queries, str(tmp_path), max_steps=4, batch_size=20, val_every=2, save_every=2, evolve_every=3)
    assert best in (2, 4) and run.step == best
    assert len(list((tmp_path / "4").glob("v*/edges"))) == 1


def written(spark):
    """All tables that are left in the shared folder."""
    at = Path(durable.shared_dir(spark).removeprefix("file://")) / "simloom"
    return {p.name for p in at.iterdir()} if at.exists() else set()


def test_steps_leave_nothing(spark):
    """The disk stays flat over steps with evolution and evaluation."""
    run, queries = experiment(spark)
    run.trainer = training.OptimizedPPO(run.trainer.policy, samples_in_batch=8)
    before, sizes = written(spark), []
    for step in range(4):
        run.train_step(queries if step % 2 else queries.limit(10))
        if step == 2:
            run.engine.update_edges(run.trainer.policy)
            run.evaluate(queries)
        sizes.append(len(written(spark) - before))
    assert max(sizes) <= 4  # edges, virtual edges, baseline, sessions
    run.close()
    assert not written(spark) - before


@pytest.mark.parametrize("kind", [training.PPO, training.EfficientTRPO])
def test_jobs_of_a_step(spark, data, kind):
    """As many for a hundred times the samples, and nothing left."""
    counts, before = [], written(spark)
    for n in (30, 3000):
        rows = spark.range(n).select((F.col("id") % 12).alias("from_id"), (F.col("id") % 11).alias("to_id"), (F.col("id") % 2).alias("action"), F.rand(1).alias("advantage"))
        spark.sparkContext.setJobGroup(f"step{n}", "one step")
        kind(policy.EdgePolicy(D, H), samples_in_batch=8, workers=2).step(rows, data[-1])
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"step{n}")))
        spark.sparkContext.setJobGroup("", "")
    print("jobs", counts)
    assert max(counts) <= (16 if kind.aggregate else 8) and abs(counts[0] - counts[1]) <= 2 and written(spark) == before  # caching and adaptive plans save some


def test_save_that_breaks_off(spark, tmp_path, monkeypatch):
    """A save that fails half-way leaves the checkpoint before; a whole one takes its place."""
    run, queries = experiment(spark)
    folder = str(tmp_path / "run")
    run.train_step(queries)
    run.save(folder)
    kept, step = run.trainer.policy.flat.copy(), run.step
    run.train_step(queries)
    with monkeypatch.context() as m:
        m.setattr(Experiment, "metrics", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            run.save(folder)
    assert len(list((tmp_path / "run").iterdir())) == 2
    other, _ = experiment(spark)
    other.restore(folder)
    assert other.step == step and np.array_equal(other.trainer.policy.flat, kept)
    run.save(folder)
    assert np.array_equal(experiment(spark)[0].restore(folder).trainer.policy.flat, run.trainer.policy.flat)
    with pytest.raises(FileNotFoundError):
        run.restore(str(tmp_path / "none"))


def test_engine_edges(spark):
    run, queries = experiment(spark)
    e = run.engine
    assert e.max_degree == 4
    prepared = e.prepare(policy.EveryEdge())
    assert prepared.groupBy("from_id").count().agg(F.max("count")).first()[0] <= 7
    assert e.prepare(policy.EveryEdge(), evaluate=True).count() == 160
    e.edges = e.edges.withColumn("confidence", F.when(F.col("slot") == 0, F.lit(-2.0)).otherwise(F.lit(0.0)))
    assert e.update_edges(run.trainer.policy) == 40  # every vertex has candidates for its free slot
    assert e.edges.count() == 160 and e.edges.where("confidence < 0").count() == 0
    with pytest.raises(ValueError):
        SessionEngine(e.vertices, e.edges, graph_type="hnsw")


def test_names_batches_and_workers(spark):
    assert name_of("{data}_{k}", data="d", k=1) == "d_1"
    got = [sorted(r["id"] for r in b.collect()) for b in minibatches(spark.range(50), 20, cycle=False)]
    assert sorted(v for b in got for v in b) == list(range(50)) and [len(b) for b in got] == [20, 20, 10]
    assert got[0] != list(range(20)) and [sorted(r["id"] for r in b.collect()) for b in minibatches(spark.range(50), 30, shuffle=False, cycle=False)] == [list(range(30)), list(range(30, 50))]
    rounds = itertools.islice(minibatches(spark.range(50), 25), 4)
    first, _, second, _ = (sorted(r["id"] for r in b.collect()) for b in rounds)
    assert first != second
    assert worker_count(3) == 3 and worker_count(-1) == worker_count(None)


def test_training_queries_read_written_neighbours(spark, monkeypatch, tmp_path):
    """The graph and the truth of the train_step queries are written tables, not worked out again by every job."""
    from pyspark.sql import functions as F

    from simloom import registry
    from simloom.plans.experiment import Experiment

    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i) for i in range(3))).cast("array<float>").alias("embedding"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    told = []
    monkeypatch.setattr(Experiment, "train_step", lambda self, queries: (told.append(queries), self.log.append((0, "train", "x", 0.0))))
    registry._train(spark, str(tmp_path), registry.training.PPO)
    assert "MapInArrow" not in told[0]._jdf.queryExecution().toString()
