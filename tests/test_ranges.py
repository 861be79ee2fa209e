"""What depends on the order of a whole table, range by range, against plain loops; files written by many tasks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.operators import beam, edges as E, knn, learning as L
from simloom.plans import dataset, ranks
from simloom.sources import vecs

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("rows", [1, 9])
def test_batches_of_ranges(spark, monkeypatch, rows):
    """64 ranges of one vertex and a few of nine, vertices that fill a batch alone, a hub."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    degree = [*RNG.integers(1, 6, 60).tolist(), 40, 1, 1, 3]
    edges = spark.createDataFrame([(i, s, 0) for i, d in enumerate(degree) for s in range(d)], "from_id long, slot int, to_id long")
    for size in (0, 1, 4, 13, 10**6):
        want, batch, held = [], 0, 0
        for i, d in enumerate(degree):
            want.append((i, d, batch))
            held += d
            if held >= size:
                batch, held = batch + 1, 0
        assert sorted(map(tuple, E.edge_batches(edges, size).collect())) == want


def test_histories(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 7)
    r = RNG.normal(size=50)
    history = spark.createDataFrame([(i * 3, float(x)) for i, x in enumerate(r)][::-1], "step long, reward double")
    q = 1 - 2 / 11
    want = [sum(r[j] * q ** (i - j) for j in range(i + 1)) / sum(q ** (i - j) for j in range(i + 1)) for i in range(50)]
    got = sorted(map(tuple, L.adjusted_ewm(history, 10).collect()))
    assert [s for s, _ in got] == list(range(0, 150, 3)) and np.allclose([v for _, v in got], want)
    for n in (1, 3, 7, 20, 100):
        got = sorted(map(tuple, L.trailing_mean(history, n).collect()))
        assert len(got) == 50 and np.allclose([v for _, v in got], [r[max(0, i - n + 1) : i + 1].mean() for i in range(50)])
    assert not L.adjusted_ewm(history.limit(0)).count() and not L.trailing_mean(history.limit(0)).count()


def test_places_in_weighted_order(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 6)
    rows = [(int(i), float(k)) for i, k in enumerate(RNG.integers(0, 5, 40))]
    got = L.weighted_order(spark.createDataFrame(rows, "id long, key double"), "key", "id").collect()
    assert [(r["id"], r["key"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(r["place"] for r in got) == list(range(1, 41))


def test_files_of_many_tasks(spark, tmp_path):
    """64 ranges give the same bytes as one, and as plain packing; ragged and empty lists; a header."""
    lists = [RNG.integers(0, 99, int(n)).tolist() for n in RNG.integers(0, 6, 64)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)][::-1], "id long, neighbors array<long>").repartition(5)
    plain = b"".join(struct.pack(f"<i{len(v)}i", len(v), *v) for v in lists)
    for size in (1, 1 << 20):
        vecs.write(frame, str(tmp_path / f"a{size}"), "adjacency", part_bytes=size)
        assert (tmp_path / f"a{size}").read_bytes() == plain
        vecs.write(frame, f"file://{tmp_path}/n{size}", "nsg", part_bytes=size, width="5", enterpoint="3")
        assert (tmp_path / f"n{size}").read_bytes() == struct.pack("<II", 5, 3) + plain
    assert sorted(map(tuple, vecs.read(spark, f"file:{tmp_path}/a1", "adjacency").collect())) == list(enumerate(lists))
    x = RNG.normal(size=(64, 3)).astype(np.float32)
    vecs.write(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), str(tmp_path / "f"), "fvecs", part_bytes=16)
    assert (tmp_path / "f").read_bytes() == b"".join(struct.pack("<i3f", 3, *v) for v in x)
    vecs.write(frame.limit(0), str(tmp_path / "none"), "adjacency")
    assert (tmp_path / "none").read_bytes() == b"" and not vecs.read(spark, str(tmp_path / "none"), "adjacency").count()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a1", f"a{1 << 20}", "f", "n1", f"n{1 << 20}", "none"]
    with pytest.raises(ValueError, match="mounted"):
        vecs.write(frame, "hdfs://x/y", "adjacency")


def test_records_of_a_ragged_file(spark, tmp_path):
    """Pieces of a few words find the records that one walk finds: empty and long lists, ids that look like lengths, a header, a limit."""
    lists = [RNG.integers(0, 9, int(n)).tolist() for n in RNG.integers(0, 7, 300)]
    lists[17], lists[40:60], lists[-1] = list(range(200)), [[]] * 20, []
    plain = b"".join(struct.pack(f"<i{len(v)}i", len(v), *v) for v in lists)
    for head, form in ((b"", "adjacency"), (struct.pack("<II", 7, 2), "nsg")):
        path = tmp_path / form
        path.write_bytes(head + plain)
        for part, first in ((4, 1), (64, 3), (64, 16), (400, 100), (1 << 20, 1 << 16)):
            spans = vecs.find_records(spark, str(path), len(head), part, first)
            assert spans[0].tolist()[::2] == [len(head), 0] and (spans[1:, 0] == spans[:-1, 0] + spans[:-1, 1]).all() and spans[-1, :2].sum() == len(head + plain)
            assert [v.tolist() for o, n, i in spans for v in vecs.parse_records((head + plain)[o : o + n], "<i4")] == lists
            assert all(len(vecs.parse_records((head + plain)[o : o + n], "<i4")) == j - i for (o, n, i), j in zip(spans.tolist(), [*spans[1:, 2].tolist(), 300], strict=True))
        got = vecs.read(spark, str(path), form, partbytes="64")
        assert got.rdd.getNumPartitions() > 10 and sorted(map(tuple, got.collect())) == list(enumerate(lists))
        assert sorted(map(tuple, vecs.read(spark, str(path), form, partbytes="64", limit=45).collect())) == list(enumerate(lists))[:45]
    (tmp_path / "broken").write_bytes(plain[:-8])
    with pytest.raises(ValueError, match="broken"):
        vecs.find_records(spark, str(tmp_path / "broken"), 0, 64)


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_descent(spark, monkeypatch, metric):
    """Both ways of walking down, against a plain walk; ties go to the smaller id."""
    x = RNG.integers(0, 4, (60, 3)).astype(float)
    q = RNG.normal(size=(9, 3)) + 2
    vertices = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, vec array<double>")
    levels = [{v: [int(w) for w in RNG.choice(range(0, 60, s), 4) if w != v] for v in range(0, 60, s)} for s in (12, 3)]
    table = spark.createDataFrame([(i, v, w) for i, g in enumerate(levels) for v, near in g.items() for w in near], "level int, from_id long, to_id long")
    far = lambda a, b: -float((a * b).sum()) if metric == "dot" else float(((a - b) ** 2).sum())
    want = []
    for i, v in enumerate(q):
        at = 0
        for g in levels:
            while near := sorted((far(v, x[w]), w) for w in g.get(at, [])):
                if near[0][0] >= far(v, x[at]):
                    break
                at = near[0][1]
        want.append((i, at))
    assert sorted(map(tuple, beam.enter(vertices, table, queries, 0, metric).collect())) == want
    monkeypatch.setattr(beam, "SMALL", 0)
    assert sorted(map(tuple, beam.enter(vertices, table, queries, 0, metric).collect())) == want


def test_plot_styles(spark):
    """Styles by edge and by vertex, one for all, defaults where a style is null, hover columns."""
    points = spark.createDataFrame([(0, 0.0, 1.0, "a", None), (1, 2.0, 3.0, "b", "#123456")], "id long, x double, y double, name string, tint string")
    edges = spark.createDataFrame([(0, 1, 0.5, "#000001"), (1, 0, None, "#000002")], "from_id long, to_id long, prob double, paint string")
    seg, dots = E.plot_tables(edges, points, {"alpha": F.col("prob"), "color": F.col("paint"), "dash": "dotted"}, {"color": F.col("tint"), "radius": 3.0}, ["name"])
    assert sorted(tuple(r) for r in seg.select("from_id", "x0", "y1", "color", "alpha", "width", "dash").collect()) == [(0, 0.0, 3.0, "#000001", 0.5, 1.0, "dotted"), (1, 2.0, 1.0, "#000002", 1.0, 1.0, "dotted")]
    assert sorted(tuple(r) for r in dots.select("id", "color", "marker", "radius", "name").collect()) == [(0, "#1f77b4", "circle", 3.0, "a"), (1, "#123456", "circle", 3.0, "b")]
    plain, _ = E.plot_tables(edges, points)
    assert {r["color"] for r in plain.collect()} == {"#aaaaaa"}


def test_confidence_of_some_edges(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 0)], "from_id long, slot int, to_id long")
    known = spark.createDataFrame([(0, 2, -2), (5, 5, 1)], "from_id long, to_id long, confidence int")
    assert sorted((r["from_id"], r["to_id"], r["confidence"]) for r in E.with_confidence(edges, known).collect()) == [(0, 1, 0.0), (0, 2, -2.0), (1, 0, 0.0)]


def test_sessions_without_samples_and_no_normalisation(spark):
    """Sessions that leave no sample count in the summary and not in the samples; 'none' leaves vectors as they are."""
    one = "query_id long, best_ids array<long>, truth array<long>, dcs int, hops int, samples array<struct<hop:int,slot:int,from_id:long,to_id:long,action:int>>"
    sessions = spark.createDataFrame([(0, [1], [1], 4, 2, []), (1, [2], [3], 8, 4, [(0, 0, 0, 2, 1)])], one)
    assert tuple(L.summary(sessions).first())[:3] == (2, 0.5, 6.0)
    assert [r["query_id"] for r in beam.samples_of(sessions).collect()] == [1]
    b = L.MeanBaseline()
    b.update(beam.samples_of(sessions).select(F.col("query_id").alias("session_index"), F.lit(6.0).alias("reward")), sessions)
    assert b.mean_reward == 3.0
    base = spark.createDataFrame([(0, [3.0, 4.0])], "id long, vec array<double>")
    kept = dataset.normalise(base, [base], "none")
    assert kept[0] is base and kept[1] is base
    with pytest.raises(ValueError):
        dataset.normalise(base, [], "other")
