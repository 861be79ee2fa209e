"""Queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from simloom import registry

DATA = "/root/testdata/sf0.001"
NAMES = ["session_summary", "graph_edges", "edge_batches", "edge_keep_prob", "freeze_override", "edges_evolved", "beam_search_pruned", "session_samples", "enterpoint_descent", "gumbel_order", "session_baseline", "mean_baseline", "trpo_surrogate", "ppo_surrogate", "graph_export", "nsg_roundtrip", "reward_trailing_mean", "reward_ewm", "reward_none", "advantage_standardized", "edge_confidence", "graph_plot_tables", "graph_plot_vertices", "adjacency_roundtrip", "fvecs_roundtrip"]


def rows(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    df = registry.queries()[name](spark, DATA)
    columns = ", ".join(sorted(df.columns))
    want = rows(con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall())
    got = rows(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - float(y)) < 1e-9) for x, y in zip(a, b, strict=True)), (a, b)
