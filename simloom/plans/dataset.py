"""The data of an experiment: vectors, query sets, normalisation, ground truth and the initial graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions import vectors as V
from simloom.operators import knn
from simloom.sources import vecs

ID_RANGE = 1 << 16


def dense_ids(df: DataFrame, key: str = "vec_id", out: str = "id") -> DataFrame:
    """``df`` with ids from 0 in order of the integer ``key``.

    Ranks are taken inside ranges of the key and added to the rows of the
    ranges before, so no task sorts the whole table.
    """
    part = F.floor(F.col(key) / ID_RANGE)
    sizes = df.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    ranked = df.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    return ranked.join(sizes, "_part").withColumn(out, (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_part", "_before", "_n")


def normalise(vertices: DataFrame, others: list[DataFrame], how: str = "global") -> list[DataFrame]:
    """Scale by the mean norm of the vertices ('global'), each by its own norm ('instance'), or not ('none')."""
    if how == "none":
        return [vertices, *others]
    if how == "instance":
        return [d.withColumn("vec", V.scaled("vec", V.norm("vec"))) for d in (vertices, *others)]
    if how != "global":
        raise ValueError(f"unknown normalisation {how!r}")
    mean = vertices.agg(F.avg(V.norm("vec"))).first()[0]
    return [d.withColumn("vec", V.scaled("vec", F.lit(mean))) for d in (vertices, *others)]


def split(queries: DataFrame, val_size: int) -> DataFrame:
    """``queries`` with column split: the last ``val_size`` ids are val, the rest train; 0 gives no val."""
    n = queries.count()
    return queries.withColumn("split", F.when(F.col("id") >= n - val_size, F.lit("val")).otherwise(F.lit("train")))


@dataclass
class GraphDataset:
    """vertices(id, vec), queries(split, id, vec), truth(split, query_id, rank, vertex_id), edges(from_id, slot, to_id)."""

    vertices: DataFrame
    queries: DataFrame
    truth: DataFrame
    edges: DataFrame
    initial_vertex_id: int = 0
    max_degree: int = 0

    @classmethod
    def load(
        cls, spark: SparkSession, vertices_path: str, edges_path: str, train_queries_path: str, test_queries_path: str, train_gt_path: str | None = None, test_gt_path: str | None = None,
        vertices_size: int | None = None, train_queries_size: int | None = None, val_queries_size: int = 0, test_queries_size: int | None = None, ground_truth_n_neighbors: int = 1,
        initial_vertex_id: int = 0, normalization: str = "global", graph_type: str = "nsw", metric: str = "l2",
    ) -> "GraphDataset":
        limit = lambda n: {} if n is None else {"limit": str(n)}
        if graph_type not in ("nsw", "nsg"):
            raise ValueError("graph_type is nsw or nsg")
        lists = vecs.read(spark, edges_path, "adjacency" if graph_type == "nsw" else "nsg", **limit(vertices_size))
        widest = lists.agg(F.coalesce(F.max(F.size("neighbors")), F.lit(0))).first()[0]
        if graph_type == "nsg":
            head = vecs.nsg_header(edges_path)
            initial_vertex_id, widest = head["enterpoint_node"], max(widest, head["width"])
        vertices = vecs.read(spark, vertices_path, "fvecs", **limit(vertices_size))
        train = vecs.read(spark, train_queries_path, "fvecs", **limit(train_queries_size))
        test = vecs.read(spark, test_queries_path, "fvecs", **limit(test_queries_size))
        vertices, train, test = normalise(vertices, [train, test], normalization)
        queries = split(train, val_queries_size or 0).unionByName(test.withColumn("split", F.lit("test")))

        def truth(queries: DataFrame, path: str | None) -> DataFrame:
            if path:
                rows = vecs.read(spark, path, "ivecs").select(F.col("id").alias("query_id"), F.posexplode(F.slice("vec", 1, ground_truth_n_neighbors)).alias("rank", "vertex_id"))
                return rows.select("query_id", "rank", F.col("vertex_id").cast("long").alias("vertex_id"))
            return knn.nearest(vertices, queries, ground_truth_n_neighbors, metric).select("query_id", "rank", "vertex_id")

        parts = [truth(train, train_gt_path).withColumn("split", F.lit("train")), truth(test, test_gt_path).withColumn("split", F.lit("test"))]
        edges = lists.select(F.col("id").alias("from_id"), F.posexplode("neighbors").alias("slot", "to_id"))
        return cls(vertices, queries, parts[0].unionByName(parts[1]), edges, initial_vertex_id, widest)
