"""Searching a stream of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from simloom.operators import beam


def search_stream(queries: DataFrame, vertices: DataFrame, edges: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Search each micro-batch of ``queries`` (id, vec) and hand the sessions to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(beam.search(vertices, edges, batch, **options), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
