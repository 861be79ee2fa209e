"""Order over whole tables without a task that sees all rows.

Rows are dealt to ranges of the order, sorted in each and written with their
range and place. What depends on all rows before a row is then worked out from
one summary a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.plans import durable

RANGE_ROWS = 1 << 16


def ordered(df: DataFrame, *by: Column | str, rows: int | None = None) -> DataFrame:
    """``df`` as a written table with columns _range and _place (from 0), both in the order of ``by``.

    A range has about ``rows`` rows; those that are equal in ``by`` are in one.
    """
    n = max(1, -(-df.count() // (rows or RANGE_ROWS)))
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return durable.table(dealt.withColumn("_range", F.shiftright(at, 33).cast("int")).withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")


def ranked(df: DataFrame, *by: Column | str, out: str = "rank", rows: int | None = None) -> DataFrame:
    """``df`` with the rank of each row, from 0, in the order of ``by``, which is total."""
    told = ordered(df, *by, rows=rows)
    before, starts = 0, []
    for r in told.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():  # a row for RANGE_ROWS rows
        starts.append((r["_range"], before))
        before += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return told.join(F.broadcast(first), "_range").withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
