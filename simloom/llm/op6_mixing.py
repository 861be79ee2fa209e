"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks. Block j (from 1)
of a source of weight w gets release time floor((j-1)/w) and deadline
ceil(j/w); earliest deadline first among the released blocks gives each slot
one block. After t slots every source has had more than w t - 1 and fewer than
w t + 1 blocks. Weights are exact fractions, and a phase is scheduled to its
end, so the bound holds against the target weights however long the corpus is.
A document's slot follows from its rank by a join with the schedule, so no
global sort is needed.

Every document is placed exactly once. When a source runs out, a new phase
starts in which the others' weights are scaled to sum to one; the bound holds
in each phase from its first slot on.

Native: DataFrame functions only. A block has BLOCK documents, and more in a
corpus of more than BLOCK * MOST_BLOCKS: so the schedule, one row for each block,
has MOST_BLOCKS rows and one for each source at most, made on the driver and
broadcast.

Defined results: a null source is a source of its own; sources without weight
or of weight 0 follow at the end, in equal shares. A null doc_id is placed like
any other; repeated rows are placed one by one, equal ones in any order. An
empty table gives no rows. Other columns are kept out of the result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, MOST_BLOCKS, BUCKET_ROWS = 64, 1 << 18, 4096
_LONG = 2**63 - 1


def shares(weights: dict, period: int) -> dict:
    """Whole numbers of slots summing to ``period``, one at least, by largest remainder."""
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], str(k)))
    i = 0
    while (d := period - sum(out.values())) != 0:
        k = order[i % len(order)] if d > 0 else max(out, key=lambda k: (out[k] - exact[k], out[k], str(k)))
        out[k] += 1 if d > 0 else -1
        i += 1
    return out


def exact(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of ``weights``."""
    parts = {k: Fraction(w) for k, w in weights.items()}
    unit = math.lcm(*(f.denominator for f in parts.values()))
    return {k: int(f * unit) for k, f in parts.items()}


def edf(slots: dict, period: int, rest: dict | None = None) -> list[tuple]:
    """(source, q) of each slot of a period: the q-th block (from 0) of the source.

    With ``rest``, the blocks of each source, it ends when a source runs out.
    """
    waiting = [((0, str(k)), k, 0) for k in slots]  # by release
    heapq.heapify(waiting)
    ready: list[tuple] = []  # by deadline
    out = []
    for t in range(period if rest is None else sum(rest.values())):
        while waiting and waiting[0][0][0] <= t:
            _, k, q = heapq.heappop(waiting)
            heapq.heappush(ready, ((-(-(q + 1) * period // slots[k]), str(k)), k, q))
        _, k, q = heapq.heappop(ready)
        out.append((k, q))
        if rest is not None and q + 1 == rest[k]:
            break
        if rest is not None or q + 1 < slots[k]:
            heapq.heappush(waiting, (((q + 1) * period // slots[k], str(k)), k, q + 1))
    return out


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """(source, block, slot, phase, release, deadline) of every block, in phases until every source has run out."""
    rest, done, out, phase = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), [], 0
    while rest:
        active = {k: weights.get(k) or 0 for k in rest}
        active = {k: w for k, w in active.items() if w > 0} or dict.fromkeys(rest, 1)
        slots = exact(active)
        period = sum(slots.values())
        for k, q in edf(slots, period, rest):
            out.append((k, done[k] + q, len(out), phase, min(q * period // slots[k], _LONG), min(-(-(q + 1) * period // slots[k]), _LONG)))
        for row in out[sum(done.values()) :]:
            done[row[0]] += 1
            rest[row[0]] -= 1
        rest = {k: n for k, n in rest.items() if n}
        phase += 1
    return out


def mix(docs: DataFrame, weights: dict | None = None, block: int | None = None) -> DataFrame:
    """(doc_id, source, block, slot, position, phase, release, deadline) of every row of ``docs``.

    ``weights`` maps sources to target weights; None takes the square roots of
    the sources' document counts. ``slot`` orders the blocks of the mix and
    ``position`` the documents of a block; ``release`` and ``deadline`` are in
    slots of the phase. ``block`` is the number of documents of a block.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", "source", key.alias("_key"), F.xxhash64("doc_id", F.lit(5)).alias("_h"))
    counts = {r[0]: r[1] for r in rows.groupBy("_key").count().collect()}  # one row for each source
    if not counts:
        return rows.select("doc_id", "source", *(F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")), F.lit(0).alias("phase"), *(F.lit(0).cast("long").alias(c) for c in ("release", "deadline")))
    block = block or max(BLOCK, -(-sum(counts.values()) // MOST_BLOCKS))
    target = {k: n**0.5 for k, n in counts.items()} if weights is None else {"" if k is None else f"={k}": float(w) for k, w in weights.items()}
    plan = schedule({k: -(-n // block) for k, n in counts.items()}, target)
    kinds = {"_key": pa.string(), "block": pa.int64(), "slot": pa.int64(), "phase": pa.int32(), "release": pa.int64(), "deadline": pa.int64()}
    places = spark.createDataFrame(pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), zip(*plan, strict=True), strict=True)}))
    # ranks in hash order without sorting a source in one task: ranks in fine buckets, plus the rows of the buckets before
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    top = F.shiftright("_h", 32) + F.lit(2**31)  # 0 up to 2**32, in the order of the hash
    rows = rows.withColumn("_bucket", F.shiftright(top * F.lit(buckets), 32))
    sizes = rows.groupBy("_key", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_key", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy("_h", "doc_id"))).join(sizes, ["_key", "_bucket"])
    rank = F.col("_before") + F.col("_n") - 1
    cut = ranked.select("doc_id", "source", "_key", F.floor(rank / block).cast("long").alias("block"), (rank % block).cast("long").alias("position"))
    placed = cut.join(F.broadcast(places), ["_key", "block"])
    return placed.select("doc_id", "source", "block", "slot", "position", "phase", "release", "deadline")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The place of every document in the mix."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
