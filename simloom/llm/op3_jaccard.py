"""N-gram Jaccard join in the metric space of shingle sets.

d(x, y) = 1 - Jaccard similarity is a metric. Documents x and y link when
d(x, y) <= R. The join is exact and works on distinct sets only (documents of
equal sets share a representative).

1. Regions. Sets are written in one global order, shingles that many documents
   share last, by their counts; two sets within R of each other share one of their first
   n - ceil(0.75 n) + 1 shingles. Documents that share such a shingle lie in one
   region; a document that shares none has no neighbour, which settles most.
2. Pivots. Each region's smallest document is its pivot; distances of members
   to their pivots are verified exactly. Members within R of a pivot are one
   class (regions come from shared shingles and not from nearest pivots: in high
   dimensions nearly all distances to free pivots are 1), so no pair
   among them needs to be looked at, however many copies a group has. A member
   whose counts of shingles in cells already put it beyond R of a pivot has its
   distance bounded by them, all others have theirs worked out from whole texts.
3. Windows. Members of a region that lie in different classes can link only if
   their distances to the pivot differ by at most R (triangle inequality), and
   their sizes by a quarter, and where the shared shingle stands in both orders
   bounds their overlap. While a region has more than ``SPLIT`` members in
   several classes, the join recurs with PIVOTS new pivots for the rest of it, and
   each member keeps its distances to all pivots of the region, so windows grow
   narrower in every level; a member near the bound of several windows takes
   part in each. New pivots are in turn central members, which share most shingles
   with most, so that many of a group of near copies are within R of one, and those
   of the smaller classes. After two levels that linked less than a PROGRESS-th of
   what they asked, pairs are compared instead. Each pair is met in the region of
   its first shared shingle.
   What is left is compared pair by pair inside its windows: first by counts of
   shingles in at most COARSE cells, then, where both sets are larger, in about as
   many cells as half the shingles, whose L1 distance can't exceed that of the sets, then by whole texts.

Nothing is dropped on the way: pivots and orders only decide which pairs need
no verification. The order's list of frequent shingles holds at most
``FREQUENT`` entries, by count over all documents (each batch of rows gives its
own repeated shingles); it doesn't change results.

Defined results: a null text and one without words have an empty set, size 0,
and link with nothing; a text of fewer than five words has one shingle, its
whole sequence. Rows of one doc_id should be equal; they count as one document
and each gets a row. Rows with a null doc_id get a null component_id. Extra
columns are ignored. ``docs`` is scanned several times, so it should be a table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm import kernels as K
from simloom.plans import durable

LINK, R = 75, 0.25  # per cent; the same as a distance
COARSE, CELLS = 256, 1 << 16
BUCKET_ROWS, HELD_ROWS, PACKED_ROWS, HELD_SHINGLES = 1 << 15, 1 << 17, 1 << 17, 1 << 20
FREQUENT, LOCAL, SPLIT, PROGRESS, PIVOTS, HEADS, BROADCAST_ROWS = 1 << 18, 3, 64, 4, 4, 16, 200_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _counts(s: np.ndarray, most: int) -> np.ndarray:
    """How many of a set's shingles fall in each cell, up to 255; a power of two of cells, about half as many as shingles."""
    k = min(most, 1 << max(6, (len(s) // 2).bit_length()))
    return np.minimum(np.bincount((s & np.uint64(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8)


def _folded(counts: np.ndarray, k: int) -> np.ndarray:
    """The counts in at most ``k`` cells."""
    if len(counts) <= k:
        return counts
    return np.minimum(counts.reshape(-1, k).sum(0, dtype=np.int64), 255).astype(np.uint8)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents share, sorted, at most FREQUENT, and their places in the order from rare to frequent."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[at, len(h)])
        return pa.RecordBatch.from_arrays([pa.array(_signed(h[at][n >= LOCAL])), pa.array(n[n >= LOCAL])], ["s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in K.sets(batch.column(0)):
                held.append(s)
                size += len(s)
                if size >= HELD_SHINGLES:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    counts = docs.select("text").where("text is not null").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    got = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toPandas()["s"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(got)
    return got[order], (len(got) - 1 - order).astype(np.uint32)


def profiles(docs: DataFrame, frequent: np.ndarray, place: np.ndarray) -> DataFrame:
    """(doc_id, n, sa, sb, prefix, coarse, cells): set size, two checks of the whole set, its first shingles, and how many fall in each of few and of many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sa, sb, pre, coarse, cells = [], [], [], [], [], []
            for s in K.sets(batch.column("text")):
                n.append(len(s))
                counts = _counts(s, CELLS)
                cells.append(counts.tobytes())
                coarse.append(_folded(counts, COARSE).tobytes())
                sa.append(s.sum(dtype=np.uint64))
                sb.append(np.bitwise_xor.reduce(K.mix(s * np.uint64(3))) if len(s) else np.uint64(0))
                if len(frequent) and len(s):
                    i = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    often = frequent[i] == s
                    s = np.concatenate([s[~often], s[often][np.argsort(place[i[often]])]])
                pre.append(s[: len(s) - -(-3 * len(s) // 4) + 1])
            at = np.r_[0, np.cumsum([len(p) for p in pre])]
            flat = np.concatenate(pre) if pre else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(_signed(np.array(sa, np.uint64))), pa.array(_signed(np.array(sb, np.uint64))), K.lists(_signed(flat), at), pa.array(coarse, pa.binary()), pa.array(cells, pa.binary())], ["doc_id", "n", "sa", "sb", "prefix", "coarse", "cells"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sa long, sb long, prefix array<long>, coarse binary, cells binary")


def shared_shingles(first: DataFrame, buckets: int) -> DataFrame:
    """(s, x, n, i): the places of those first shingles of (doc_id, n, prefix) that several documents have.

    Entries travel packed, in ``buckets`` ranges of s, a range a block of each
    mapper. A receiver holds HELD_ROWS entries of one range at a time, or twice
    those left over: beyond that the repeated ones are passed on, and their
    shingles remembered.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def blocks(s: np.ndarray, x: np.ndarray, n: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(s, kind="stable")
        s, x, n, i = s[order], x[order], n[order], i[order]
        bucket = (s >> shift).astype(np.int64)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        low = int(x.min())
        x, n, i = ((v.astype(np.min_scalar_type(int(v.max())))) for v in ((x - low).view(np.uint64), n, i))
        cut = [[bytes(v[a:b]) for a, b in zip(at, [*at[1:], len(s)], strict=True)] for v in (s, x, n, i)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(np.full(len(at), low)), *(pa.array(c, pa.binary()) for c in cut)], ["bucket", "low", "s", "x", "n", "i"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            count = np.diff(batch.column("prefix").offsets.to_numpy())
            s = batch.column("prefix").flatten().to_numpy().view(np.uint64)
            if not len(s):
                continue
            begin = np.cumsum(count) - count
            held.append((s, np.repeat(batch.column("doc_id").to_numpy(), count), np.repeat(batch.column("n").to_numpy(), count), np.arange(len(s)) - np.repeat(begin, count)))
            rows += len(s)
            if rows >= PACKED_ROWS:
                yield blocks(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield blocks(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most, now, often = [], 0, HELD_ROWS, None, np.zeros(0, np.uint64)

        def repeated() -> tuple[pa.RecordBatch, tuple, np.ndarray]:
            s, x, n, i = (np.concatenate(c) for c in zip(*held, strict=True))
            _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
            hit = (count > 1)[inverse] | np.isin(s, often)
            out = pa.RecordBatch.from_arrays([pa.array(_signed(s[hit])), *(pa.array(v[hit]) for v in (x, n, i))], ["s", "x", "n", "i"])
            return out, (s[~hit], x[~hit], n[~hit], i[~hit]), np.union1d(often, s[hit])

        for batch in batches:
            for bucket, low, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if held:
                        yield repeated()[0]
                    held, rows, most, now, often = [], 0, HELD_ROWS, bucket, np.zeros(0, np.uint64)
                s = np.frombuffer(packed[0], np.uint64)
                x, n, i = (np.frombuffer(v, f"u{len(v) // len(s)}").astype(np.int64) for v in packed[1:])
                held.append((s, x + low, n, i))
                rows += len(s)
                if rows >= most:
                    out, left, often = repeated()
                    held, rows, most = [left], len(left[0]), max(HELD_ROWS, 2 * len(left[0]))
                    yield out
        if held:
            yield repeated()[0]

    packed = first.mapInArrow(pack, "bucket long, low long, s binary, x binary, n binary, i binary")
    return packed.repartition(max(8, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(unpack, "s long, x long, n long, i long")


def one_row(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` with one row for each doc_id; ``repeated`` lists the doc_ids that have more, None means that none has."""
    if repeated is None:
        return rows
    return rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def attached(pairs: DataFrame, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``pairs`` (a written table with x and y) with ``columns`` of both documents, renamed and with the side's letter.

    Only rows that occur in a pair are moved: they are picked by a broadcast
    of the ids after these are counted, beyond ``BROADCAST_ROWS`` by a join.
    """
    out = pairs
    for side in "xy":
        ids = pairs.select(F.col(side).alias("doc_id")).distinct()
        picked = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
        out = out.join(picked.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{name}{side}") for c, name in columns.items())), side)
    return out


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with both texts, tx and ty."""
    return attached(pairs, texts, {"text": "t"})


def bounds(pairs: DataFrame, prof: DataFrame, column: str) -> DataFrame:
    """(x, y, low, finer): a lower bound of the distance by the counts in ``column``, and whether both have more than COARSE cells.

    The counts' L1 distance is at most the sets' symmetric difference, which is
    a seventh of the sizes' sum for a pair at distance R. Counts in more cells
    are folded first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            apart = np.empty(len(size), np.int64)
            for k, sides in enumerate(zip(batch.column("cx"), batch.column("cy"), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint8) for v in sides)
                a, b = _folded(a, len(b)), _folded(b, len(a))
                apart[k] = np.abs(a.astype(np.int16) - b).sum(dtype=np.int64)
            finer = np.minimum(batch.column("nx").to_numpy(), batch.column("ny").to_numpy()) >= 2 * COARSE  # as _counts deals them
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(2 * apart / np.maximum(size + apart, 1)), pa.array(finer)], ["x", "y", "low", "finer"])

    return attached(pairs.select("x", "y"), prof.select("doc_id", "n", F.col(column).alias("c")), {"n": "n", "c": "c"}).mapInArrow(run, "x long, y long, low double, finer boolean")


def measured(pairs: DataFrame, prof: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, low, high, link) of pairs (x, y): bounds of the distance, which are equal where it may be R or less."""
    far = F.col("low") > R + 1e-9
    closed = lambda told: told.where(far).select("x", "y", "low", F.lit(1.0).alias("high"), F.lit(False).alias("link"))
    coarse = durable.table(bounds(durable.table(pairs.select("x", "y"), "pairs"), prof, "coarse"), "coarse")
    fine = durable.table(bounds(coarse.where(~far & F.col("finer")).select("x", "y"), prof, "cells"), "cells")
    left = coarse.where(~far & ~F.col("finer")).select("x", "y").unionByName(fine.where(~far).select("x", "y"))
    exact = verify(left, texts).select("x", "y", F.col("d").alias("low"), F.col("d").alias("high"), "link")
    return exact.unionByName(closed(coarse)).unionByName(closed(fine))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, d, link) of pairs (x, y) of documents, from whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for ids, column in (("x", "tx"), ("y", "ty")):
                _, first, inverse = np.unique(batch.column(ids).to_numpy(), return_index=True, return_inverse=True)
                sides.append((list(K.sets(batch.column(column).take(pa.array(first)))), inverse))
            (sx, ix), (sy, iy) = sides
            inter = np.array([len(np.intersect1d(sx[a], sy[b], assume_unique=True)) for a, b in zip(ix, iy, strict=True)], np.int64)
            union = np.array([len(sx[a]) + len(sy[b]) for a, b in zip(ix, iy, strict=True)], np.int64) - inter
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(1 - inter / np.maximum(union, 1)), pa.array((100 * inter >= LINK * union) & (inter > 0))], ["x", "y", "d", "link"])

    return with_texts(durable.table(pairs.select("x", "y"), "pairs"), texts).mapInArrow(run, "x long, y long, d double, link boolean")


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(id, root): the smallest id reachable from each id of ``edges``.

    Labels are lowered to the neighbours' smallest and then to the label's own
    label, until nothing changes; each round is a written table.
    """
    both = durable.table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(b, a)).distinct(), "edges")
    labels = durable.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        lower = durable.table(lower, "lower")
        # labels whose own label is lower still; where they are many, both sides of the join are written tables, whose hot labels are split
        jump = durable.table(lower.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("next")).join(lower.select("root").distinct(), "root", "left_semi"), "jump")
        step = durable.table(lower.join(F.broadcast(jump) if jump.count() <= BROADCAST_ROWS else jump, "root", "left").select("id", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        labels = step.select("id", "root")
        if not step.where("root <> was").limit(1).count():
            return labels


def _relabel(table: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``table`` with column ``column`` replaced by its label, where it has one."""
    names = labels.select(F.col("id").alias(column), F.col("root").alias("_root"))
    return table.join(names, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def _mixed(rest: DataFrame) -> DataFrame:
    """The rows of regions with several classes, c lowered to the number of these."""
    several = rest.groupBy("s").agg(F.countDistinct("root").alias("_k")).where("_k > 1")
    return rest.join(several, "s").withColumn("c", F.least("c", "_k")).select(*rest.columns)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """(x, y) and (y, x) of all ``pairs``."""
    return pairs.select("x", "y").union(pairs.select("y", "x"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prof = durable.table(profiles(docs, *frequent_shingles(docs)), "profiles")
    sized = prof.where("doc_id is not null")
    again = sized.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = durable.table(again, "repeated") if again.limit(1).count() else None
    sized, texts = one_row(sized, repeated), one_row(docs.where("doc_id is not null"), repeated)
    same = sized.where("n > 0").groupBy("n", "sa", "sb").agg(F.min("doc_id").alias("rep"))
    members = durable.table(prof.select("doc_id", "n", "sa", "sb").join(same, ["n", "sa", "sb"], "left").select("doc_id", "n", "rep"), "members")
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("_copy"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    entries = sized.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = 1 << max(6, min(20, (entries // BUCKET_ROWS).bit_length()))
    first = sized.join(copies, sized["doc_id"] == copies["_copy"], "left_anti").select("doc_id", "n", "prefix")
    first = durable.table(shared_shingles(first, buckets), "shared")
    regions = first.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("p"), F.min("n").alias("lo"))
    # what stands at place i has n - i shingles from there on, which must make up the overlap with the region's smallest set that is near in size
    reach = 7 * (F.col("n") - F.col("i")) >= 3 * (F.col("n") + F.greatest(F.col("lo").cast("double"), 0.75 * F.col("n")))
    held = durable.table(first.join(regions.hint("shuffle_hash"), "s").where(reach).select("s", "x", "n", "i", "p", "c"), "regions")

    sizes = held.select(F.col("x").alias("p"), F.col("n").alias("np")).distinct()
    fits = (4 * F.col("n") >= 3 * F.col("np")) & (4 * F.col("np") >= 3 * F.col("n"))

    # level 0: every member against its regions' pivots
    stars = held.where("x <> p").select("x", "n", "p").distinct().join(sizes, "p").where(fits)
    known = durable.table(measured(stars.select("x", F.col("p").alias("y")), sized, texts), "known")
    links = known.where("link").select("x", "y")
    if not known.limit(1).count() and not held.groupBy("s").count().where("count > 1").limit(1).count():
        return members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
    roots = components(links)

    # what is left: regions with several classes, each member with its distance to the pivot
    far = known.select("x", F.col("y").alias("p"), F.struct("low", "high").alias("d"))
    named = _relabel(held.withColumn("root", F.col("x")), roots, "root")
    mixed = named.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s")
    rest = named.join(mixed, "s").join(far, ["x", "p"], "left")
    here = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    d = F.when(F.col("x") == F.col("p"), here).otherwise(F.col("d"))
    # a document is central where many share many of its first shingles: what was changed in it comes first and is shared by few
    heads = F.slice(F.array_sort(F.collect_list(F.struct("i", "s"))), 1, HEADS)  # of those of one text
    central = rest.groupBy("x").agg(F.sum("c").alias("central"), heads.alias("heads"))
    before = F.transform(F.filter("heads", lambda h: h["i"] < F.col("i")), lambda h: h["s"])
    rest = durable.table(rest.join(central, "x").select("s", "x", "n", "i", "c", "root", "p", F.array(d).alias("ds"), "central", before.alias("before")), "rest")

    done, first_roots = [], roots  # regions that need no more pivots wait for the end; levels only touch the others
    level = asked_so_far = linked_so_far = 0
    while True:
        large = rest.where(F.col("c") > SPLIT)
        if not large.limit(1).count() or level and level % 2 == 0 and linked_so_far * PROGRESS < asked_so_far:
            break
        if level % 2 == 0:
            asked_so_far = linked_so_far = 0
        level += 1
        done.append(rest.where(F.col("c") <= SPLIT))
        # new pivots for each large region: the most central of those that haven't been one, in turn of all and of the smaller classes
        fresh_ones = large.where(~F.exists("ds", lambda v: F.coalesce(v["high"], F.lit(1.0)) == 0))
        if level % 2 == 0:
            mains = large.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max(F.struct("k", "root")).alias("_m"))
            fresh_ones = fresh_ones.join(mains, "s").where(F.col("root") != F.col("_m.root"))
        best = Window.partitionBy("s").orderBy(F.desc("central"), "x")
        chosen = fresh_ones.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PIVOTS)
        chosen = chosen.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", F.col("x").alias("pivot"), F.col("root").alias("pivot_root"), F.col("n").alias("np")))).alias("ps"))  # PIVOTS at most
        told = large.join(chosen, "s", "left")
        asked = told.select("x", "n", "root", F.inline("ps")).where((F.col("root") != F.col("pivot_root")) & fits).select("x", F.col("pivot").alias("y")).distinct()
        asked = asked.join(_both_ways(known), ["x", "y"], "left_anti")
        fresh = durable.table(measured(asked, sized, texts), "fresh")
        known = durable.table(known.unionByName(fresh), "known")
        more = fresh.where("link").select("x", "y")
        asked_so_far, linked = asked_so_far + fresh.count(), more.count()
        linked_so_far += linked
        if linked:
            links = links.unionByName(more)
            roots = components(links)
        step = fresh.groupBy("x").agg(F.map_from_entries(F.collect_list(F.struct("y", F.struct("low", "high")))).alias("_d"))  # PIVOTS for each region of x at most
        pivot = [F.get("ps", F.lit(k))["pivot"] for k in range(PIVOTS)]
        dd = [F.when(F.col("x") == v, here).when(v.isNotNull(), F.try_element_at("_d", v)) for v in pivot]
        large = told.join(step, "x", "left").withColumn("ds", F.concat("ds", F.array(*dd))).select(*rest.columns)
        # a region's size is now the number of its classes
        rest = durable.table(_mixed(_relabel(large.withColumn("root", F.col("x")), roots, "root")), "rest")
    if done:
        waited = functools.reduce(DataFrame.unionByName, done)
        if roots is not first_roots:  # classes have merged since
            waited = durable.table(_mixed(_relabel(waited.withColumn("root", F.col("x")), roots, "root")), "waited")
        rest = rest.unionByName(waited)

    # pairs of different classes inside their windows
    def near(i: int) -> Column:
        a, b = F.get(F.col("l.ds"), F.lit(i)), F.get(F.col("r.ds"), F.lit(i))
        return a.isNull() | b.isNull() | ((a["low"] - b["high"] <= R + 1e-9) & (b["low"] - a["high"] <= R + 1e-9))

    window = (F.col("l.root") != F.col("r.root")) & (F.col("l.x") < F.col("r.x")) & (4 * F.col("l.n") >= 3 * F.col("r.n")) & (4 * F.col("r.n") >= 3 * F.col("l.n"))
    # the first shingle that a linked pair shares has the whole overlap from its place on, in both sets
    for side in "lr":
        window &= 7 * (F.col(f"{side}.n") - F.col(f"{side}.i")) >= 3 * (F.col("l.n") + F.col("r.n"))
    for i in range(1 + level * PIVOTS):
        window &= near(i)
    # a pair that shares an earlier shingle, as far as the first HEADS of both tell, is met there
    window &= ~F.arrays_overlap("l.before", "r.before")
    pairs = rest.alias("l").join(rest.alias("r"), (F.col("l.s") == F.col("r.s")) & window).select(F.col("l.x").alias("x"), F.col("r.x").alias("y")).distinct()
    pairs = pairs.join(_both_ways(known), ["x", "y"], "left_anti")
    last = durable.table(measured(pairs, sized, texts), "last").where("link").select("x", "y")
    if last.limit(1).count():
        roots = components(links.unionByName(last))
    out = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def near_copies_removed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: its smallest doc_id, one row of it. Rows with a null doc_id stay.

    An empty table stays empty; other columns are kept, whatever their names.
    """
    gone, n = K.unused("_gone", docs.columns), K.unused("_n", docs.columns)
    keep = classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.where("doc_id is not null").join(keep, docs["doc_id"] == keep[gone], "left_anti")
    ranked = left.withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last())))
    return ranked.where(F.col(n) == 1).drop(n).unionByName(docs.where("doc_id is null"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
