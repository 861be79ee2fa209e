"""Exact substring dedup with suffix arrays of shards.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else is
removed. Two places that start the same string see the same minimisers in it:
the smallest hash of all GRAM-byte strings inside. So

1. each text gives its minimisers as anchors, with two hashes of the anchor's
   surroundings (all LENGTH-byte strings around it). Anchors found once in the
   corpus have no repeated string around them; most of a corpus ends here;
2. surroundings found twice or more are repeated as a whole;
3. different surroundings of one anchor go to a shard with their bytes. Two
   places that start one string see this anchor at the same distance, so a
   string is repeated if its part before the anchor and its part after it are
   shared with one other place. Each shard builds two suffix arrays over words
   of eight bytes, one of what follows its anchors and one of what precedes
   them, read backwards (Larsson-Sadakane refinement: only groups that still
   tie are sorted again, with doubled depth). Common prefixes of neighbours by
   Kasai's rule cut the arrays into classes of equal parts of every length;
   starts whose two classes hold another place as well are marked;
4. the surroundings of an anchor with more than ``SPLIT`` different ones are
   dealt over several shards. These give hashes of the LENGTH - STEP byte
   strings around the anchor, STEP bytes apart, and for those that are found
   again all LENGTH-byte strings that hold them, sorted by hash; the merge
   finds strings of several shards by binary search in ranges of the hash.

The marked starts of each text are joined with it and cut out in one pass.

Defined results: a null text is empty. Texts shorter than LENGTH lose nothing.
Repeated rows are documents of their own, so all their strings are repeated
where they reach LENGTH. Null doc_ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import kernels as K
from simloom.plans import durable

LENGTH, GRAM = 400, 160
SPLIT, SHARD_BYTES, STEP = 16384, 3 << 20, 16
LEFT = LENGTH - GRAM
_SECOND = K._BASE ^ 0x5DEECE66C
_SECOND_BACK = pow(_SECOND, -1, 1 << 64)


class Prefix:
    """Polynomial prefix sums of a byte array: hashes of any of its strings, by two bases."""

    def __init__(self, data: np.ndarray):
        self.n, v = len(data), K._BYTE[data]
        self.sums = []
        for base in (K._BASE, _SECOND):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(v * K._power(base, self.n), out=s[1:])
            self.sums.append(s)

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return K.mix((s[end] - s[start]) * K._power((K._BACK, _SECOND_BACK)[which], self.n + 1)[start] + (end - start).astype(np.uint64) * K._TAP[7])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimisers of consecutive texts: text, place in it, hash, and two hashes of the surroundings."""
    lo, hi = int(at[0]), int(at[-1])
    if hi - lo < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64), z.view(np.uint64)
    raw = data[lo:hi]
    sums = Prefix(raw)
    n = len(raw) - GRAM + 1
    i = np.arange(n)
    low = (sums.hashes(i, i + GRAM, 0) >> np.uint64(32) << np.uint64(32)) | i.astype(np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width < span:  # smallest of each window by doubling, leftmost among equals
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
    inside = np.arange(len(low)) + LENGTH <= (at[1:] - lo)[text]
    text, place = text[inside], (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] if len(place) else np.zeros(0, bool)
    text, place = text[new], place[new]
    begin = np.maximum(place - LEFT, (at[:-1] - lo)[text])
    end = np.minimum(place + LENGTH, (at[1:] - lo)[text])
    shape = K.mix((place - begin).astype(np.uint64) * K._TAP[5] + (end - place).astype(np.uint64) * K._TAP[6])
    a, b = sums.hashes(begin, end, 0) ^ shape, sums.hashes(begin, end, 1) ^ shape
    return text, place - (at[:-1] - lo)[text], sums.hashes(place, place + GRAM, 1), a, b


def suffix_ranks(value: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``starts`` of the symbols ``value`` in order of their first ``depth`` symbols.

    All of ``starts`` have that many symbols. Larsson-Sadakane: ranks of all
    places to depth h give those to depth 2h; places alone in their group are
    done, the others are sorted again by the rank h symbols on.
    """
    n = len(value)
    order = np.argsort(value, kind="stable")
    v = value[order]
    first = np.r_[True, v[1:] != v[:-1]] if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.zeros(n + depth + 1, np.int64)
    rank[order] = head
    tied = np.zeros(n, bool)
    last = np.r_[first[1:], True] if n else first
    tied[order] = ~(first & last)
    h = 1
    while h < depth:
        step = min(h, depth - h)
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        old, nxt = rank[open_], rank[open_ + step]
        order = np.lexsort((nxt, old))
        place, o, x = open_[order], old[order], nxt[order]
        group = np.r_[True, o[1:] != o[:-1]]
        first = group | np.r_[True, x[1:] != x[:-1]]
        i = np.arange(len(o))
        head = np.maximum.accumulate(np.where(first, i, 0))
        base = np.maximum.accumulate(np.where(group, i, 0))
        rank[place] = o + head - base
        last = np.r_[first[1:], True]
        tied[place] = ~(first & last)
        h += step
    return starts[np.argsort(rank[starts], kind="stable")]


def kasai(raw: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to ``limit``.

    Kasai's rule: the next place's common prefix is shorter by one at most, as
    long as the neighbour's next place is in the array too; else it is counted
    from the start. Runs of places are walked side by side.
    """
    m = len(sa)
    if not m:
        return np.zeros(0, np.int64)
    n = len(raw)
    wide = np.zeros(n + limit + 8, np.uint8)
    wide[:n] = raw
    words = np.lib.stride_tricks.as_strided(wide, (n + limit + 1, 8), (1, 1))
    before = np.full(n + 1, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    there = np.zeros(n + 1, bool)
    there[sa] = True
    lcp = np.zeros(n + 1, np.int64)
    run = np.flatnonzero(there & ~np.r_[False, there[:-1]])  # a run's first place
    at, h = run.copy(), np.zeros(len(run), np.int64)
    while len(at):
        prev = before[at]
        h = np.where(prev < 0, 0, h)
        live = np.flatnonzero((prev >= 0) & (h < limit))
        while len(live):
            same = words[at[live] + h[live]] == words[prev[live] + h[live]]
            step = np.where(same.all(1), 8, np.argmin(same, 1))
            h[live] = np.minimum(h[live] + step, limit)
            live = live[(step == 8) & (h[live] < limit)]
        lcp[at] = h
        on = there[at + 1]
        keeps = on & (prev >= 0) & there[np.where(prev < 0, n, prev + 1)]
        h = np.where(keeps, np.maximum(h - 1, 0), 0)[on]
        at = at[on] + 1
    return lcp[sa]


def side_classes(anchor: np.ndarray, sides: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the sides of a shard's anchors, and the common prefix of each with the one before it.

    A side is what follows an anchor or what precedes it, read backwards; sides
    of different anchors have nothing in common (-1).
    """
    words = -(-LEFT // 8) + 1
    raw = np.zeros((len(sides), 8 * words), np.uint8)
    raw[:, :8] = anchor.astype(">u8").view(np.uint8).reshape(-1, 8)
    for row, side in zip(raw, sides, strict=True):
        row[8 : 8 + len(side)] = np.frombuffer(side, np.uint8)
    value = raw.reshape(-1).view(">u8").astype(np.uint64)
    order = suffix_ranks(value, np.arange(len(sides)) * words, words) // words
    return order, np.maximum(kasai(raw.reshape(-1), order * 8 * words, 8 + LEFT) - 8, -1)


def shard_spans(h: np.ndarray, ids: np.ndarray, place: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> pd.DataFrame:
    """(key, start, end): runs of starts of repeated strings around the anchors ``h`` of one shard."""
    m = len(h)
    _, group = np.unique(h, return_inverse=True)
    sides = []
    for parts in ([x[::-1] for x in lefts], rights):
        order, lcp = side_classes(group.astype(np.uint64), parts)
        sides.append((order, lcp, np.array([len(x) for x in parts], np.int64)))

    def cls(side: int, depth: int) -> np.ndarray:
        order, lcp, _ = sides[side]
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    marked = np.zeros((m, LEFT + 2), bool)
    for left in range(LEFT + 1):
        fits = np.flatnonzero((sides[0][2] >= left) & (sides[1][2] >= LEFT - left))
        if len(fits) > 1:
            both = cls(0, left)[fits] * (m + 1) + cls(1, LEFT - left)[fits]
            _, at, n = np.unique(both, return_inverse=True, return_counts=True)
            marked[fits, left] = n[at] > 1
    before = np.zeros_like(marked)
    before[:, 1:] = marked[:, :-1]
    row, low = np.nonzero(marked & ~before)
    _, high = np.nonzero(before & ~marked)
    return pd.DataFrame({"key": ids[row], "start": place[row] - high + 1, "end": place[row] - low + LENGTH})


def repeated_starts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, start, end) spans to remove from texts of ``docs`` (key, text), as two frames: whole surroundings, and single strings' starts."""
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.buffer(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in K.slices(at):
                text, place, h, a, b = anchors(data, at[i : j + 1])
                if len(text):
                    size = np.diff(at[i : j + 1])[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[i:j][text]), pa.array(place), pa.array(size), *(pa.array(x.view(np.int64)) for x in (h, a, b))], ["key", "place", "size", "h", "a", "b"]
                    )

    found = durable.table(docs.select("key", "text").mapInArrow(find, "key long, place long, size long, h long, a long, b long"), "anchors")
    kinds = durable.table(found.groupBy("h", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key"), F.min_by("place", "key").alias("place"), F.min_by("size", "key").alias("size")), "kinds")
    whole = kinds.where("c > 1").select("h", "a", "b")
    begin, end = F.greatest(F.col("place") - LEFT, F.lit(0)), F.least(F.col("place") + LENGTH, F.col("size"))
    spans = found.join(whole.hint("shuffle_hash"), ["h", "a", "b"], "left_semi").select("key", begin.alias("start"), end.alias("end"))

    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("h", "k")
    asked = durable.table(kinds.join(several.hint("shuffle_hash"), "h").select("h", "k", "key", "place", begin.alias("begin"), end.alias("end")), "open")
    size, most = asked.agg(F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    by_text = asked.groupBy("key").agg(F.collect_list(F.struct("h", "k", "place", "begin", "end")).alias("asks"))  # bounded by the text's length
    pieces = docs.groupBy("key").agg(F.first("text").cast("binary").alias("raw")).join(by_text, "key").select("key", "raw", F.inline("asks"))
    cut = lambda a, b: F.substring(F.col("raw"), (a + 1).cast("int"), (b - a).cast("int"))
    after = F.least(F.col("place") + GRAM, F.col("end"))
    pieces = durable.table(pieces.select("h", "k", "key", "place", cut(F.col("begin"), F.col("place")).alias("left"), cut(F.col("place"), after).alias("gram"), cut(after, F.col("end")).alias("right")), "pieces")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return shard_spans(rows["h"].to_numpy(), rows["key"].to_numpy(), rows["place"].to_numpy(), [bytes(x) for x in rows["left"]], [bytes(x) for x in rows["right"]])

    shard = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-size // SHARD_BYTES))))
    strings = pieces.where(F.col("k") <= SPLIT).select("h", "key", "place", "left", "right", shard.alias("shard")).groupBy("shard").applyInPandas(run, "key long, start long, end long")
    if most > SPLIT:
        strings = strings.unionByName(merged(pieces.where(F.col("k") > SPLIT)))
    return spans, strings


def merged(pieces: DataFrame) -> DataFrame:
    """(key, start, end) of repeated strings around anchors with very many different surroundings."""

    def around(batch: pa.RecordBatch) -> Iterator[tuple]:
        for h, key, place, left, gram, right in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "place", "left", "gram", "right")), strict=True):
            yield h, key, place, len(left), len(right), Prefix(np.frombuffer(left + gram + right, np.uint8))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the strings from i bytes before the anchor, STEP bytes short of LENGTH."""
        for batch in batches:
            out = []
            for h, key, place, left, right, sums in around(batch):
                i = np.arange(0, min(left, LEFT) + 1, STEP)
                i = i[np.maximum(LEFT - i - STEP + 1, 0) <= right]
                end = left + GRAM + np.maximum(LEFT - i - STEP + 1, 0)
                a = sums.hashes(left - i, end, 0).view(np.int64)
                out += [(h, key, place, int(x), int(y)) for x, y in zip(i, a, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["h", "key", "place", "i", "a"])

    cell = durable.table(pieces.mapInArrow(cells, "h long, key long, place long, i long, a long"), "cells")
    again = cell.groupBy("h", "i", "a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cell.join(again, ["h", "i", "a"], "left_semi").groupBy("h", "key", "place").agg(F.collect_set("i").alias("cells"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (h, key, place, left, right, sums), of in zip(around(batch), batch.column("cells").to_pylist(), strict=True):
                i = np.unique(np.concatenate([np.arange(c, c + STEP) for c in of]))
                i = i[(i <= min(left, LEFT)) & (LEFT - i <= right)]
                a, b = (sums.hashes(left - i, left - i + LENGTH, w).view(np.int64) for w in (0, 1))
                out += [(h, key, place - int(x), int(y), int(z)) for x, y, z in zip(i, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["h", "key", "start", "a", "b"])

    lists = durable.table(pieces.join(held, ["h", "key", "place"]).mapInArrow(starts, "h long, key long, start long, a long, b long"), "strings")
    ranges = max(1, -(-lists.count() // 200_000))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """Places of one range whose string is in another list too, by binary search."""
        a = np.sort(rows["a"].to_numpy())
        twice = np.searchsorted(a, rows["a"].to_numpy(), "right") - np.searchsorted(a, rows["a"].to_numpy(), "left") > 1
        some = rows[twice].drop_duplicates(["a", "b", "key", "start"])
        some = some[some.groupby(["a", "b"])["key"].transform("size") > 1]
        return pd.DataFrame({"key": some["key"], "start": some["start"], "end": some["start"] + LENGTH})

    part = F.pmod(F.shiftright("a", 40), F.lit(ranges))
    return lists.withColumn("part", part).groupBy("part").applyInPandas(merge, "key long, start long, end long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``docs`` (doc_id, text); kept holds the bytes that stay."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text", F.lit(9)))
    spans, strings = repeated_starts(keyed)
    cuts = spans.unionByName(strings).groupBy(F.col("key").alias("_key")).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    both = keyed.join(cuts, keyed["key"] == cuts["_key"], "left").select("doc_id", "text", "starts", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.buffer(batch.column("text"))
            removed, spans_, kept = [], [], []
            for d, (s, e) in enumerate(zip(batch.column("starts"), batch.column("ends"), strict=True)):
                raw = data[at[d] : at[d + 1]]
                if s.is_valid:
                    mark = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(mark, s.values.to_numpy(), 1)
                    np.add.at(mark, e.values.to_numpy(), -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans_.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
                    raw = raw[~gone]
                else:
                    removed.append(0)
                    spans_.append(0)
                kept.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
