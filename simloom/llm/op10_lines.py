"""Line dedup with sharded cuckoo filters backed by exact reference counts.

The exact table of references has one row for each document and line key. Its
counts say which keys are repeated (at least ``MIN_DOCS`` documents) and which
document keeps them (the largest doc_id). Each shard of the keys, of about
SHARD_KEYS repeated ones, has a cuckoo filter of these: the filter tells cheaply, with no false negatives,
which references can lose lines, so that only those are joined with the exact
counts, which rule out the filter's false positives. Deleting documents takes
their references out of the table and the keys that are no longer repeated out
of the filter, so an index after inserts and deletes decides just like one
built from the documents that are left.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z
lower-cased; only keys of ``MIN_CHARS`` code points or more count. Keys are held
as two 64-bit hashes.

Defined results: a null or empty text is one empty line. Lines repeated inside
a document stay or go together. Rows of one doc_id count as one document; rows
with a null doc_id keep all their lines and count for nothing. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm import kernels as K
from simloom.plans import durable

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 17  # keys of a shard and its filter, on average
FILTER_BYTES = 64 << 20  # filters are broadcast in groups of whole shards of about this size
BLANKS = " \t\n\x0b\x0c\r"
SLOTS, LOAD, KICKS = 4, 0.84, 500


class CuckooFilter:
    """Partial-key cuckoo hashing: four 16-bit fingerprints a bucket, in bulk."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.stash = np.zeros(0, np.int64)  # keys that found no place; empty in all but degenerate fillings
        self.rng = np.random.default_rng(1)

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.int64).view(np.uint64)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return mark, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)).astype(np.int64) & (self.buckets - 1))

    def _place(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks in free slots of their buckets; tells which found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        slot = np.argmax(free.cumsum(1) == (rank + 1)[:, None], 1)
        self.table[b[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(b), bool)
        done[order[fits]] = True
        return done

    def insert(self, keys: np.ndarray) -> None:
        mark, bucket = self._parts(keys)
        done = self._place(mark, bucket)
        key, mark, bucket = keys[~done], mark[~done], bucket[~done]
        other = self._other(bucket, mark)
        done = self._place(mark, other)
        mark, bucket = mark[~done], other[~done]
        for _ in range(KICKS):
            if not len(mark):
                return
            _, one = np.unique(bucket, return_index=True)
            slot = self.rng.integers(0, SLOTS, len(one))
            b, new = bucket[one], mark[one]
            old = self.table[b, slot].copy()
            self.table[b, slot] = new
            mark[one], bucket[one] = old, self._other(b, old)
            done = self._place(mark, bucket)
            mark, bucket = mark[~done], bucket[~done]
        raise OverflowError("the filter is too full; build it again from the exact table")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, bucket = self._parts(keys)
        return (self.table[bucket] == mark[:, None]).any(1) | (self.table[self._other(bucket, mark)] == mark[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in the filter, one fingerprint each."""
        for m, b in zip(*self._parts(keys), strict=True):
            for at in (b, self._other(np.array([b]), np.array([m]))[0]):
                slot = np.flatnonzero(self.table[at] == m)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "CuckooFilter":
        out = cls(1)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        out.buckets = len(out.table)
        return out

    @classmethod
    def build(cls, keys: np.ndarray) -> "CuckooFilter":
        """A filter of distinct keys, as large as it takes."""
        capacity = len(keys)
        while True:
            out = cls(capacity)
            try:
                out.insert(keys)
                return out
            except OverflowError:
                capacity = 2 * max(capacity, 4)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2): the distinct long keys of each document."""
    long = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    pairs = F.array_distinct(F.transform(long, lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(k, F.lit(1)).alias("k2"))))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(pairs)).distinct()


def _shard(k1: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(k1, 7), F.lit(shards)).cast("int")


class LineIndex:
    """References of documents' lines and the filters of repeated keys, kept up by inserts and deletes."""

    def __init__(self, spark, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.refs = spark.createDataFrame([], "doc_id long, k1 long, k2 long")
        self.hot = self.filters = None
        self.shards = 64

    def _settle(self, changed: DataFrame | None = None) -> "LineIndex":
        """The exact counts of repeated keys, and filters that follow them."""
        before, old = self.hot, self.filters
        counts = self.refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= self.min_docs)
        self.hot = durable.table(counts, "hot")
        shards = 1 << max(6, (self.hot.count() // SHARD_KEYS).bit_length())
        if before is None or shards > 4 * self.shards:
            self.shards = shards
            build = lambda p: pd.DataFrame({"shard": p["shard"].iloc[:1], "filter": [CuckooFilter.build(np.unique(p["k1"].to_numpy())).dump()]})
            self.filters = durable.table(self.hot.select(_shard(F.col("k1"), self.shards).alias("shard"), "k1").groupBy("shard").applyInPandas(build, "shard int, filter binary"), "filters")
            return self
        keys, was = self.hot.select("k1").distinct(), before.select("k1").distinct()
        new = keys.join(was, "k1", "left_anti").withColumn("adds", F.lit(True))
        gone = was.join(keys, "k1", "left_anti").withColumn("adds", F.lit(False))
        moves = new.unionByName(gone).withColumn("shard", _shard(F.col("k1"), self.shards))

        def follow(filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            shard = (filters if len(filters) else moved)["shard"].iloc[0]
            f = CuckooFilter.load(filters["filter"].iloc[0]) if len(filters) else CuckooFilter(max(16, len(moved)))
            f.delete(moved.loc[~moved["adds"], "k1"].to_numpy())
            try:
                f.insert(moved.loc[moved["adds"], "k1"].to_numpy())
            except OverflowError:
                return pd.DataFrame({"shard": [shard], "filter": [None]})
            return pd.DataFrame({"shard": [shard], "filter": [f.dump()]})

        filters = durable.table(old.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(follow, "shard int, filter binary"), "filters")
        if filters.where("filter is null").limit(1).count():  # a full shard: all are built again from the exact counts
            self.filters = self.hot = None
            return self._settle()
        self.filters = filters
        return self

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Add documents (doc_id, text); a document that is there already is added to."""
        new = references(docs, self.min_chars)
        self.refs = durable.table(new if self.hot is None else self.refs.unionByName(new).distinct(), "refs")
        return self._settle()

    def delete(self, ids: DataFrame) -> "LineIndex":
        """Take out the documents of column doc_id."""
        self.refs = durable.table(self.refs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), "refs")
        return self._settle()

    def losses(self) -> DataFrame:
        """(doc_id, drops): the first hashes of the keys whose lines each document loses."""
        sizes = self.filters.select("shard", F.length("filter").alias("size")).orderBy("shard").collect()  # one row for each SHARD_KEYS repeated keys
        groups, size = [[]], 0
        for r in sizes:
            if groups[-1] and size + r["size"] > FILTER_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(r["shard"])
            size += r["size"]
        asked = None
        for group in groups:
            part = self.refs if len(groups) == 1 else self.refs.where(_shard(F.col("k1"), self.shards).isin(group))
            part = self._probed(part, group)
            asked = part if asked is None else asked.unionByName(part)
        lost = asked.join(self.hot.select("k1", "k2", "keeper"), ["k1", "k2"]).where(F.col("doc_id") != F.col("keeper"))
        return lost.groupBy("doc_id").agg(F.collect_set("k1").alias("drops"))

    def _probed(self, refs: DataFrame, group: list[int]) -> DataFrame:
        """Those of ``refs`` that the filters of some shards let through."""
        held = self.spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in self.filters.where(F.col("shard").isin(group)).collect()})  # about FILTER_BYTES
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.load(v) for k, v in held.value.items()}
            for batch in batches:
                k1 = batch.column("k1").to_numpy(zero_copy_only=False)
                shard, hit = (k1 >> 7) % shards, np.zeros(len(k1), bool)
                for s in np.unique(shard):
                    if s in filters:
                        at = np.flatnonzero(shard == s)
                        hit[at] = filters[s].contains(k1[at])
                yield batch.filter(pa.array(hit))

        return refs.mapInArrow(probe, refs.schema)

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text and more) with the lines of each in ``_lines`` and those that stay in ``_kept``."""
        id_, drops = K.unused("_id", docs.columns), K.unused("_drops", docs.columns)
        lost = self.losses().select(F.col("doc_id").alias(id_), F.col("drops").alias(drops))
        both = docs.join(lost.hint("shuffle_hash"), docs["doc_id"] == lost[id_], "left").withColumn("_lines", lines_of(F.col("text")))
        stays = F.filter("_lines", lambda x: ~((F.length(x) >= self.min_chars) & F.array_contains(F.col(drops), F.xxhash64(line_key(x)))))
        return both.withColumn("_kept", F.when(F.col(drops).isNull(), F.col("_lines")).otherwise(stays)).drop(id_, drops)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that stays; n_chars, where there, follows it. A null text stays null; other columns keep their values, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(names)))
    out = LineIndex(docs.sparkSession).insert(plain.select("doc_id", "text")).apply(plain)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*plain.columns).toDF(*names)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = LineIndex(spark).insert(docs).apply(docs)
    n, kept = F.size("_lines").cast("long"), F.array_join("_kept", "\n")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("_kept")).cast("long").alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(l, i) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, i, line, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
