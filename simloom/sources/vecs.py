"""Vector and graph files: fvecs, ivecs, adjacency lists (ragged ivecs) and nsg.

Files are written by many tasks: rows are cut into ranges of their ids, the
sizes of the ranges give each its place, and every range is written there by a
task, in any order and as often as Spark has to repeat it. The file takes its
name once all is there.

All are little-endian records of an int32 length and that many 4-byte values;
nsg has a header of two uint32, the width and the entry point. Records of one
length are read in parallel by offset. Where the records of a ragged file begin
is found in parallel, too: each piece of the file tells for its first words where
a record that begins there, and all that follow, leave the piece, and how many
they are; the driver follows these from piece to piece. Paths are local or mounted.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from simloom.plans import durable, ranks

PART_BYTES = 32 << 20


class Span(InputPartition):
    """Records from a byte offset, numbered from ``first``."""

    def __init__(self, offset: int, size: int, first: int):
        super().__init__((offset, size, first))
        self.offset, self.size, self.first = offset, size, first


def parse_records(raw: bytes, kind: str) -> list[np.ndarray]:
    """The records of a buffer that holds whole ones."""
    out, at = [], 0
    while at < len(raw):
        (n,) = struct.unpack_from("<i", raw, at)
        out.append(np.frombuffer(raw, kind, n, at + 4))
        at += 4 + 4 * n
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, column: str, ragged: bool, head: int, limit: int | None, part: int, spans: str | None = None):
        self.path, self.kind, self.column, self.ragged, self.head, self.limit, self.part, self.spans = path, kind, column, ragged, head, limit, part, spans

    def partitions(self) -> list[Span]:
        if self.spans:
            return [Span(*map(int, s)) for s in np.load(self.spans)]
        size = os.path.getsize(self.path)
        if size <= self.head:
            return [Span(self.head, 0, 0)]
        with open(self.path, "rb") as f:
            if not self.ragged:
                f.seek(self.head)
                stride = 4 + 4 * struct.unpack("<i", f.read(4))[0]
                count = (size - self.head) // stride
                count = count if self.limit is None else min(count, self.limit)
                each = max(1, self.part // stride)
                return [Span(self.head + i * stride, min(each, count - i) * stride, i) for i in range(0, count, each)] or [Span(self.head, 0, 0)]
            spans, start, at, first, n = [], self.head, self.head, 0, 0
            while at < size and (self.limit is None or n < self.limit):
                f.seek(at)
                at += 4 + 4 * struct.unpack("<i", f.read(4))[0]
                n += 1
                if at - start >= self.part:
                    spans.append(Span(start, at - start, first))
                    start, first = at, n
            return [*spans, Span(start, at - start, first)] if at > start or not spans else spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(span.offset)
            records = parse_records(f.read(span.size), self.kind)
        value = pa.float32() if self.kind == "<f4" else pa.int32()
        at = np.r_[0, np.cumsum([len(r) for r in records])].astype(np.int32)
        flat = pa.array(np.concatenate(records) if records else np.zeros(0, self.kind), value)
        lists = pa.ListArray.from_arrays(pa.array(at), flat)
        if self.column == "neighbors":
            lists = lists.cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(span.first, span.first + len(records))), lists], ["id", self.column])


class _Vecs(DataSource):
    kind, column, ragged, width = "<f4", "vec", False, "float"

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return f"id long, {self.column} array<{self.width}>"

    def _head(self) -> int:
        return 0

    def reader(self, schema) -> _Reader:
        limit = self.options.get("limit")
        return _Reader(self.options["path"], self.kind, self.column, self.ragged, self._head(), int(limit) if limit else None, int(self.options.get("partbytes", PART_BYTES)), self.options.get("spans"))


class Fvecs(_Vecs):
    """format("fvecs"): id, vec array<float>."""


class Ivecs(_Vecs):
    """format("ivecs"): id, vec array<int>."""

    kind, width = "<i4", "int"


class Adjacency(_Vecs):
    """format("adjacency"): id, neighbors array<long>; record number is the vertex, lists may be empty."""

    kind, column, ragged, width = "<i4", "neighbors", True, "long"


class Nsg(Adjacency):
    """format("nsg"): adjacency lists after a header of width and entry point."""

    def _head(self) -> int:
        return 8


def register(spark: SparkSession) -> None:
    for source in (Fvecs, Ivecs, Adjacency, Nsg):
        spark.dataSource.register(source)


def nsg_header(path: str) -> dict:
    """width and enterpoint_node of an nsg file."""
    with open(local(path), "rb") as f:
        width, enter = struct.unpack("<II", f.read(8))
    return {"width": width, "enterpoint_node": enter}


def records(lists: pa.Array, kind: str) -> np.ndarray:
    """The 4-byte words of the records of some lists: each its length and its values."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    begin = np.cumsum(sizes + 1) - sizes - 1
    out = np.empty(int((sizes + 1).sum()), np.int32)
    head = np.zeros(len(out), bool)
    head[begin] = True
    out[head] = sizes
    out[~head] = lists.flatten().to_numpy(zero_copy_only=False).astype(kind).view(np.int32)
    return out


def write(df: DataFrame, path: str, form: str, part_bytes: int = PART_BYTES, **options) -> None:
    """Write (id, list) rows in order of id; ids are dense, since files hold none, and a null list is an empty one.

    ``path`` is on a folder that the driver and all executors share.
    """
    source = {c.name(): c for c in (Fvecs, Ivecs, Adjacency, Nsg)}[form]
    kind, path = source.kind, local(path)
    head = struct.pack("<II", int(options["width"]), int(options["enterpoint"])) if source is Nsg else b""
    key, column = df.columns[:2]
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(column), F.array()).alias("list"))
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("list") + 1), F.lit(0))).first()
    told = ranks.ordered(rows, "id", rows=max(1, part_bytes * n // max(4 * words, 1)))
    sizes = told.groupBy("_range").agg(F.sum(F.size("list") + 1).alias("words")).orderBy("_range").collect()  # a row for part_bytes
    at, starts = len(head), []
    for r in sizes:
        starts.append((r["_range"], at))
        at += 4 * r["words"]
    part = f"{path}.{uuid.uuid4().hex}"

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        out = records(group.column("list"), kind).tobytes()
        with open(part, "r+b") as f:
            f.seek(group.column("_at")[0].as_py())
            f.write(out)
            f.flush()
            os.fsync(f.fileno())
        return pa.table({"n": [len(out)]})

    try:
        with open(part, "wb") as f:
            f.write(head)
            f.truncate(at)
        first = df.sparkSession.createDataFrame(starts, "_range int, _at long")
        put = told.join(F.broadcast(first), "_range").groupBy("_range").applyInArrow(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if put + len(head) != at:
            raise OSError(f"{put} of {at - len(head)} bytes were written to {path}")
        os.replace(part, path)
    finally:
        durable.drop(told)
        if os.path.exists(part):
            os.remove(part)


def local(path: str) -> str:
    """A local or mounted path without its scheme."""
    scheme, found, rest = path.partition(":")
    if found and scheme != "file" and "/" not in scheme:
        raise ValueError(f"{path}: vector files are read and written by mounted paths")
    return "/" + rest.lstrip("/") if found and scheme == "file" else path


def ways_out(words: np.ndarray, begin: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ``first`` words of a piece: where the records from there on leave it, and their number; -1 where a length is negative.

    ``words`` begin at word ``begin`` of the file. Ways are doubled until all have left.
    """
    n = len(words)
    out = np.where(words < 0, -1, np.arange(n) + 1 + words.astype(np.int64))
    count = np.ones(n, np.int32)
    while len(inside := np.flatnonzero((out >= 0) & (out < n))):
        at = out[inside]
        out[inside], count[inside] = out[at], count[inside] + count[at]
    return np.where(out < 0, -1, out + begin)[:first], count[:first]


def find_records(spark: SparkSession, path: str, head: int, part: int = PART_BYTES, first: int = 1 << 16) -> np.ndarray:
    """(offset, bytes, number of the first record) of pieces of whole records of a ragged file."""
    piece, total = max(1, part // 4), (os.path.getsize(path) - head) // 4
    pieces = -(-total // piece)
    folder = f"{local(durable.shared_dir(spark))}/simloom/ways-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                words = np.fromfile(path, "<i4", piece, offset=head + 4 * i * piece)
                out, count = ways_out(words, i * piece, first)
                for name, x in (("out", out.astype(np.int64)), ("count", count)):
                    own = f"{folder}/{i}.{name}.{uuid.uuid4().hex}"  # a task may run twice
                    x.tofile(own)
                    os.replace(own, f"{folder}/{i}.{name}")
                yield pa.RecordBatch.from_arrays([pa.array([i])], ["id"])

    spark.range(0, pieces, 1, min(pieces, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "id long").count()
    at, n, spans = 0, 0, []
    with open(path, "rb") as f:
        while at < total:
            i, start, number = at // piece, at, n
            if at - i * piece < first:
                out, count = (int(np.fromfile(f"{folder}/{i}.{name}", kind, 1, offset=(at - i * piece) * np.dtype(kind).itemsize)[0]) for name, kind in (("out", np.int64), ("count", np.int32)))
            else:  # a record reaches so far into the piece: its others are followed one by one
                out, count = at, 0
                while out < min((i + 1) * piece, total):
                    f.seek(head + 4 * out)
                    out, count = out + 1 + struct.unpack("<i", f.read(4))[0], count + 1
            if out > total or out <= at:
                raise ValueError(f"{path}: the record at byte {head + 4 * at} is broken")
            at, n = out, n + count
            spans.append((head + 4 * start, 4 * (at - start), number))
    shutil.rmtree(folder)
    return np.array(spans, np.int64).reshape(-1, 3)


def read(spark: SparkSession, path: str, form: str, limit: int | str | None = None, **options) -> DataFrame:
    """(id, list) of a file, of its first ``limit`` records where that is given."""
    register(spark)
    path, source, part = local(path), {c.name(): c for c in (Fvecs, Ivecs, Adjacency, Nsg)}[form], int(options.get("partbytes", PART_BYTES))
    head = 8 if source is Nsg else 0
    if source.ragged and os.path.getsize(path) - head > part:
        told = f"{local(durable.shared_dir(spark))}/simloom/spans-{uuid.uuid4().hex}.npy"
        os.makedirs(os.path.dirname(told), exist_ok=True)
        np.save(told, find_records(spark, path, head, part))
        rows = spark.read.format(form).options(path=path, spans=told, **options).load()
        return rows if limit is None else rows.where(F.col("id") < int(limit))
    return spark.read.format(form).options(path=path, **options, **({} if limit is None else {"limit": str(limit)})).load()
