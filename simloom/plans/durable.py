"""Cutting lineage in a way that survives lost executors.

Everything intermediate goes to the shared folder the cluster names in
``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine
(tests, notebooks) a local folder of our own is used. A cluster without the
setting is an error, as its executors share no local folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Arrow batches while a table is written, so that texts joined to many rows don't make batches as large as a partition.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or our own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="simloom-")
    return _OWN[app]


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later plans start from the files, so a lost executor costs a re-read and
    not a recomputation, and the columns stay compressed and prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/simloom/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in ARROW}
    try:
        for k, v in ARROW.items():
            spark.conf.set(k, v)
        df.write.parquet(path, partitionBy=by)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a frame that :func:`table` returned, or behind all of its written inputs."""
    if df is None:
        return
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = f"{shared_dir(spark)}/simloom/"
    own = getattr(df, "_written", None)
    for parent in {own} if own else {re.sub(r"(/simloom/[^/]+)/.*", r"\1", f) for f in df.inputFiles()}:
        if "/simloom/" in parent and root.split("://")[-1] in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def changed(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed."""
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at).getModificationTime()


MANIFEST = "_complete"


def number_of(version: str) -> int:
    """The number in the name of a version, as v000000007-<any>."""
    return int(version[1:].split("-")[0])


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The names of the complete versions in a folder, oldest first."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted((n for n in names if re.match(r"v\d+-", n) and fs.exists(path(f"{folder}/{n}/{MANIFEST}"))), key=number_of)


def complete(spark: SparkSession, folder: str) -> None:
    """Mark a folder as complete: its manifest is written under another name and then moved."""
    fs, at = _fs(spark, f"{folder}/.{MANIFEST}")
    fs.create(at, True).close()
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")):
        raise OSError(f"no manifest could be moved into {folder}")
