"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("simloom")
        .config("spark.driver.memory", os.environ.get("SIMLOOM_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
