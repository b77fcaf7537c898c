"""Session defaults: UTC, adaptive execution, ANSI left as Spark has it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Spark opens the path, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
