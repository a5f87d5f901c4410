"""Session set-up: a local session for tests and the bench, and worker imports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

REPO = str(Path(__file__).resolve().parents[1])


UNION = "spark.sql.unionOutputPartitioning"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they were started, and keep unions honest."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if REPO not in paths:
        env["PYTHONPATH"] = ":".join([REPO, *paths])
    # A union of two tables that are dealt by the same keys claims to be dealt by them too.  Where adaptive
    # planning then drops the exchange above it but the union puts its partitions one after another, rows of
    # a key end up in two tasks (seen with a cached side).  So a union must not claim anything.
    if spark.conf.get(UNION, None) != "false":
        spark.conf.set(UNION, "false")


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewright")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark
