"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, on one machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that this process has written and not deleted.
WRITTEN: list[str] = []


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> str:
    """Write ``df`` as Parquet into the shared folder and return its path.

    A written table cuts the lineage: later reads survive the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/pagewright/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    WRITTEN.append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`write_table`, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table written so far, once no result that reads them is needed any more."""
    for path in list(WRITTEN):
        drop_table(spark, path)


def kept(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a written table with the same schema: what made it runs once."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, codec))


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` (few narrow columns) marked for broadcast if it has at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
