"""Writers: text artifacts, binary artifacts, tables that replace a job's rows, and CSV reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text_artifacts(bodies: DataFrame, path: str, form: str) -> None:
    """``job_id, body`` under ``path/form=.../job_id=...``, one file for each job."""
    rows = bodies.select("job_id", F.lit(form).alias("form"), F.col("body").alias("value"))
    # A job's artifact is one value; the line separator of the writer ends it.
    rows.write.mode("append").partitionBy("form", "job_id").text(path)


def write_binary_artifacts(rows: DataFrame, path: str) -> None:
    """``job_id, name, content`` as Parquet, partitioned by job so that a job can be replaced or dropped."""
    rows.select("job_id", "name", "content").write.mode("append").partitionBy("job_id").parquet(path)


def replace_jobs(rows: DataFrame, path: str, key: str = "job_id") -> None:
    """Write rows so that a replay replaces the partitions of its jobs and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_blocks(pages: DataFrame, blocks: DataFrame, path: str) -> None:
    """Pages and blocks of the jobs in the input, as one version of each job.

    Both tables are written under a new version first.  Only then one small file says which version of these jobs
    counts, so a reader sees the old pages with the old blocks or the new ones with the new ones.
    """
    version = uuid.uuid4().hex
    stamped = [t.withColumn("_version", F.lit(version)) for t in (pages, blocks)]
    for rows, name in zip(stamped, ("pages", "blocks")):
        rows.write.mode("append").partitionBy("_version").parquet(f"{path}/{name}")
    jobs = pages.select("job_id").union(blocks.select("job_id")).distinct()
    said = jobs.select("job_id", F.lit(version).alias("_version"), F.current_timestamp().alias("at"))
    said.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of the latest version of every job."""
    said = spark.read.parquet(f"{path}/versions")
    now = said.groupBy("job_id").agg(F.max_by("_version", F.struct("at", "_version")).alias("_version"))
    pages, blocks = (spark.read.parquet(f"{path}/{name}").join(now, ["job_id", "_version"], "left_semi").drop("_version") for name in ("pages", "blocks"))
    return pages, blocks


def write_report(rows: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def drop_figure_bytes(blocks: DataFrame, url) -> DataFrame:
    """Figures get their URL where a crop was made, and the bytes leave the table."""
    made = F.when((F.col("type") == "figure") & F.col("crop").isNotNull(), url)
    return blocks.withColumn("image_url", made).drop("crop")


def delete_prefix(spark: SparkSession, path: str) -> bool:
    """Delete a folder and all below it in any store that Spark reaches; false if there was nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def comparison_report(samples: DataFrame) -> DataFrame:
    """The columns of the report on single samples, error rates with four decimals."""
    return samples.select(
        F.col("image_path").alias("image"), "language", F.col("truth").alias("actual_text"), "prediction", F.format_number("cer", 4).alias("cer")
    )
