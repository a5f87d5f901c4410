"""Job queue as a stream: files of task messages in, job states out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.catalog import job_states, storage_path, validate_uploads
from ..scratch import kept
from ..sources.files import count_pages
from ..sources.sinks import delete_prefix

MESSAGE = "job_id string, document_id string, enqueued_at timestamp"


def enqueue(spark: SparkSession, path: str, jobs: DataFrame) -> None:
    """Append task messages of jobs (``job_id, document_id``) to the queue folder."""
    jobs.select("job_id", "document_id", F.current_timestamp().alias("enqueued_at")).write.mode("append").json(path)


def task_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The queue folder as a stream; redelivered messages of a job within a day are dropped."""
    raw = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.withWatermark("enqueued_at", "1 day").dropDuplicatesWithinWatermark(["job_id"])


def run_jobs(
    tasks: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    events_path: str,
    checkpoint: str,
):
    """Process each batch of tasks and log job events: processing, then done or failed.

    ``process`` gets ``job_id, document_id`` and returns ``job_id, avg_confidence, avg_quality_score``, and
    maybe ``error_message``: a job with one failed, and no other does.  An exception fails the jobs of its
    batch, with its message, and the stream goes on.  The events of a batch replace those of the same batch, so
    a replay leaves no doubles.
    """

    def handle(batch: DataFrame, number: int) -> None:
        ids = batch.select("job_id", "document_id")
        target = f"{events_path}/batch={number}"
        started = ids.select("job_id", F.lit("processing").alias("status"), F.current_timestamp().alias("at"), F.lit(0).alias("step"))
        empty = F.lit(None).cast("double")
        try:
            found = process(ids)
            said = F.col("error_message") if "error_message" in found.columns else F.lit(None).cast("string")
            done = found.select(
                "job_id",
                F.when(said.isNull(), "done").otherwise("failed").alias("status"),
                F.current_timestamp().alias("at"),
                F.lit(1).alias("step"),
                said.alias("error_message"),
                "avg_confidence",
                "avg_quality_score",
            )
            events = started.withColumn("error_message", F.lit(None).cast("string")).withColumn("avg_confidence", empty)
            events.withColumn("avg_quality_score", empty).unionByName(done).write.mode("overwrite").parquet(target)
        except Exception as error:  # the jobs of this batch failed; the queue must not stop
            failed = ids.select(
                "job_id", F.lit("failed").alias("status"), F.current_timestamp().alias("at"), F.lit(1).alias("step"),
                F.lit(str(error)[:1000]).alias("error_message"), empty.alias("avg_confidence"), empty.alias("avg_quality_score"),
            )
            failed.write.mode("overwrite").parquet(target)

    return (
        tasks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def accept_uploads(spark: SparkSession, files: DataFrame, root: str, s: Settings = DEFAULT) -> DataFrame:
    """Check, store, enter and enqueue uploads (``filename, content_type, content``); gives them back with
    ``reject_reason``, ``document_id`` and ``job_id``, the ids null for what is rejected.

    Contents go to ``root/files``, documents and queued jobs to ``root/documents`` and ``root/jobs``, messages to
    ``root/queue``.  If documents or jobs cannot be written, the stored contents are deleted again; if
    the queue cannot be written, the jobs are entered as failed.  Either error is raised.
    """
    batch = uuid.uuid4().hex
    seen = files.withColumn("size", F.octet_length("content")).withColumn("magic", F.substring("content", 1, 5).cast("string"))
    checked = validate_uploads(count_pages(seen), s)
    ok = F.col("reject_reason").isNull()
    for name in ("document_id", "job_id"):
        checked = checked.withColumn(name, F.when(ok, F.sha2(F.concat_ws(":", F.lit(f"{batch}:{name}"), "filename", F.xxhash64("content")), 256)))
    path = storage_path(F.col("document_id"), F.col("filename"))
    checked = kept(checked.withColumn("storage_path", F.when(ok, path)).drop("magic"), "uploads")
    good = checked.filter("reject_reason IS NULL")
    stored = f"{root}/files/batch={batch}"
    good.select("storage_path", "content").write.parquet(stored)
    jobs = good.select("job_id", "document_id")

    def enter(status: str) -> None:
        jobs.select("job_id", "document_id", F.lit(status).alias("status")).write.mode("append").parquet(f"{root}/jobs")

    try:
        good.select("document_id", "filename", "storage_path", "page_count").write.mode("append").parquet(f"{root}/documents")
    except Exception:
        delete_prefix(spark, stored)
        raise
    try:
        enqueue(spark, f"{root}/queue", jobs)
    except Exception:
        enter("failed")
        raise
    enter("queued")
    return checked.drop("content")


def current_states(spark: SparkSession, events_path: str) -> DataFrame:
    """The latest state of every job."""
    events = spark.read.parquet(events_path)
    return job_states(events, "job_id", ["at", "step"])


def query_status(query) -> str:
    """State of a running stream in the words of a task queue."""
    if query.exception() is not None:
        return "FAILURE"
    return "STARTED" if query.isActive else "SUCCESS"


def health(spark: SparkSession) -> bool:
    """Whether the session runs jobs."""
    return spark.range(1).count() == 1
