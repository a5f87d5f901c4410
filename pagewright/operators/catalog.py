"""Relational operators on documents, jobs, pages and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def point(df: DataFrame, **equal: object) -> DataFrame:
    """The first row with these values."""
    return matching(df, **equal).limit(1)


def matching(df: DataFrame, **equal: object) -> DataFrame:
    """All rows with these values; a value of None sets no condition."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The row of the latest ``order`` in each group; the smallest ``tie`` wins equals.  Nulls come last."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col(tie).asc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every document with its latest job, or nulls; jobs are read once and aggregated before the join."""
    columns = [c for c in jobs.columns if c != "document_id"]
    # The order latest first, nulls last, smallest id first, as one key of one aggregate.
    since = -F.unix_micros(F.col("started_at").cast("timestamp"))
    best = jobs.groupBy("document_id").agg(
        F.min_by(F.struct(*columns), F.struct(F.col("started_at").isNull(), since, F.col("job_id"))).alias("job")
    )
    return documents.join(best, "document_id", "left").select("*", "job.*").drop("job")


def paginate(df: DataFrame, order: list[Column], limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of rows in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def list_documents(documents: DataFrame, jobs: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The newest documents with their latest jobs; paginated first, so only these documents' jobs are ranked."""
    order = [F.col("uploaded_at").desc(), F.col("document_id")]
    page = paginate(documents, order, limit, offset)
    few = jobs.join(F.broadcast(page.select("document_id")), "document_id", "left_semi")
    return latest_job(page, few).orderBy(*order)


def cascade_delete(documents: DataFrame, jobs: DataFrame, pages: DataFrame, blocks: DataFrame, gone: DataFrame):
    """The four tables without the documents in ``gone`` and all that hangs on them."""
    kept_documents = documents.join(gone.select("document_id"), "document_id", "left_anti")
    dead_jobs = jobs.join(gone.select("document_id"), "document_id", "left_semi").select("job_id")
    dead_pages = pages.join(dead_jobs, "job_id", "left_semi").select("page_id")
    return (
        kept_documents,
        jobs.join(dead_jobs, "job_id", "left_anti"),
        pages.join(dead_jobs, "job_id", "left_anti"),
        blocks.join(dead_pages, "page_id", "left_anti"),
    )


def base_name(name: Column) -> Column:
    """File name without any folder, with either slash."""
    return F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)


def storage_path(document_id: Column, filename: Column) -> Column:
    """Where an uploaded document lies; a name without any letters after its folders becomes ``document.pdf``."""
    name = base_name(F.coalesce(filename, F.lit("")))
    return F.concat(F.lit("documents/"), document_id, F.lit("/"), F.when(name == "", "document.pdf").otherwise(name))


def validate_uploads(files: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``reject_reason`` (null: accepted) of ``filename, content_type, size, magic, page_count``; the first failed check."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    reason = (
        F.when(~F.lower(F.coalesce("filename", F.lit(""))).endswith(".pdf"), "extension")
        .when(~kind.isin("application/pdf", "application/octet-stream", ""), "content_type")
        .when(F.coalesce("size", F.lit(0)) == 0, "empty")
        .when(F.col("size") > s.upload_bytes, "too_large")
        .when(~F.coalesce(F.col("magic"), F.lit("")).startswith("%PDF"), "not_a_pdf")
        .when(F.col("page_count").isNull(), "unreadable")
        .when(F.col("page_count") < 1, "no_pages")
    )
    return files.withColumn("filename", base_name(F.col("filename"))).withColumn("reject_reason", reason)


def page_count_repair(documents: DataFrame, counted: DataFrame) -> DataFrame:
    """Declared page counts replaced by counted ones; ``changed`` tells where."""
    joined = documents.join(counted.select("document_id", F.col("page_count").alias("_n")), "document_id", "left")
    changed = F.col("_n").isNotNull() & ~F.col("_n").eqNullSafe(F.col("page_count"))
    return joined.withColumn("changed", changed).withColumn("page_count", F.coalesce("_n", "page_count")).drop("_n")


def search_text(blocks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Texts of a page joined by spaces, in order; tables and figures carry none."""
    entry = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.struct(order, "text"))
    return blocks.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.text), " ").alias("search_text")
    )


def job_states(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest state of each job from its log of events."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def set_status(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs with updates laid over them: null fields of an update leave the job's own."""
    fields = [c for c in updates.columns if c != "job_id"]
    laid = jobs.join(updates.select("job_id", *(F.col(c).alias(f"_{c}") for c in fields)), "job_id", "left")
    columns = [F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in jobs.columns]
    return laid.select(*columns)


def reprocess(jobs: DataFrame, job_ids: DataFrame, at: Column) -> DataFrame:
    """Jobs plus a new queued job for each id; the id follows from the old one, so a replay adds nothing new."""
    new = jobs.join(job_ids.select("job_id").distinct(), "job_id", "left_semi").select(
        F.sha2(F.concat(F.lit("reprocess:"), F.col("job_id")), 256).alias("job_id"),
        "document_id",
        F.lit("queued").alias("status"),
        at.alias("started_at"),
    )
    return jobs.unionByName(new, allowMissingColumns=True)


def result_path(job: Column, form: str) -> Column:
    """Where a finished job's artifact lies."""
    names = {
        "json": "result.json", "markdown": "result.md", "txt": "result.txt", "searchable_pdf": "searchable.pdf",
        "highlighted_pdf": "highlighted.pdf", "structured_pdf": "structured.pdf",
    }
    if form not in names:
        raise ValueError(f"unknown form {form}")
    return F.concat(F.lit("results/"), job, F.lit(f"/{names[form]}"))


def fetch_results(requests: DataFrame, jobs: DataFrame, form: str) -> DataFrame:
    """``job_id, path, error`` of each request: the artifact's path, or why there is none."""
    known = jobs.select("job_id", "status")
    joined = requests.select("job_id").join(known, "job_id", "left")
    error = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "done", "not_done")
    return joined.select("job_id", F.when(error.isNull(), result_path(F.col("job_id"), form)).alias("path"), error.alias("error"))
