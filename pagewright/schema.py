"""Schemas of the stages: documents, jobs, pages, blocks, and the nested output tree."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
CELL = T.StructType(
    [
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("row_span", T.IntegerType()),
        T.StructField("col_span", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_header", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
TABLE = T.StructType(
    [T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()), T.StructField("cells", T.ArrayType(CELL))]
)
#: One row for each rectangle of a page; columns that a type does not have are null.
BLOCK = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("language", T.StringType()),
        T.StructField("engine_used", T.StringType()),
        T.StructField("table", TABLE),
        T.StructField("subtype", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("alt_text", T.StringType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("needs_review", T.BooleanType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("storage_path", T.StringType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("uploaded_at", T.TimestampNTZType()),
    ]
)
JOB = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("avg_confidence", T.DoubleType()),
        T.StructField("avg_quality_score", T.DoubleType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
    ]
)
#: Fixed value: the states of a job in order.
JOB_STATES = ("queued", "processing", "done", "failed")
