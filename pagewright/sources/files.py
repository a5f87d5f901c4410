"""Readers of files: uploads, page fan-out, sample lists, frequency dictionaries, recogniser output."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import base_name

# Fixed value: languages of the sample lists.
SAMPLE_LANGUAGES = ("en", "hi", "mr", "gu")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with what the upload checks need; the content stays a binary column."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("storage_path"),
        base_name(F.col("path")).alias("filename"),
        F.lit("application/octet-stream").alias("content_type"),
        F.col("length").alias("size"),
        F.substring("content", 1, 5).cast("string").alias("magic"),
        F.col("modificationTime").alias("uploaded_at"),
        "content",
    )


PAGE_OBJECT = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
STREAM = re.compile(rb"(?s)<<((?:[^>]|>(?!>))*?/ObjStm(?:[^>]|>(?!>))*?)>>\s*stream\r?\n")


def page_objects(content: bytes, most: int = 1 << 28) -> int:
    """Page objects of a PDF, those inside compressed object streams too; ``most`` bounds what a stream inflates to."""
    n = len(PAGE_OBJECT.findall(content))
    for m in STREAM.finditer(content):
        stop = content.find(b"endstream", m.end())
        body = content[m.end() : stop if stop >= 0 else len(content)]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body, most)
            except zlib.error:
                continue
            n += len(PAGE_OBJECT.findall(body))
    return n


@F.pandas_udf(T.LongType())
def _page_objects(content: pd.Series) -> pd.Series:
    return content.map(lambda c: page_objects(bytes(c)) if c is not None else 0).astype("int64")


def count_pages(files: DataFrame) -> DataFrame:
    """Page count of PDF content: the number of page objects, plain or in compressed object streams, 1 where none can be
    seen (encrypted or damaged files)."""
    return files.withColumn("page_count", F.greatest(_page_objects("content"), F.lit(1)))


def fan_out_pages(documents: DataFrame) -> DataFrame:
    """One row for each page of a document, numbered from 1; no rows without pages."""
    some = documents.filter(F.col("page_count") >= 1)
    return some.withColumn("page_number", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))))


def read_sample_list(spark: SparkSession, path: str, languages: tuple[str, ...] = SAMPLE_LANGUAGES) -> DataFrame:
    """Tab-separated ``image_path, language, truth``; blank lines, comments, lines without exactly three fields and
    other languages are skipped."""
    lines = spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select(F.split("value", "\t", -1).alias("p")).filter(F.size("p") == 3)
    rows = parts.select(F.col("p")[0].alias("image_path"), F.col("p")[1].alias("language"), F.col("p")[2].alias("truth"))
    return rows.filter(F.col("language").isin(*languages))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``word, count`` of a frequency dictionary; malformed lines are skipped, repeated words added up."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("p")).filter(F.size("p") == 2)
    typed = rows.select(F.col("p")[0].alias("word"), F.expr("try_cast(p[1] AS BIGINT)").alias("count"))
    return typed.dropna().groupBy("word").agg(F.sum("count").alias("count"))


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser output as JSON lines with an explicit schema."""
    schema = (
        "document_id string, page_number int, rec_texts array<string>, rec_scores array<double>, "
        "rec_polys array<array<struct<x:double,y:double>>>"
    )
    return spark.read.schema(schema).json(path)
