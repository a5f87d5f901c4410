"""Full-text search: tokens, postings, matching, ranking and snippets."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks around hits, bounds of a snippet and of a result page.
START, STOP = "\x01", "\x02"
LEAST_WORDS, MOST_WORDS = 15, 35
WORD = "[\\p{L}\\p{N}_]+"


def terms(text: Column) -> Column:
    """Lower-cased words of a text in order, without stemming."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def query_terms(query: str) -> list[str]:
    """Distinct words of a plain query; all of them must occur."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def with_terms(pages: DataFrame, text: str = "search_text") -> DataFrame:
    """``pages`` with their ``terms``; kept with the table, so a search does not split texts again."""
    return pages.withColumn("terms", terms(F.col(text)))


def postings(pages: DataFrame, key: str) -> DataFrame:
    """``term, key, positions count`` table for selective queries; partition or bucket it by ``term``."""
    return pages.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("n"))


def match_postings(index: DataFrame, words: list[str], key: str) -> DataFrame:
    """Keys that have all words, with their score, from the postings alone."""
    hit = index.filter(F.col("term").isin(*words)).groupBy(key).agg(F.count(F.lit(1)).alias("_found"), F.sum("n").alias("hits"))
    return hit.filter(F.col("_found") == len(words)).select(key, "hits")


def rank(found: Column, length: Column) -> Column:
    """Our own score: hits per logarithm of the page's length in words."""
    return found / (1.0 + F.log(1.0 + length))


def snippet(text: Column, words: list[str]) -> Column:
    """Up to 35 words around the first hit, with hits between marks that no markup can forge.

    Marks that the text itself has are removed first.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), START + STOP, "")
    parts = F.filter(F.split(clean, "\\s+"), lambda w: w != "")
    pattern = "|".join(sorted(map(re.escape, words), key=len, reverse=True)) or "(?!)"
    whole = f"(?i)(?<![\\p{{L}}\\p{{N}}_])({pattern})(?![\\p{{L}}\\p{{N}}_])"
    first = F.array_position(F.transform(parts, lambda w: w.rlike(whole)), True).cast("int")
    start = F.greatest(F.lit(1), first - (MOST_WORDS - LEAST_WORDS) // 2)
    return F.regexp_replace(F.array_join(F.slice(parts, start, MOST_WORDS), " "), whole, f"{START}$1{STOP}")


#: Columns that name a page.
PAGE_KEY = ["job_id", "page_number"]
#: Folders of a stored index; a query reads those of its words.
PARTS = 64


def _part(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(PARTS)).cast("int")


def write_index(pages: DataFrame, path: str) -> None:
    """The inverted index of pages with ``terms``: ``term, job_id, page_number, n, length``, by part of the term."""
    rows = pages.select(*PAGE_KEY, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    counted = rows.groupBy("term", *PAGE_KEY).agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"))
    # A part has many files where a frequent word fills it, so rows are dealt by page as well.
    dealt = counted.withColumn("part", _part(F.col("term"))).repartition("part", F.pmod(F.xxhash64(*PAGE_KEY), F.lit(8)))
    dealt.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index."""
    return spark.read.parquet(path)


def _from_index(index: DataFrame, words: list[str]) -> DataFrame:
    """``job_id, page_number, rank`` of the pages that have all words, from the parts of the index that hold them."""
    parts = sorted({zlib.crc32(w.encode()) % PARTS for w in words})
    hit = index.filter(F.col("part").isin(parts) & F.col("term").isin(words))
    page = hit.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("_found"), F.sum("n").alias("_hits"), F.first("length").alias("_length"))
    return page.filter(F.col("_found") == len(words)).select(*PAGE_KEY, rank(F.col("_hits"), F.col("_length")).alias("rank"))


def search(
    pages: DataFrame, jobs: DataFrame, documents: DataFrame, query: str, limit: int = 20, index: DataFrame | None = None
) -> DataFrame:
    """The best pages for a query: ``document_id, filename, job_id, page_number, snippet, rank``.

    All words must occur.  With an ``index`` the match and the rank come from it, and texts are read for the
    snippets alone; without one all pages with their ``terms`` are scanned.  Joins follow the match, and snippets
    are made after the limit.  An empty query finds nothing; ties go by document, job and page.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    words = query_terms(query)
    if index is not None:
        scored = _from_index(index, words) if words else _from_index(index, [""]).limit(0)
    else:
        wanted = F.array(*(F.lit(w) for w in words)).cast("array<string>")
        hits = F.size(F.filter("terms", lambda t: F.array_contains(wanted, t)))
        matched = pages.filter(F.lit(bool(words)) & (F.size(F.array_except(wanted, F.col("terms"))) == 0))
        scored = matched.withColumn("rank", rank(hits, F.size("terms")))
    joined = scored.join(jobs.select("job_id", "document_id"), "job_id").join(documents.select("document_id", "filename"), "document_id")
    order = [F.col("rank").desc(), F.col("document_id"), F.col("job_id"), F.col("page_number")]
    top = joined.orderBy(*order).limit(limit)
    if index is not None:
        top = pages.select(*PAGE_KEY, "search_text").join(F.broadcast(top), PAGE_KEY).orderBy(*order)
    return top.select(
        "document_id", "filename", "job_id", "page_number", snippet(F.col("search_text"), words).alias("snippet"), "rank"
    )
