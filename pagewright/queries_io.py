"""Registered queries of readers, writers, the queue, and of small operators that the other queries do not show."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import assemble, blocks, catalog, correction, layout, quality, spatial
from .plans import lineblocks as L
from .plans import pages as P
from .queries import _DOUBLED, LINES, TYPED, _doubled, _edges, _lines, _ordered, _sized, _t, query
from .scratch import shared_dir
from .sources import files, seams, sinks
from .streaming import ingest


def _folder(spark: SparkSession) -> str:
    """A new folder for one run of a query."""
    return f"{shared_dir(spark)}/pagewright/run-{uuid.uuid4().hex[:12]}"


# --- readers and writers --------------------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT n_nationkey, '%PDF-1.4 ' || n_name || repeat(' /Type /Page ', n_nationkey % 4) || ' /Type /Pages' AS body FROM nation)
    SELECT n_nationkey AS job_id, CAST(strlen(body) + 1 AS BIGINT) AS size, '%PDF-' AS magic, greatest(n_nationkey % 4, 1) AS page_count FROM b"""
)
def read_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text artifacts written, read as uploaded files, and their pages counted."""
    n = _t(spark, sf_dir, "nation")
    pages = F.repeat(F.lit(" /Type /Page "), (F.col("n_nationkey") % 4).cast("int"))
    body = F.concat(F.lit("%PDF-1.4 "), "n_name", pages, F.lit(" /Type /Pages"))
    root = _folder(spark)
    sinks.write_text_artifacts(n.select(F.col("n_nationkey").alias("job_id"), body.alias("body")), root, "pdf")
    found = files.count_pages(files.read_uploads(spark, f"{root}/form=pdf/*/*.txt"))
    job = F.regexp_extract("storage_path", "job_id=([0-9]+)", 1).cast("long")
    return found.select(job.alias("job_id"), "size", "magic", F.col("page_count").cast("long").alias("page_count"))


@query(
    """SELECT s_suppkey AS job_id, 'documents/' || s_suppkey || '/' || CASE WHEN s_suppkey % 5 = 0 THEN 'document.pdf' ELSE s_suppkey || '.pdf' END AS name, md5(s_name) AS content FROM supplier"""
)
def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary artifacts under the path rule of documents, written and read back."""
    key = F.col("s_suppkey")
    name = F.when(key % 5 == 0, "in/").otherwise(F.concat(F.lit("C:\\in\\"), key.cast("string"), F.lit(".pdf")))
    rows = _t(spark, sf_dir, "supplier").select(
        key.alias("job_id"), catalog.storage_path(key.cast("string"), name).alias("name"), F.col("s_name").cast("binary").alias("content")
    )
    root = _folder(spark)
    sinks.write_binary_artifacts(rows, root)
    return spark.read.parquet(root).select(F.col("job_id").cast("long").alias("job_id"), "name", F.md5("content").alias("content"))


@query(
    """WITH v AS (SELECT o_custkey % 8 AS job_id, o_orderkey, CASE WHEN o_custkey % 8 IN (3, 5) THEN 2 ELSE 1 END AS version FROM orders)
    SELECT job_id, version, count(*) AS pages, count(*) AS blocks FROM v GROUP BY ALL"""
)
def replace_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and blocks of eight jobs, of which two are written again: a replay replaces its jobs alone."""
    rows = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("job_id"), "o_orderkey", F.lit(1).alias("version"))
    root = _folder(spark)
    sinks.write_blocks(rows, rows, root)
    again = rows.filter("job_id IN (3, 5)").withColumn("version", F.lit(2))
    sinks.write_blocks(again, again, root)
    pages, found = sinks.read_blocks(spark, root)
    n = pages.groupBy("job_id", "version").agg(F.count(F.lit(1)).alias("pages"))
    m = found.groupBy("job_id", "version").agg(F.count(F.lit(1)).alias("blocks"))
    return n.join(m, ["job_id", "version"]).select(F.col("job_id").cast("long").alias("job_id"), "version", "pages", "blocks")


@query("SELECT 'before' AS moment, count(*) AS n, true AS deleted FROM nation UNION ALL SELECT 'after', 0, false")
def delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    _t(spark, sf_dir, "nation").write.parquet(root)
    n = spark.read.parquet(root).count()
    rows = [("before", n, sinks.delete_prefix(spark, root)), ("after", 0, sinks.delete_prefix(spark, root))]
    return spark.createDataFrame(rows, "moment string, n long, deleted boolean")


@query(
    """SELECT p_partkey || '.png' AS image, p_type AS language, p_name AS actual_text, replace(p_name, 'e', '') AS prediction,
      printf('%.4f', levenshtein(replace(p_name, 'e', ''), p_name) / length(p_name)) AS cer FROM part"""
)
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import metrics

    part = _t(spark, sf_dir, "part")
    rows = part.select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("image_path"), F.col("p_type").alias("language"),
        F.replace("p_name", F.lit("e"), F.lit("")).alias("prediction"), F.col("p_name").alias("truth"),
    )
    root = _folder(spark)
    sinks.write_report(sinks.comparison_report(rows.withColumn("cer", metrics.cer(F.col("prediction"), F.col("truth")))), root)
    return spark.read.option("header", True).csv(root)


@query(
    """SELECT p_partkey || '.png' AS image_path, CASE p_size % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE 'gu' END AS language, p_name AS truth FROM part WHERE p_size % 4 <> 3 AND p_size % 5 <> 0"""
)
def read_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample list with comments, lines of other languages and lines of too many fields."""
    k = F.col("p_size")
    lang = F.element_at(F.array(*map(F.lit, ("en", "hi", "gu", "fr"))), (k % 4 + 1).cast("int"))
    more = F.when(k % 5 == 0, "\textra").otherwise("")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(".png\t"), lang, F.lit("\t"), "p_name", more)
    part = _t(spark, sf_dir, "part").select(line.alias("value"))
    root = _folder(spark)
    part.union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(root)
    return files.read_sample_list(spark, root)


@query("SELECT w AS word, CAST(count(*) * 3 AS BIGINT) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def read_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frequency dictionary whose words come twice, among lines that are no entries."""
    words = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    line = F.explode(F.array(F.concat_ws(" ", "w", "n"), F.concat_ws("\t", "w", F.col("n") * 2), F.concat_ws(" ", "w", F.lit("many")), F.col("w")))
    root = _folder(spark)
    words.select(line.alias("value")).write.text(root)
    return files.read_frequencies(spark, root)


@query(
    LINES
    + """SELECT d.doc_id AS document_id, count(l.seq) AS blocks, d.doc_id % 9 = 0 AS failed
    FROM documents d LEFT JOIN (SELECT * FROM lines WHERE doc_id % 9 <> 0) l USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id"""
)
def recognise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recogniser seam over page images; it fails on every ninth, and says so."""

    def load():
        def read(image: bytes):
            if image.startswith(b"!"):
                raise ValueError("unreadable")
            return seams.fake_reader(image)

        return read

    docs = _t(spark, sf_dir, "documents").filter("text IS NOT NULL")
    image = F.concat(F.when(F.col("doc_id") % 9 == 0, "!").otherwise(""), "text").cast("binary")
    pages = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), image.alias("image"))
    found = blocks.parse_lines(seams.recognise(pages, load), errors=True)
    counted = found.groupBy("document_id").agg(F.count("seq").alias("blocks"), F.max(F.col("error").isNotNull()).alias("failed"))
    out = pages.select("document_id").join(counted, "document_id", "left")
    return out.select(F.col("document_id").cast("long").alias("document_id"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("failed", F.lit(False)).alias("failed"))


# --- single operators -----------------------------------------------------------------------------------------


@query("SELECT c_custkey AS document_id, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "document_id")
    return catalog.point(found, document_id=7).select("document_id", "c_name")


@query("SELECT count(*) AS n, min(doc_id) AS first FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents) AND n_chars >= 100")
def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    first = docs.agg(F.min("source")).first()[0]
    found = catalog.matching(docs, lang="en", source=first).filter("n_chars >= 100")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT true AS healthy")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(ingest.health(spark)).alias("healthy"))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'results/' || o_orderkey || '/result.md' END AS path, CASE WHEN o_orderstatus <> 'F' THEN 'not_done' END AS error FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT -o_orderkey, NULL, 'not_found' FROM orders WHERE o_orderkey % 2 = 1")
def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"))
    asked = jobs.select(F.when(F.col("job_id") % 2 == 0, F.col("job_id")).otherwise(-F.col("job_id")).alias("job_id"))
    return catalog.fetch_results(asked, jobs, "markdown")


@query(
    TYPED
    + """ SELECT doc_id AS document_id, seq, type, CASE WHEN seq % 3 = 0 THEN 0.0 ELSE confidence END AS confidence, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1 FROM b WHERE seq % 4 <> 1"""
)
def parse_fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    box = F.when(F.col("seq") % 4 != 1, F.array(b.x0, b.y0, b.x1, b.y1))
    raw = _lines(spark, sf_dir).withColumn("bbox", box).withColumn("confidence", F.when(F.col("seq") % 3 != 0, F.col("confidence")))
    return blocks.parse_fallback_lines(raw).select("document_id", "seq", "type", "confidence", *_edges("x0", "y1"))


@query(
    LINES
    + """l AS (SELECT *, ['image', 'table', 'chart', 'text', 'picture'][seq % 5 + 1] AS label FROM lines WHERE seq % 6 <> 2)
    SELECT doc_id AS document_id, seq, label, CASE WHEN label = 'table' THEN 'table' WHEN label <> 'text' THEN 'figure' END AS kind,
      CASE WHEN label = 'chart' THEN 'chart' WHEN label IN ('image', 'picture') THEN 'image' END AS subtype FROM l WHERE label <> 'text'"""
)
def structure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout boxes to table windows and figure regions; boxes without four coordinates are dropped."""
    b = F.col("bbox")
    label = F.element_at(F.array(*map(F.lit, ("image", "table", "chart", "text", "picture"))), (F.col("seq") % 5 + 1).cast("int"))
    point = F.when(F.col("seq") % 6 != 2, F.array(b.x0, b.y0, b.x1, b.y1)).otherwise(F.array(b.x0, b.y0))
    boxes = _sized(_lines(spark, sf_dir)).select(
        "document_id", "page_number", "seq", label.alias("label"), F.col("confidence").alias("score"), point.alias("coordinate"),
        "page_width", F.lit(1 << 20).alias("page_height"),
    )
    tables, figures = blocks.analyze_structure(boxes)
    a = tables.select("document_id", "seq", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("subtype"))
    both = a.unionByName(figures.select("document_id", "seq", F.lit("figure").alias("kind"), "subtype"))
    return both.join(boxes.select("document_id", "seq", "label"), ["document_id", "seq"])


@query(
    LINES
    + "SELECT doc_id AS document_id, seq, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM lines"
)
def block_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.center(F.col("bbox"))
    return _lines(spark, sf_dir).select("document_id", "seq", c.x.alias("x"), c.y.alias("y"))


@query(
    TYPED
    + """, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN seq % 7 = 3 THEN 1 ELSE 0 END, seq) - 1 AS seq,
      CASE WHEN seq % 7 = 3 THEN 'figure' ELSE type END AS type, text FROM b)
    SELECT doc_id AS document_id, seq, type, CASE WHEN type <> 'figure' THEN md5(text) END AS text, type = 'figure' AS captioned FROM k"""
)
def union_and_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and figures of a page in one order, with the fields that each type has."""
    lines = _lines(spark, sf_dir)
    figures = L.structures(lines).withColumn("caption", F.lit("Figure 1"))
    both = blocks.union_blocks(lines.filter("seq % 7 <> 3"), figures).withColumn("reading_order", F.col("seq"))
    out = assemble.project_by_type(both.withColumn("caption", F.coalesce("caption", F.lit("none"))))
    return out.select(
        "document_id", F.col("reading_order").cast("long").alias("seq"), "type", F.md5("text").alias("text"), F.col("caption").isNotNull().alias("captioned")
    )


@query(
    TYPED
    + """, r AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence >= 0.75 THEN 'flagged' ELSE 'needs_review' END AS review_status FROM b)
    SELECT doc_id AS document_id, seq, review_status, review_status = 'needs_review' AND seq % 3 <> 0 AS needs_review FROM r"""
)
def corrected_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.review_routing(_lines(spark, sf_dir)).withColumn("correction_applied", F.when(F.col("seq") % 3 == 0, True))
    return quality.corrected_needs_no_review(rows).select("document_id", "seq", "review_status", "needs_review")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS delay, p_size % 4 = 1 AS daily FROM part"""
)
def error_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider's error says: how long to wait, and whether the quota of the day is used up."""
    info = '{"@type":"type.googleapis.com/google.rpc.RetryInfo","retryDelay":"%ss"}'
    day = '{"@type":"type.googleapis.com/google.rpc.QuotaFailure","violations":[{"quotaId":"Requests%s"}]}'
    wait = F.format_string(info, F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise("soon"))
    quota = F.format_string(day, F.when(F.col("p_size") % 4 == 1, "PerDayPerModel").otherwise("PerMinute"))
    payload = F.concat(F.lit('{"error":{"code":429,"details":['), quota, F.lit(","), wait, F.lit("]}}"))
    return _t(spark, sf_dir, "part").select("p_partkey", correction.retry_delay(payload).alias("delay"), correction.daily_quota(payload).alias("daily"))


@query(
    LINES
    + """k AS (SELECT doc_id, lang, text, confidence < 0.98 AS asked FROM lines)
    SELECT CASE WHEN NOT asked THEN 'skipped_high_confidence' WHEN length(text) % 7 = 0 THEN 'api_error' ELSE 'ok' END AS correction_reason, count(*) AS n FROM k GROUP BY ALL"""
)
def provider_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through a provider in batches, which fails on some of them; the policy spaces nothing here."""

    def provider(items: list[dict]) -> dict[str, str]:
        if any(len(i["text"]) % 7 == 0 for i in items):
            raise correction.Retryable(400)
        return {i["block_id"]: i["text"] for i in items}

    s = correction.Settings(requests_per_minute=1 << 40)
    checked = correction.precheck(_lines(spark, sf_dir), None, s)
    answers = correction.ask(correction.distinct_requests(checked), provider, 1, s)
    return correction.apply_answers(checked, answers, s).groupBy("correction_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    _DOUBLED
    + """, t AS (SELECT u.*, EXISTS (SELECT 1 FROM lines s WHERE s.doc_id = u.doc_id AND s.seq % 7 = 3 AND (u.x1 - u.x0) * (u.y1 - u.y0) > 0
        AND greatest(least(u.x1, s.x1) - greatest(u.x0, s.x0), 0) * greatest(least(u.y1, s.y1 + 10) - greatest(u.y0, s.y0), 0) >= 0.6 * (u.x1 - u.x0) * (u.y1 - u.y0)) AS inside
      FROM u WHERE seq % 7 <> 3 OR seq >= 100000),
    w AS (SELECT a.doc_id, count(*) AS n FROM t a JOIN t c ON a.doc_id = c.doc_id AND c.seq = a.seq + 100000 AND NOT a.inside AND NOT c.inside
      WHERE a.seq < 100000 AND (a.x1 - a.x0 - 3.0) / (a.x1 - a.x0 + 3.0) >= 0.5 GROUP BY a.doc_id)
    SELECT t.doc_id AS document_id, CAST(sum(CASE WHEN inside THEN 1 ELSE 0 END) AS BIGINT) AS inside_structures, coalesce(max(w.n), 0) AS duplicates
    FROM t LEFT JOIN w USING (doc_id) GROUP BY t.doc_id"""
)
def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    copies = _doubled(lines).filter("seq >= 100000 OR seq % 7 <> 3").withColumn("seq", F.col("seq").cast("int"))
    found = L.removal_counts(copies.unionByName(L.structures(lines)))
    texts = copies.select("document_id").distinct()
    return texts.join(found, "document_id", "left").select("document_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("inside_structures", "duplicates")))


@query(
    LINES
    + """p AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
    SELECT d.doc_id AS document_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 6 = 5 THEN 'error' ELSE 'original' END AS ocr_attempt,
      CASE WHEN doc_id % 6 = 0 THEN '[OCR ERROR on page 1: no image]' WHEN doc_id % 6 = 5 THEN '[OCR ERROR on page 1: out of memory]' END AS said,
      CASE WHEN doc_id % 6 IN (0, 5) THEN 1 ELSE coalesce(n, 0) END AS blocks FROM documents d LEFT JOIN p USING (doc_id)"""
)
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, some of which cannot be rasterised and some not recognised; the structure model fails on all."""
    k = F.col("document_id")
    # A recogniser that is sure and found much: every page that it reads is accepted.
    s = P.DEFAULT.__class__(primary_confidence=0.0, quality_threshold=0.0, script_share=2.0)
    lines = _lines(spark, sf_dir)
    pages = _sized(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number")))
    pages = pages.withColumn("error", F.when(k % 6 == 0, "no image"))

    def read(asked: DataFrame) -> DataFrame:
        bad = asked.filter(k % 6 == 5).select("document_id", "page_number", F.lit("out of memory").alias("error"))
        return lines.join(asked.filter(k % 6 != 5).select("document_id", "page_number"), blocks.PAGE, "left_semi").unionByName(bad, allowMissingColumns=True)

    def broken(asked: DataFrame) -> DataFrame:
        raise RuntimeError("no model")

    found, attempts = P.extract_pages(pages, read, [], broken, broken, s)
    said = F.max(F.when(F.col("engine_used") == "error", F.col("text")))
    counted = found.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), said.alias("said"))
    out = attempts.join(counted, "document_id", "left")
    return out.select("document_id", "ocr_attempt", "said", F.coalesce("blocks", F.lit(0)).alias("blocks"))


# --- queue ----------------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey AS job_id, CASE WHEN c_custkey % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'cannot read' END AS error_message,
      CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS avg_confidence FROM customer"""
)
def run_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs through the queue: messages, a stream over them, states; every seventh job fails and no other does."""
    root = _folder(spark)
    c = _t(spark, sf_dir, "customer")
    jobs = c.select(F.col("c_custkey").cast("string").alias("job_id"), F.col("c_nationkey").cast("string").alias("document_id"))
    ingest.enqueue(spark, f"{root}/queue", jobs)

    def process(asked: DataFrame) -> DataFrame:
        bad = F.col("job_id").cast("long") % 7 == 0
        value = F.when(~bad, F.col("document_id").cast("double"))
        return asked.select("job_id", value.alias("avg_confidence"), value.alias("avg_quality_score"), F.when(bad, "cannot read").alias("error_message"))

    stream = ingest.run_jobs(ingest.task_stream(spark, f"{root}/queue"), process, f"{root}/events", f"{root}/checkpoint")
    stream.awaitTermination()
    found = ingest.current_states(spark, f"{root}/events")
    return found.select(F.col("job_id").cast("long").alias("job_id"), "status", "error_message", "avg_confidence")


@query(
    """SELECT s_suppkey AS upload, CASE WHEN s_suppkey % 5 = 0 THEN 'extension' WHEN s_suppkey % 4 = 0 THEN 'not_a_pdf' END AS reject_reason,
      CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 THEN 'queued' END AS status, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 THEN 1 ELSE 0 END AS messages FROM supplier"""
)
def accept_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads checked, stored, entered as documents and jobs, and put into the queue."""
    k = F.col("s_suppkey")
    body = F.concat(F.when(k % 4 == 0, "<html>").otherwise("%PDF-1.4 "), F.lit("/Type /Page ")).cast("binary")
    name = F.concat(F.lit("a/"), k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".pdf"))
    rows = _t(spark, sf_dir, "supplier").select(k.alias("upload"), name.alias("filename"), F.lit("application/pdf").alias("content_type"), body.alias("content"))
    root = _folder(spark)
    checked = ingest.accept_uploads(spark, rows, root)
    jobs = spark.read.parquet(f"{root}/jobs")
    sent = spark.read.schema(ingest.MESSAGE).json(f"{root}/queue").groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("messages"))
    out = checked.select("upload", "reject_reason", "job_id").join(jobs.select("job_id", "status"), "job_id", "left").join(sent, "job_id", "left")
    return out.select("upload", "reject_reason", "status", F.coalesce("messages", F.lit(0)).alias("messages"))
