"""Catalog, search, sources, sinks, streams and seams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import blocks, catalog, search
from pagewright.sources import files, seams, sinks
from pagewright.streaming import ingest, state


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


def test_latest_job(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    rows = [("j2", "a", at(5), "done"), ("j1", "a", at(5), "failed"), ("j0", "a", at(1), "done"), ("k", "b", None, "queued")]
    jobs = spark.createDataFrame(rows, "job_id string, document_id string, started_at timestamp_ntz, status string")
    found = {r.document_id: r.job_id for r in catalog.latest_job(docs, jobs).collect()}
    assert found == {"a": "j1", "b": "k", "c": None}
    assert {r.job_id for r in catalog.latest(jobs, ["document_id"], "started_at", "job_id").collect()} == {"j1", "k"}


def test_point_and_pages(spark):
    df = spark.range(30)
    assert catalog.point(df, id=7).collect()[0].id == 7
    assert [r.id for r in catalog.paginate(df, [F.col("id").desc()], 3, 4).collect()] == [25, 24, 23]


def test_uploads(spark):
    rows = [
        ("a.PDF", "", 10, "%PDF-", 1, None), ("C:\\x\\b.pdf", "application/pdf", 10, "%PDF-", 2, None), ("c.txt", "", 10, "%PDF-", 1, "extension"),
        ("d.pdf", "text/html", 10, "%PDF-", 1, "content_type"), ("e.pdf", "", 0, "", 1, "empty"), ("f.pdf", "", 50 * 1024 * 1024 + 1, "%PDF-", 1, "too_large"),
        ("g.pdf", "", 50 * 1024 * 1024, "%PDF-", 1, None), ("h.pdf", "", 9, "PK", 1, "not_a_pdf"), ("i.pdf", "", 9, "%PDF-", None, "unreadable"),
        ("j.pdf", "", 9, "%PDF-", 0, "no_pages"), (None, None, None, None, None, "extension"),
    ]
    df = spark.createDataFrame(rows, "filename string, content_type string, size long, magic string, page_count int, want string")
    found = catalog.validate_uploads(df).collect()
    assert [r.reject_reason for r in found] == [r[-1] for r in rows]
    assert found[1].filename == "b.pdf"


def test_status_and_reprocess(spark):
    jobs = spark.createDataFrame([("1", "d", "queued", None), ("2", "e", "done", 0.5)], "job_id string, document_id string, status string, avg_confidence double")
    updates = spark.createDataFrame([("1", "processing", None), ("2", None, 0.7)], "job_id string, status string, avg_confidence double")
    found = {r.job_id: (r.status, r.avg_confidence) for r in catalog.set_status(jobs, updates).collect()}
    assert found == {"1": ("processing", None), "2": ("done", 0.7)}
    more = catalog.reprocess(jobs.withColumn("started_at", F.lit(None).cast("timestamp")), jobs.filter("job_id = '2'"), F.current_timestamp())
    assert sorted((r.document_id, r.status) for r in more.collect()) == [("d", "queued"), ("e", "done"), ("e", "queued")]
    assert catalog.point(jobs, job_id="9").count() == 0
    path = spark.range(1).select(catalog.result_path(F.lit("j"), "markdown")).first()[0]
    assert path == "results/j/result.md"
    with pytest.raises(ValueError):
        catalog.result_path(F.lit("j"), "docx")


def test_search(spark):
    rows = [("j1", 1, "Alpha beta, beta gamma"), ("j1", 2, "alpha only"), ("j2", 1, "BETA alpha \x01evil\x02 " + "word " * 60), ("j3", 1, None), ("j4", 1, "alphabet beta")]
    pages = search.with_terms(spark.createDataFrame(rows, "job_id string, page_number int, search_text string"))
    jobs = spark.createDataFrame([(f"j{i}", f"d{i}") for i in range(1, 5)], "job_id string, document_id string")
    docs = spark.createDataFrame([(f"d{i}", f"f{i}") for i in range(1, 5)], "document_id string, filename string")
    found = search.search(pages, jobs, docs, "beta ALPHA beta").collect()
    assert [(r.filename, r.page_number) for r in found] == [("f1", 1), ("f2", 1)]
    assert found[0].snippet == "\x01Alpha\x02 \x01beta\x02, \x01beta\x02 gamma"
    assert "evil" in found[1].snippet and "\x01evil" not in found[1].snippet and len(found[1].snippet.split()) <= 35
    assert search.search(pages, jobs, docs, " .,;").count() == 0
    assert search.search(pages, jobs, docs, "alpha", 1).count() == 1
    with pytest.raises(ValueError):
        search.search(pages, jobs, docs, "x", 101)
    keyed = pages.withColumn("k", F.concat("job_id", F.col("page_number")))
    assert {r.k for r in search.match_postings(search.postings(keyed, "k"), ["alpha", "beta"], "k").collect()} == {"j11", "j21"}


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\na.png\ten\thello\nb.png\thi\t\u0928\nc.png\tfr\tnon\nbroken\ten\nd\ten\tx\ty\n")
    assert [r.image_path for r in files.read_sample_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.png", "b.png"]
    (tmp_path / "freq.txt").write_text("the 10\n cat 3\nbad\nthe 5\nx y\n")
    assert {r.word: r["count"] for r in files.read_frequencies(spark, str(tmp_path / "freq.txt")).collect()} == {"the": 15, "cat": 3}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type/Page /Type /Pages")
    (tmp_path / "up" / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    up = files.count_pages(files.read_uploads(spark, str(tmp_path / "up"))).orderBy("filename").collect()
    assert [(r.filename, r.page_count, r.magic) for r in up] == [("a.pdf", 2, "%PDF-"), ("b.pdf", 1, "%PDF-")]
    docs = spark.createDataFrame([("a", 3), ("b", 0), ("c", None)], "document_id string, page_count int")
    assert [r.page_number for r in files.fan_out_pages(docs).orderBy("page_number").collect()] == [1, 2, 3]
    (tmp_path / "ocr.json").write_text('{"document_id": "d", "page_number": 1, "rec_texts": ["a"], "rec_scores": [0.5], "rec_polys": [[{"x": 0, "y": 0}]]}\n')
    assert blocks.parse_lines(files.read_ocr_json(spark, str(tmp_path / "ocr.json"))).first().text == "a"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replace_jobs(spark.createDataFrame([("a", 1), ("b", 1)], "job_id string, v int"), path)
    sinks.replace_jobs(spark.createDataFrame([("b", 2)], "job_id string, v int"), path)
    assert sorted((r.job_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    bodies = spark.createDataFrame([("a", "x\ny")], "job_id string, body string")
    sinks.write_text_artifacts(bodies, str(tmp_path / "text"), "md")
    assert spark.read.text(str(tmp_path / "text"), wholetext=True).first().value.strip() == "x\ny"
    sinks.write_binary_artifacts(spark.createDataFrame([("a", "n", b"\x00")], "job_id string, name string, content binary"), str(tmp_path / "bin"))
    assert spark.read.parquet(str(tmp_path / "bin")).first().content == b"\x00"
    sinks.write_report(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    figures = spark.createDataFrame([("figure", b"x"), ("figure", None), ("paragraph", b"x")], "type string, crop binary")
    assert [r.image_url for r in sinks.drop_figure_bytes(figures, F.lit("u")).collect()] == ["u", None, None]


def test_queue_stream(spark, tmp_path):
    queue, events, mark = (str(tmp_path / n) for n in ("q", "e", "c"))
    ingest.enqueue(spark, queue, spark.createDataFrame([("j1", "d1"), ("j2", "d2")], "job_id string, document_id string"))

    def process(tasks):
        return tasks.select("job_id", F.lit(0.9).alias("avg_confidence"), F.lit(0.8).alias("avg_quality_score"))

    query = ingest.run_jobs(ingest.task_stream(spark, queue), process, events, mark)
    query.awaitTermination(60)
    assert ingest.query_status(query) == "SUCCESS" and ingest.health(spark)
    assert {r.job_id: r.status for r in ingest.current_states(spark, events).collect()} == {"j1": "done", "j2": "done"}

    def broken(tasks):
        raise ValueError("no model")

    ingest.enqueue(spark, queue, spark.createDataFrame([("j3", "d3"), ("j1", "d1")], "job_id string, document_id string"))
    ingest.run_jobs(ingest.task_stream(spark, queue), broken, events, mark).awaitTermination(60)
    states = {r.job_id: (r.status, r.error_message) for r in ingest.current_states(spark, events).collect()}
    assert states["j3"] == ("failed", "no model") and states["j1"][0] == "done"


EVENTS = [("a", 0, True), ("a", 10, False), ("a", 29, True), ("a", 30, False), ("a", 31, True), ("a", 60, False), ("a", 61, False), ("b", 5, False)]


def test_breakers_agree(spark, tmp_path):
    rows = [(k, at(m), f, i) for i, (k, m, f) in enumerate(EVENTS)]
    df = spark.createDataFrame(rows, "key string, at timestamp, failed boolean, n long")
    batch = state.breaker_batch(df, "key", "at", "n", F.col("failed"))
    want = [False, True, True, False, False, True, False, False]
    assert [r.skipped for r in batch.orderBy("n").collect()] == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 hour")
    gated = state.breaker_stream(stream)
    query = gated.writeStream.format("memory").queryName("gated").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = spark.table("gated").orderBy("key", "at").collect()
    assert [r.skipped for r in found] == want


def test_spacing(spark):
    rows = [("a", at(0, s), i) for i, s in enumerate([0, 1, 2, 50, 100, 101])]
    df = spark.createDataFrame(rows, "key string, at timestamp, n long")
    found = state.spaced_calls(df, ["key"], "at", "n", 5).orderBy("n").collect()
    assert [r.wait_us // 10**6 for r in found] == [0, 11, 22, 0, 0, 11]


def test_seams(spark):
    pages = spark.createDataFrame([("d", 1, b"One line\nsecond"), ("d", 2, None)], "document_id string, page_number int, image binary")
    raw = seams.recognise(pages, lambda: seams.fake_reader)
    found = blocks.parse_lines(raw).orderBy("seq").collect()
    assert [(r.page_number, r.text) for r in found] == [(1, "One line"), (1, "second")]
    assert not seams.no_tables(pages).first().has_table


def test_image_kernels():
    r = np.random.default_rng(0)
    flat, noisy = np.full((64, 64), 100, np.uint8), r.integers(0, 255, (64, 64)).astype(np.uint8)
    assert seams.needs_denoising(flat) and not seams.needs_denoising(noisy)
    two = np.concatenate([np.full(500, 40), np.full(500, 200)]).astype(np.uint8).reshape(20, 50)
    assert 40 <= seams.otsu_threshold(two) < 200
    page = np.full((80, 80), 220, np.uint8)
    page[40:44, 10:70] = 30
    out = seams.adaptive_threshold(page)
    assert out[41, 30] == 0 and out[10, 10] == 255 and set(np.unique(out)) <= {0, 255}
    grey = np.tile(np.linspace(100, 130, 128).astype(np.uint8), (128, 1))
    better = seams.equalise_tiles(grey)
    assert better.shape == grey.shape and better.max() - better.min() > int(grey.max()) - int(grey.min())


def test_results_and_deletion(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "done"), ("b", "queued")], "job_id string, status string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    found = [(r.job_id, r.path, r.error) for r in catalog.fetch_results(asked, jobs, "txt").orderBy("job_id").collect()]
    assert found == [("a", "results/a/result.txt", None), ("b", None, "not_done"), ("c", None, "not_found")]
    (tmp_path / "x").mkdir()
    assert sinks.delete_prefix(spark, str(tmp_path / "x")) and not sinks.delete_prefix(spark, str(tmp_path / "x"))
    samples = spark.createDataFrame([("i.png", "en", "truth", "trut", 0.2)], "image_path string, language string, truth string, prediction string, cer double")
    assert sinks.comparison_report(samples).first().cer == "0.2000"


def test_pages_in_object_streams():
    import zlib

    from pagewright.sources.files import page_objects

    body = zlib.compress(b"1 0 2 40 << /Type /Page /Parent 3 0 R >> << /Type/Page >> << /Type /Pages /Count 3 >>")
    pdf = b"%%PDF-1.5\n4 0 obj << /Type /Page >> endobj\n5 0 obj << /Type /ObjStm /N 3 /Filter /FlateDecode /Length %d >> stream\n" % len(body)
    assert page_objects(pdf + body + b"\nendstream endobj") == 3
    assert page_objects(pdf + b"no deflate data\nendstream endobj") == 1
    assert page_objects(b"") == 0


def test_breaker_spells_like_a_fold(spark):
    import random

    from pagewright.streaming import state

    r = random.Random(5)
    rows = [(r.randrange(3), i, r.randrange(40_000), r.random() < 0.4) for i in range(600)]
    df = spark.createDataFrame([(k, i, t, f) for k, i, t, f in rows], "k int, id long, t long, bad boolean")
    df = df.withColumn("at", df.t.cast("timestamp")).repartition(5)
    found = {x.id: x.skipped for x in state.breaker_batch(df, "k", "at", "id", df.bad).collect()}
    until, want = {}, {}
    for k, i, t, bad in sorted(rows, key=lambda x: (x[2], x[1])):
        want[i] = t < until.get(k, -1)
        if bad and t >= until.get(k, -1):
            until[k] = t + 1800
    # An event at the very time of a failure comes before or after it by its id, as in the fold.
    assert found == want
