"""Correction, spelling, tables, exports, assembly, language and accuracy."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright import queries as Q
from pagewright.config import Settings
from pagewright.operators import assemble, correction, export, language, layout, metrics, quality, spell, tables
from pagewright.schema import TABLE

from .test_blocks import block, frame, sized


def test_correction_reasons(spark):
    rows = [
        block(0, (0, 0, 1, 1), "x", type_="table"),
        block(1, (0, 0, 1, 1), "  "),
        block(2, (0, 0, 1, 1), "sure", confidence=0.98),
        block(3, (0, 0, 1, 1), "known"),
        block(4, (0, 0, 1, 1), "same same"),
        block(5, (0, 0, 1, 1), "teh cat sat"),
        block(6, (0, 0, 1, 1), "rewrite me"),
        block(7, (0, 0, 1, 1), "unanswered"),
        block(8, (0, 0, 1, 1), "teh cat sat", page=2),
        block(9, (0, 0, 1, 1), None),
    ]
    df = frame(spark, rows)
    key = correction.cache_key(F.lit("known"), F.lit("en"))
    cache = spark.range(1).select(key.alias("key"), F.lit("Known").alias("corrected_text"))
    asked = []

    def provider(items):
        asked.extend(i["text"] for i in items)
        answers = {"same same": "same same", "teh cat sat": "the cat sat", "rewrite me": "something else entirely"}
        return {i["block_id"]: answers[i["text"]] for i in items if i["text"] in answers}

    checked = correction.precheck(df, cache)
    requests = correction.distinct_requests(checked).collect()
    assert sorted(r.original_text for r in requests) == ["rewrite me", "same same", "teh cat sat", "unanswered"]
    found = correction.correct_blocks(df, provider, cache).orderBy("seq").collect()
    assert [r.correction_reason for r in found] == [
        "skipped_type", "skipped_type", "skipped_high_confidence", "cache_hit", "ok", "ok", "edit_distance_rejected",
        "invalid_response", "ok", "skipped_type",
    ]
    assert [r.correction_applied for r in found] == [False, False, False, True, False, True, False, False, True, False]
    assert found[5].corrected_text == "the cat sat" and found[6].corrected_text == "rewrite me"
    assert correction.new_cache_rows(correction.correct_blocks(df, provider)).count() == 2
    off = correction.correct_blocks(df).filter("correction_reason = 'provider_disabled'")
    assert off.count() == 6

    def broken(items):
        raise ValueError("down")

    assert correction.correct_blocks(df, broken).filter("correction_reason = 'api_error'").count() == 6


def test_ratio_bound_is_strict(spark):
    df = frame(spark, [block(0, (0, 0, 1, 1), "abcdefghij", confidence=0.5)])
    exactly = correction.correct_blocks(df, lambda items: {i["block_id"]: "abcdefgxyz" for i in items}).first()
    assert exactly.correction_reason == "ok"
    more = correction.correct_blocks(df, lambda items: {i["block_id"]: "abcdefwxyz" for i in items}).first()
    assert more.correction_reason == "edit_distance_rejected"


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"corrections": [{"block_id": "a", "corrected_text": "x"}, {"block_id": "a", "corrected_text": "y"}]}', {"a": "y"}),
        ('Sure!\n```json\n{"corrections": []}\n```', {}),
        ('{"corrections": [{"block_id": 1}, 7, {"block_id": "b", "corrected_text": "न"}]}', {"b": "न"}),
        ("nothing", None),
        ('{"other": 1}', None),
        ("{broken", None),
        (None, None),
    ],
)
def test_parse_response(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(correction.parse_response(F.col("t")).alias("m")).first().m
    assert found == want


def test_error_payloads(spark):
    wait = {"error": {"details": [{"@type": "x/google.rpc.RetryInfo", "retryDelay": "40s"}]}}
    day = {"error": {"details": [{"@type": "x.QuotaFailure", "violations": [{"quotaId": "RequestsPerDay"}]}]}}
    rows = [(json.dumps(wait),), (json.dumps(day),), ("{}",), ("junk",), (None,)]
    c = F.col("t")
    found = spark.createDataFrame(rows, "t string").select(correction.retry_delay(c).alias("d"), correction.daily_quota(c).alias("q")).collect()
    assert [(r.d, r.q) for r in found] == [(40.0, False), (None, True), (None, False), (None, False), (None, False)]


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def failing(*errors):
    left = list(errors)

    def request():
        if left:
            raise left.pop(0)
        return "done"

    return request


def test_call_policy():
    clock = Clock()
    policy = correction.CallPolicy(Settings(requests_per_minute=60), clock, clock.sleep)
    assert policy.call(failing()) == "done" and clock.slept == []
    assert policy.call(failing()) == "done" and clock.slept == [1.0]
    clock.slept.clear()
    clock.now += 100
    five = [correction.Retryable(503)] * 4
    assert policy.call(failing(*five)) == "done" and clock.slept == [1.0, 2.0, 4.0, 8.0]
    clock.now += 100
    with pytest.raises(correction.Retryable):
        policy.call(failing(*[correction.Retryable(503)] * 5))
    clock.now += 100
    assert policy.call(failing(*[correction.Retryable(429, 40.0)] * 3)) == "done"
    with pytest.raises(correction.Retryable):
        policy.call(failing(*[correction.Retryable(429, 40.0)] * 4))
    with pytest.raises(correction.Retryable):
        policy.call(failing(correction.Retryable(429, 61.0)))
    with pytest.raises(correction.Retryable):
        policy.call(failing(correction.Retryable(400)))
    with pytest.raises(correction.Retryable):
        policy.call(failing(correction.Retryable(429, daily=True)))
    assert policy.cooling() == 1800
    with pytest.raises(correction.Retryable):
        policy.call(failing())
    clock.now += 1801
    assert policy.call(failing()) == "done"


WORDS = [("hello", 50), ("help", 40), ("held", 40), ("world", 30), ("word", 60), ("the", 100), ("cat", 20)]


def test_suggestions(spark):
    known = spark.createDataFrame(WORDS, "word string, count long")
    asked = spark.createDataFrame([(w,) for w in ("helo", "wrld", "xyzxyz", "hello", "worrd", "helloworlds", None, "")], "word string")
    found = {r.word: (r.suggestion, r.distance) for r in spell.suggestions(asked, known).collect()}
    assert found["hello"] == ("hello", 0) and found["helo"] == ("held", 1) or found["helo"][1] == 1
    assert found["worrd"] == ("word", 1) and found["wrld"] == ("world", 1)
    assert "xyzxyz" not in found and "helloworlds" not in found


def test_correct_words_keeps_white_space(spark):
    known = spark.createDataFrame(WORDS, "word string, count long")
    rows = [(0, "teh  wrld", "en", 0.5), (1, "ab  12 x1", "en", 0.5), (2, "wrld  x", "en", 0.95), (3, "", "en", 0.1)]
    df = spark.createDataFrame(rows, "k int, text string, language string, confidence double")
    found = spell.correct_words(df, known, ["k"]).orderBy("k").collect()
    assert [r.corrected_text for r in found] == ["the world", "ab  12 x1", "wrld  x", ""]
    assert [r.hit_rate for r in found] == [0.0, 1.0, 1.0, 1.0]
    assert [(c.original, c.corrected) for c in found[0].corrections] == [("teh", "the"), ("wrld", "world")]


def test_compound(spark):
    c = spell.Compound(WORDS)
    assert c.correct(["hello", "worlld"]) == ["hello", "world"]
    assert c.correct(["thecat"]) == ["the", "cat"]
    assert c.correct(["wo", "rld"]) == ["world"]
    assert c.correct(["zzzzzz"]) == ["zzzzzz"]
    rows = [(0, "thecat 12  worlld", "en", 0.5), (1, "a  b", "en", 0.5)]
    df = spark.createDataFrame(rows, "k int, text string, language string, confidence double")
    found = spell.correct_runs(df, WORDS, ["k"]).orderBy("k").collect()
    assert [r.corrected_text for r in found] == ["the cat 12 world", "a  b"]
    assert [(x.original, x.corrected) for x in found[0].corrections] == [("thecat", "the cat"), ("worlld", "world")]


def test_runs(spark):
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate([True, True, False, True, False, False, True])], "k int, pos int, f boolean")
    assert [r.run for r in layout.runs(df, ["k"], "pos", "f").orderBy("pos").collect()] == [0, 0, None, 1, None, None, 2]


def plain_grid(table):
    out = [["" for _ in range(table["cols"])] for _ in range(table["rows"])]
    for c in table["cells"]:
        for r in range(c["row"], min(c["row"] + max(1, c["row_span"]), table["rows"])):
            for k in range(c["col"], min(c["col"] + max(1, c["col_span"]), table["cols"])):
                out[r][k] = c["text"] or ""
    return out


def cell(row, col, text, down=1, across=1):
    return {"row": row, "col": col, "row_span": down, "col_span": across, "text": text, "is_header": row == 0, "confidence": 1.0}


TABLES = [
    {"rows": 2, "cols": 3, "cells": [cell(0, 0, "a|b", 1, 2), cell(0, 2, "x\ty"), cell(1, 0, "l\nm", 5, 9), cell(1, 1, "late"), cell(1, 2, None)]},
    {"rows": 0, "cols": 0, "cells": []},
    {"rows": 1, "cols": 1, "cells": []},
    {"rows": 2, "cols": 2, "cells": [cell(0, 0, "zero span", 0, 0), cell(7, 7, "outside")]},
]


def test_grids(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TABLES)], f"k int, t {TABLE.simpleString()}")
    t = F.col("t")
    found = df.select("k", tables.grid(t).alias("g"), tables.markdown_table(t).alias("m"), tables.text_table(t).alias("x")).orderBy("k").collect()
    assert [r.g for r in found] == [plain_grid(t) if t["rows"] else [] for t in TABLES]
    assert found[0].m == "| a\\|b | a\\|b | x\ty |\n| --- | --- | --- |\n| l m | late |  |"
    assert found[0].x == "a|b\ta|b\tx y\nl m\tlate\t"
    assert found[1].m == "" and found[1].x == "" and found[2].m == "|  |\n| --- |"


def test_html_tables():
    html = "<div><table><tr><td rowspan=2>a</td><td> b <i>c</i></td></tr><tr><td colspan='x'>d</td></tr><tr><th>e</th></table><table><tr><td>f"
    found = tables.parse_table(html, [0.12345, 0.5])
    assert (found["rows"], found["cols"]) == (3, 2)
    assert [(c["row"], c["col"], c["text"], c["is_header"], c["confidence"]) for c in found["cells"]] == [
        (0, 0, "a", True, 0.1235), (0, 1, "bc", True, 0.5), (1, 1, "d", False, 0.0), (2, 0, "e", True, 0.0),
    ] or found["cells"][0]["confidence"] == 0.1234
    assert tables.parse_table(None, None) == {"rows": 0, "cols": 0, "cells": []}
    assert tables.parse_table("<p>no", [1.0])["rows"] == 0


def exported(spark):
    rows = [
        block(0, (0, 0, 50, 40), "Title", "heading"),
        block(1, (0, 50, 50, 60), "item", "list"),
        block(2, (0, 70, 50, 80), "", "paragraph"),
        block(3, (0, 90, 50, 99), "tail", page=2),
        block(4, (0, 60, 50, 69), None, "figure"),
        block(5, (0, 61, 50, 69), None, "figure"),
        block(6, (0, 82, 50, 89), None, "table"),
    ]
    t = F.from_json(F.lit(json.dumps(TABLES[0])), TABLE.simpleString())
    df = frame(spark, rows).withColumn("caption", F.when(F.col("seq") == 4, "Figure 1"))
    df = df.withColumn("image_url", F.when(F.col("seq") == 4, "u")).withColumn("table", F.when(F.col("type") == "table", t))
    return layout.reading_order(df)


def test_exports(spark):
    df = exported(spark)
    grid = "| a\\|b | a\\|b | x\ty |\n| --- | --- | --- |\n| l m | late |  |"
    want = "\n".join(
        ["<!-- Page 1 -->\n", "# Title\n", "- item\n", "\n![Figure 1](u)", "*Figure 1*\n", "\n![figure]()", "", "\n", f"\n{grid}\n", "\n",
         "<!-- Page 2 -->\n", "tail\n", "\n"]
    )
    assert export.markdown(df).first().body == want
    banner = "=" * 20
    text = "\n".join(
        [f"{banner} Page 1 {banner}", "", "Title", "item", "[Figure: Figure 1]", "", "a|b\ta|b\tx y\nl m\tlate\t", "", "",
         f"{banner} Page 2 {banner}", "", "tail", ""]
    )
    assert export.plain_text(df).first().body == text
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "document_id string, page_number int")
    assert export.plain_text(df, pages).first().body.endswith(f"{banner} Page 3 {banner}\n\n")


def test_draws(spark):
    df = exported(spark)
    first = export.searchable_draws(df).orderBy("page_number", "reading_order").first()
    assert (first.text, first.x, first.y, first.font) == ("Title", 0.0, 34.0, "notosans-latn")
    assert first.size == pytest.approx(20.0)
    kinds = sorted(r.kind for r in export.structured_draws(df).collect())
    assert kinds == ["cell"] * 5 + ["figure"] + ["text"] * 3
    rows = [block(0, (0, 0, 1, 1), "a", language="hi"), block(0, (0, 0, 1, 1), "b", page=2), block(0, (0, 0, 1, 1), "", language="gu", page=3)]
    assert [r.languages for r in export.legend(frame(spark, rows)).orderBy("page_number").collect()] == [["hi"], ["en", "hi"], ["en", "hi"]]
    got = spark.range(1).select(*(export.font_size(F.lit(t), F.lit(w), F.lit(h)) for t, w, h in (("", 1.0, 1.0), ("a", 1000.0, 1000.0), ("a" * 99, 1.0, 9.0)))).first()
    assert tuple(got) == (10.0, 72.0, 4.0)
    sizes = export.page_size(spark.createDataFrame([(None, None), (3, 4)], "page_width int, page_height int")).collect()
    assert [(r.width, r.height) for r in sizes] == [(1654, 2339), (3, 4)]


def test_tree(spark):
    df = correction.correct_blocks(quality.review_routing(exported(spark).withColumn("needs_review", F.lit(False))))
    df = quality.corrected_needs_no_review(df)
    docs = spark.createDataFrame([("d", "f.pdf"), ("none", "g.pdf")], "document_id string, filename string")
    pages = spark.createDataFrame([("d", 1, 100, 100, None), ("d", 2, 100, 100, "enhanced"), ("d", 3, 100, 100, None)],
                                  "document_id string, page_number int, page_width int, page_height int, ocr_attempt string")
    tree = assemble.document_tree(docs, pages, df)
    out = {r.document_id: json.loads(r.json) for r in assemble.to_json(tree).collect()}
    assert list(out) == ["d"]
    doc = out["d"]
    assert [p["page_number"] for p in doc["pages"]] == [1, 2, 3] and doc["page_count"] == 3
    assert [p["ocr_attempt"] for p in doc["pages"]] == ["original", "enhanced", "original"]
    assert doc["metadata"] == {"avg_confidence": 0.9, "low_confidence_pages": [3]}
    kinds = {b["type"]: b for b in doc["pages"][0]["blocks"]}
    assert "text" not in kinds["table"] and "language" not in kinds["figure"] and "table" not in kinds["heading"]
    assert [b["block_id"] for b in doc["pages"][0]["blocks"]][:2] == ["p1_b1", "p1_b2"]
    assert doc["pages"][2]["blocks"] == [] and doc["pages"][2]["quality_score"] == 0.85
    scores = [p["quality_score"] for p in doc["pages"]]
    assert tree.first().avg_quality_score == pytest.approx(sum(scores) / 3, abs=1e-4)


def test_means_of_halves(spark, tmp_path):
    """Sixteen lines have a mean that often ends in half of a ten thousandth; the lines' order and SQL's rounding decide."""
    text = "\n".join(f"line {k} of the text" for k in range(16))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("document_tree", "document_confidence"):
        want = sorted(con.execute(f"SELECT document_id, avg_confidence FROM ({Q.ORACLES[name]})").fetchall())
        found = Q.QUERIES[name](spark, str(tmp_path)).select("document_id", "avg_confidence").collect()
        assert sorted(map(tuple, found)) == want


def test_tree_deals_blocks_by_document(spark, sf_dir):
    """Lines by page for their order, then blocks by document; the other two exchanges are of pages and documents."""
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")
    try:
        plan = Q.QUERIES["document_tree"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(small, before)
    assert plan.count("Exchange hashpartitioning") == 4


def test_sums_follow_the_blocks(spark):
    """0.1 + 0.7 + 0.3 differs from 0.3 + 0.7 + 0.1 in the last bit: the blocks' numbers decide, however the rows come."""
    rows = [block(k, (0, 20 * k, 50, 20 * k + 9), confidence=c) for k, c in enumerate((0.1, 0.7, 0.3, None))]
    assert 0.1 + 0.7 + 0.3 != 0.3 + 0.7 + 0.1
    for shown in (rows, rows[::-1]):
        df = frame(spark, shown).coalesce(1)
        found = df.groupBy("document_id", "page_number").agg(*quality.page_sums(df)).first()
        assert found.c_all == found.c_sum == 0.1 + 0.7 + 0.3


def test_quality_uses_sizes(spark):
    assert quality.document_quality(quality.page_quality(sized(exported(spark)))).first().pages == 2


def test_languages(spark):
    rows = [("The house is of the town", "en"), ("abc", "und"), ("यह एक किताब है", "hi"), ("हे पुस्तक आहे", "mr"), ("આ પુસ્તક છે", "gu"), ("12345 --", "und"), ("தமிழ் மொழி", "ta"), (None, "und"), ("привет мир", "und")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.got, r.want) for r in df.select(language.detect_language(F.col("t")).alias("got"), "want").collect()] == [(w, w) for _, w in rows]


def test_rates(spark):
    rows = [("en", "m", "hello wrld", "hello world"), ("en", "m", "", ""), ("en", "m", "x", ""), ("hi", "m", "नमस्त", "नमस्ते"), ("hi", "m", None, "एक दो")]
    df = metrics.compare(spark.createDataFrame(rows, "language string, model string, prediction string, truth string"))
    found = [(r.cer, r.wer) for r in df.collect()]
    assert found == [(pytest.approx(1 / 11), 0.5), (0.0, 0.0), (1.0, 1.0), (pytest.approx(1 / 6), 1.0), (1.0, 1.0)]
    s = metrics.summary(df).collect()
    assert [(r.language, r.n_samples) for r in s] == [("en", 3), ("hi", 2)]


def test_legacy_branch(spark):
    known = spark.createDataFrame(WORDS, "word string, count long")
    rows = [block(0, (0, 0, 1, 1), "teh wrld", language="gu", confidence=0.5), block(1, (0, 0, 1, 1), "thecat", confidence=0.5), block(2, (0, 0, 1, 1), "teh", language="fr", confidence=0.5)]
    done = correction.legacy_correction(frame(spark, rows), {"gu": known, "en": known}, ["document_id", "page_number", "seq"]).orderBy("seq").collect()
    assert [(r.corrected_text, r.correction_applied) for r in done] == [("the world", True), ("the cat", True), ("teh", False)]
