"""Operators on blocks against row-wise Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import blocks, layout, quality, routing, spatial
from pagewright.operators.blocks import PAGE

SCHEMA = (
    "document_id string, page_number int, seq int, type string, text string, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, language string"
)


def block(seq, box, text="text", type_="paragraph", confidence=0.9, language="en", page=1, doc="d"):
    return (doc, page, seq, type_, text, tuple(map(float, box)) if box else None, confidence, language)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_parse_lines(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 40.0), (0.0, 40.0)]
    raw = spark.createDataFrame(
        [("d", 1, [" Title ", "", "x", "cut"], [0.9, 0.8, 0.7], [square, square, [], square]), ("e", 1, None, [0.1], [square])],
        "document_id string, page_number int, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<struct<x:double,y:double>>>",
    )
    found = blocks.parse_lines(raw).collect()
    assert [(r.seq, r.text, r.type, tuple(r.bbox)) for r in found] == [(0, "Title", "heading", (0.0, 0.0, 10.0, 40.0))]


def test_fallback_lines(spark):
    raw = spark.createDataFrame(
        [("d", 1, 0, "a", None, [0.0, 0.0, 9.0, 9.0]), ("d", 1, 1, "b", 0.5, None), ("d", 1, 2, "  ", 0.5, [0.0, 0.0, 1.0, 1.0])],
        "document_id string, page_number int, seq int, text string, confidence double, bbox array<double>",
    )
    found = blocks.parse_fallback_lines(raw).collect()
    assert [(r.seq, r.confidence) for r in found] == [(0, 0.0)]


def test_block_type_bounds(spark):
    rows = [block(0, (0, 0, 9, 30), "one two three four five six seven eight"), block(1, (0, 0, 9, 29.9)), block(2, (0, 0, 9, 99), "1 2 3 4 5 6 7 8 9")]
    found = frame(spark, rows).select("seq", blocks.block_type(F.col("text"), F.col("bbox")).alias("t")).orderBy("seq").collect()
    assert [r.t for r in found] == ["heading", "paragraph", "paragraph"]


def test_suppress(spark):
    rows = [
        block(0, (0, 0, 10, 10)),  # 60 % inside
        block(1, (0, 0, 10, 10.1), page=2),  # no structure on its page
        block(2, (0, 4, 100, 100), type_="table"),
        block(3, None),
        block(4, (5, 5, 5, 5)),  # no area
        block(5, (0, 0, 10, 9.9)),  # less than 60 %
        block(6, (10, 10, 20, 20), type_="figure"),
    ]
    assert seqs(spatial.suppress_inside(frame(spark, rows))) == [1, 2, 3, 4, 5, 6]
    assert seqs(spatial.suppress_inside(frame(spark, rows[:2]))) == [0, 1]


def test_merge_duplicates(spark):
    rows = [
        block(0, (0, 0, 10, 10), "some words", confidence=0.5),
        block(1, (0, 0, 10, 9), "some word", confidence=0.9),
        block(2, (0, 0, 10, 8), "some words", confidence=0.9),
        block(3, (0, 0, 10, 10), "some words", type_="heading"),
        block(4, (0, 0, 10, 10), "other text here"),
        block(5, (0, 0, 10, 10), "some words", type_="table"),
        block(6, None, "some words"),
        block(7, (0, 0, 10, 10), "some words", page=2),
    ]
    assert seqs(spatial.merge_duplicates(frame(spark, rows))) == [1, 3, 4, 5, 6, 7]


def test_captions(spark):
    regions = frame(spark, [block(0, (0, 0, 50, 50), type_="figure"), block(1, (200, 0, 250, 50), type_="figure")])
    texts = [
        block(0, (0, 60, 50, 70), "Figure 1: near"),
        block(1, (0, 60, 50, 70), " FIG. 2 last of equals "),
        block(2, (50, 55, 90, 60), "figures are nice"),
        block(3, (200, 131, 250, 140), "Table 3 too far"),
        block(4, (60, 51, 90, 60), "Table 4 beside"),
    ]
    found = spatial.with_captions(regions, frame(spark, texts)).orderBy("seq").collect()
    assert [r.caption for r in found] == ["FIG. 2 last of equals", None]


def greedy(primary, second, least=0.3):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        size = [(c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)]
        return both / (sum(size) - both) if both else 0.0

    used, out = set(), []
    for f in second:
        best, score = None, 0.0
        for i, p in enumerate(primary):
            if i not in used and iou(f[5], p[5]) > score:
                best, score = i, iou(f[5], p[5])
        if best is not None and score >= least:
            used.add(best)
            out.append((primary[best][4], "primary") if primary[best][6] > f[6] else (f[4], "fallback"))
        else:
            out.append((f[4], "fallback"))
    return out + [(p[4], "primary") for i, p in enumerate(primary) if i not in used]


@pytest.mark.parametrize("seed", range(3))
def test_merge_engines(spark, seed):
    r = random.Random(seed)

    def some(mark, pages):
        out = []
        for page in pages:
            for i in range(r.randrange(1, 12)):
                x, y = r.randrange(8) * 5, r.randrange(8) * 5
                out.append(block(i, (x, y, x + 12, y + 10), f"{mark}{i}", confidence=r.choice([0.5, 0.7, 0.9]), page=page))
        return out

    a, b = some("p", [1, 2, 3]), some("f", [2, 3, 4])
    found = spatial.merge_engines(frame(spark, a), frame(spark, b)).orderBy("page_number", "seq").collect()
    for page in (1, 2, 3, 4):
        own = [(x.text, x.engine_used) for x in found if x.page_number == page]
        assert own == greedy([x for x in a if x[1] == page], [x for x in b if x[1] == page])


def plain_order(rows):
    columns = []
    for b in sorted(rows, key=lambda b: (b[5][0], b[2])):
        x0, _, x1, _ = b[5]
        for c in columns:
            width = min(x1 - x0, c["x1"] - c["x0"])
            if width > 0 and (min(x1, c["x1"]) - max(x0, c["x0"])) / width >= 0.5:
                c["items"].append(b)
                c["x0"], c["x1"] = min(c["x0"], x0), max(c["x1"], x1)
                break
        else:
            columns.append({"x0": x0, "x1": x1, "items": [b]})
    columns.sort(key=lambda c: c["x0"])
    return [b[2] for c in columns for b in sorted(c["items"], key=lambda b: b[5][1])]


@pytest.mark.parametrize("seed", range(4))
def test_reading_order(spark, seed):
    r = random.Random(seed)
    rows = []
    for page in range(1, 9):
        for i in range(r.randrange(1, 25)):
            x, y = r.randrange(0, 600, 7), r.randrange(0, 900, 11)
            rows.append(block(i, (x, y, x + r.choice([0, 5, 80, 250]), y + 10), page=page))
    found = layout.reading_order(frame(spark, rows)).orderBy("page_number", "reading_order").collect()
    for page in range(1, 9):
        assert [x.seq for x in found if x.page_number == page] == plain_order([b for b in rows if b[1] == page])
    assert found[0].block_id == "p1_b1"


def test_two_orders_differ_on_columns(spark):
    rows = [block(0, (0, 0, 100, 10)), block(1, (0, 50, 100, 60)), block(2, (200, 20, 300, 30))]
    df = frame(spark, rows)
    read = [r.seq for r in layout.reading_order(df).orderBy("reading_order").collect()]
    page = [r.seq for r in layout.page_order(df).orderBy("place").collect()]
    assert (read, page) == ([0, 1, 2], [0, 2, 1])


def test_best_attempt(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.99), ("b", 0, 0.9), ("b", 1, 0.95), ("b", 2, 0.99), ("c", 0, 0.5), ("c", 1, 0.5), ("c", 2, 0.4)]
    df = spark.createDataFrame(rows, "k string, attempt int, confidence double")
    found = layout.best_attempt(df, ["k"], 0.85).orderBy("k").collect()
    assert [(r.k, r.attempt, r.tried) for r in found] == [("a", 1, 2), ("b", 1, 2), ("c", 0, 3)]


def sized(df):
    return df.withColumn("page_width", F.lit(100)).withColumn("page_height", F.lit(100))


def test_quality_of_a_page_without_text(spark):
    found = quality.page_quality(sized(frame(spark, [block(0, (0, 0, 100, 50), type_="figure")]))).first()
    assert found.quality_score == pytest.approx(0.85 + 0.15 * 0.5)


def test_quality_components(spark):
    rows = [block(0, (0, 0, 10, 10), "abc", confidence=0.5), block(1, (0, 0, 10, 10), "ñ1", confidence=1.0, language=None), block(2, (0, 0, 200, 200), "", language="hi")]
    df = sized(frame(spark, rows)).withColumn("correction_applied", F.col("seq") == 0)
    q = quality.page_quality(df).first()
    assert (q.confidence, q.text_quality, q.character_quality, q.coverage) == (pytest.approx(2.4 / 3), 0.5, 0.8, 1.0)
    assert q.language_consistency == pytest.approx(1 / 3)


def test_review(spark):
    rows = [block(0, (0, 0, 1, 1), confidence=c, type_=t) for c, t in ((0.9, "paragraph"), (0.75, "list"), (0.7499, "list"), (0.95, "figure"), (0.5, "figure"))]
    df = frame(spark, rows).withColumn("needs_review", F.when(F.col("confidence") < 0.9, False))
    found = [(r.review_status, r.needs_review) for r in quality.review_routing(df).orderBy(F.col("confidence").desc()).collect()]
    assert found == [("accepted", True), ("accepted", False), ("flagged", False), ("needs_review", True), ("needs_review", True)]


def test_low_pages(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "document_id string, page_number int")
    rows = [block(0, (0, 0, 1, 1), confidence=0.8), block(0, (0, 0, 1, 1), confidence=0.79, page=2)]
    assert quality.low_confidence_pages(pages, frame(spark, rows)).first().low_confidence_pages == [2, 3]
    assert quality.document_confidence(frame(spark, rows)).first().avg_confidence == 0.795


def test_scripts(spark):
    rows = [
        block(0, (0, 0, 1, 1), "hello नमस्ते ગુજરાત"),
        block(0, (0, 0, 1, 1), "hello привет 123", page=2),
        block(0, (0, 0, 1, 1), "123 ...", page=3),
        block(0, (0, 0, 1, 1), "a" * 95 + "пппп", page=4),
    ]
    found = routing.script_mix(frame(spark, rows)).orderBy("page_number").collect()
    assert [r.mixed_script for r in found] == [False, True, False, False]
    assert found[2].families == []


def test_routes(spark):
    rows = [(1, 0.85, 0.7, False, False), (2, 0.84, 0.9, False, False), (3, 0.84, 0.6, True, False), (4, 0.99, 0.9, False, True)]
    df = spark.createDataFrame(rows, "page_number int, avg_confidence double, quality_score double, has_table boolean, mixed_script boolean")
    found = routing.route(df).orderBy("page_number").collect()
    assert [r.route for r in found] == ["accept", "retry", "fallback", "fallback"]
    assert found[2].reasons == ["low_confidence(0.840<0.85)", "low_quality_score(0.600<0.7)", "table_detected"]


def test_process_pages(spark):
    good, poor = [block(0, (0, 0, 90, 90), "good text", confidence=0.95)], [block(0, (0, 0, 90, 90), "poor text", confidence=0.4, page=2)]
    mixed = [block(0, (0, 0, 90, 90), "mixed текст", confidence=0.95, page=3)]
    primary = sized(frame(spark, good + poor + mixed))

    def variant(pages):
        return primary.join(pages, PAGE, "left_semi").withColumn("confidence", F.lit(0.97))

    def second(pages):
        return primary.join(pages, PAGE, "left_semi").withColumn("confidence", F.lit(0.99))

    found = routing.process_pages(primary, [("enhanced", variant), ("threshold", variant)], second).orderBy("page_number").collect()
    assert [(r.page_number, r.ocr_attempt, r.engine_used) for r in found] == [
        (1, "original", "primary"),
        (2, "enhanced", "primary"),
        (3, "fallback", "fallback"),
    ]


def test_union_and_error_blocks(spark):
    a, b = frame(spark, [block(4, (0, 0, 1, 1), "a"), block(9, (0, 0, 1, 1), "b")]), frame(spark, [block(0, (0, 0, 1, 1), type_="table")])
    found = blocks.union_blocks(a, b.drop("text")).orderBy("seq").collect()
    assert [(r.seq, r.type, r.text) for r in found] == [(0, "paragraph", "a"), (1, "paragraph", "b"), (2, "table", None)]
    bad = blocks.error_block(a.select(*PAGE).distinct()).first()
    assert (bad.engine_used, bad.language, bad.confidence) == ("error", "und", 0.0)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert spatial.suppress_inside(none).count() == 0
    assert spatial.merge_duplicates(none).count() == 0
    assert spatial.merge_engines(none, none).count() == 0
    assert layout.reading_order(none).count() == 0
    assert quality.page_quality(sized(none)).count() == 0


@pytest.mark.parametrize(
    "parts, score",
    [
        ((0.9684, 0.5, 1.0, 0.6618, 1.0), 0.8132),
        ((1.0, 1.0, 1.0, 0.9201, 1.0), 0.9880),
        ((0.9604, 1.0, 0.9979, 0.3555, 0.9565), 0.8848),
    ],
)
def test_weights_give_the_published_scores(parts, score):
    """Components and scores of three pages, published with four decimals."""
    s = quality.Settings()
    weights = (s.weight_confidence, s.weight_text, s.weight_characters, s.weight_coverage, s.weight_language)
    assert sum(w * p for w, p in zip(weights, parts)) == pytest.approx(score, abs=1e-4)


def test_unions_keep_pages_together(spark):
    """Two cached tables dealt by page, united and dealt by page again: a page must reach one call."""
    rows = [block(i, (0, 0, 9, 9), str(i), page=p) for p in range(40) for i in range(3)]
    a = frame(spark, rows).repartition(4, *PAGE).persist()
    b = frame(spark, rows).repartition(4, *PAGE).persist()
    a.count(), b.count()
    merged = spatial.merge_engines(a, b)
    assert merged.count() == 120
    a.unpersist(), b.unpersist()


def test_blank_pages_have_scores(spark):
    pages = sized(spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, page_number int"))
    rows = frame(spark, [block(0, (0, 0, 50, 50), "abc", confidence=0.5)])
    found = {r.page_number: r for r in quality.page_quality(rows, pages=pages).collect()}
    assert found[2].quality_score == pytest.approx(0.85) and found[2].coverage == 0.0
    assert found[1].coverage == 0.25
    mean = quality.document_quality(quality.page_quality(rows, pages=pages)).first()
    assert mean.pages == 2 and mean.quality_score == pytest.approx((found[1].quality_score + 0.85) / 2)
    signals = routing.route(routing.page_signals(rows, pages=pages)).orderBy("page_number").collect()
    assert [(r.avg_confidence, r.route) for r in signals] == [(0.5, "retry"), (0.0, "retry")]


def test_pages_that_recognisers_fail_on(spark):
    pages = sized(spark.createDataFrame([("d", i) for i in range(1, 6)], "document_id string, page_number int"))
    primary = frame(spark, [block(0, (0, 0, 90, 90), "poor text", confidence=0.4, page=i) for i in (1, 2, 3, 4)])

    def variant(asked):
        good = asked.filter("page_number = 1").join(primary, PAGE).withColumn("confidence", F.lit(0.97))
        return good.unionByName(asked.filter("page_number <> 1").withColumn("error", F.lit("broken")), allowMissingColumns=True)

    def raises(asked):
        raise RuntimeError("no model")

    def second(asked):
        some = asked.filter("page_number IN (2, 5)").select(*PAGE)
        found = frame(spark, [block(0, (0, 0, 90, 90), "read", confidence=0.9, page=i) for i in (2, 5)]).join(some, PAGE, "left_semi")
        return found.unionByName(asked.filter("page_number = 3").withColumn("error", F.lit("broken")), allowMissingColumns=True)

    done, attempts = routing.run_pages(primary, [("enhanced", variant), ("threshold", raises)], second, pages=pages)
    got = sorted((r.page_number, r.text, r.engine_used, r.ocr_attempt) for r in done.collect())
    assert got == [
        (1, "poor text", "primary", "enhanced"),  # the variant read it
        (2, "read", "fallback", "fallback"),
        (3, "poor text", "primary", "original"),  # the fallback failed
        (4, "poor text", "primary", "fallback"),  # the fallback found nothing
        (5, "read", "fallback", "fallback"),  # a blank page
    ]
    assert {r.page_number: r.ocr_attempt for r in attempts.collect()} == {1: "enhanced", 2: "fallback", 3: "original", 4: "fallback", 5: "fallback"}
    done, attempts = routing.run_pages(primary, [], raises, pages=pages)
    assert done.count() == 4 and {r.ocr_attempt for r in attempts.collect()} == {"original"}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_pages_are_dealt_once(spark):
    """What belongs to a page comes from one exchange by page."""
    rows = sized(frame(spark, [block(i, (0, 20 * i, 50, 20 * i + 9), page=i % 3) for i in range(9)]))
    assert exchanges(quality.page_quality(rows)) == 1
    assert exchanges(routing.page_signals(rows)) == 1
    assert exchanges(layout.reading_order(rows)) == 1
    assert exchanges(spatial.suppress_inside(rows)) == 1
    assert exchanges(layout.page_order(rows)) == 1
