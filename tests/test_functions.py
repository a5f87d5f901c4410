"""Text and geometry expressions against plain Python."""

from __future__ import annotations

import difflib
import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as X

ODD = ["", "  ", "a\x0bb", "a\x85b", "a b", "a  b", "é", "�x�", "क़", "x\x1fy", "\tz \n", "½²①५", "न‍म"]


def plain_clean(t):
    if not t:
        return t
    t = unicodedata.normalize("NFC", t).replace("�", "")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t)
    return re.sub(r"\s+", " ", t).strip()


def ask(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), max_size=10))
def test_clean_text(spark, texts):
    texts = [t for t in ODD + texts if t.isprintable() or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    found = ask(spark, [(t,) for t in texts], "t string", X.clean_text(F.col("t")))
    assert [f for (f,) in found] == [plain_clean(t) for t in texts]


def test_clean_text_null(spark):
    assert ask(spark, [(None,)], "t string", X.clean_text(F.col("t"))) == [(None,)]


def expected(t, low, high):
    return sum(c.isspace() or c.isdigit() or unicodedata.category(c)[0] == "P" or low <= ord(c) <= high for c in t)


def test_expected_characters(spark):
    rows = [(t, "gu") for t in [*ODD, "ગુજરાતી abc, 12", "₹5+3="]]
    found = ask(spark, rows, "t string, l string", X.expected_characters(F.col("t"), F.col("l")))
    assert [f for (f,) in found] == [expected(t, 0x0A80, 0x0AFF) for t, _ in rows]
    found = ask(spark, [("añb", "es")], "t string, l string", X.expected_characters(F.col("t"), F.col("l")))
    assert found == [(0,)]


def test_tokens_and_checkable(spark):
    rows = [("ab  cd ef\n",), ("",), (" १२३ a1b -- किताब xy",)]
    found = ask(spark, rows, "t string", X.tokens(F.col("t")))
    assert [f for (f,) in found] == [t.split() for (t,) in rows]
    words = ["abc", "a1c", "---", "१२३", "किताब", "xy", "a_b"]
    found = ask(spark, [(w,) for w in words], "w string", X.checkable_token(F.col("w")))
    assert [f for (f,) in found] == [True, False, False, False, True, False, True]


def test_edit_ratio(spark):
    rows = [("", ""), ("", "a"), ("abc", "abc"), ("abc", "abd"), ("नमस्ते", "नमस्त")]
    found = ask(spark, rows, "a string, b string", X.edit_ratio(F.col("a"), F.col("b")))
    want = [0.0 if a == b else 1.0 if not a or not b else X.word_distance(a, b) / max(len(a), len(b)) for a, b in rows]
    assert [f for (f,) in found] == pytest.approx(want)


def test_edit_distance_of_long_texts(spark):
    r = random.Random(1)
    rows = []
    for _ in range(40):
        a = [r.choice("ab\u00e9\u0928") for _ in range(r.choice([5, 260, 300]))]
        b = list(a)
        for _ in range(r.randrange(0, 6)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice([[], ["x"], ["y", "a"]])
        rows.append(("".join(a), "".join(b)))
    rows += [("a" * 300, "a" * 290), ("ab" * 200, "ba" * 200), ("x" * 300, ""), ("", "")]
    found = ask(spark, rows, "a string, b string", X.edit_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b"))
    assert all(x == y for x, y in found)


def test_similarity_keeps_the_junk_rule(spark):
    long = "ab" * 150
    rows = [(long, long[:-1]), ("Hello", " Hello "), (None, "")]
    found = ask(spark, rows, "a string, b string", X.similarity_udf()(F.col("a"), F.col("b")))
    assert found[0][0] == difflib.SequenceMatcher(None, long, long[:-1]).ratio()
    assert [f for (f,) in found[1:]] == [1.0, 1.0]


def test_opcodes():
    assert X.opcodes(["a", "bad", "c"], ["a", "bat", "c"]) == [("bad", "bat", 1)]
    assert X.opcodes(["x"], ["x"]) == []


box = st.tuples(*[st.integers(-5, 20)] * 4)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(box, box), min_size=1, max_size=20))
def test_geometry(spark, pairs):
    schema = "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [tuple(tuple(map(float, x)) for x in p) for p in pairs]
    a, b = F.col("a"), F.col("b")
    found = ask(spark, rows, schema, G.area(a), G.overlap_area(a, b), G.containment(a, b), G.iou(a, b), G.vertical_gap(a, b))

    def size(r):
        return max(0, r[2] - r[0]) * max(0, r[3] - r[1])

    for (x, y), (s, o, c, u, g) in zip(rows, found):
        both = max(0, min(x[2], y[2]) - max(x[0], y[0])) * max(0, min(x[3], y[3]) - max(x[1], y[1]))
        either = size(x) + size(y) - both
        assert (s, o) == (size(x), both)
        assert c == pytest.approx(both / size(x) if size(x) > 0 else 0)
        assert u == pytest.approx(both / either if either > 0 else 0)
        assert g == max(y[1] - x[3], x[1] - y[3], 0)


def test_windows_and_angles(spark):
    b = G.bbox(F.lit(-5), F.lit(3.7), F.lit(50), F.lit(60))
    one = spark.range(1)
    assert tuple(one.select(G.crop_window(b, F.lit(40), F.lit(30), 10).alias("w")).first().w) == (0, 0, 40, 30)
    assert one.select(G.crop_window(G.bbox(F.lit(50), F.lit(0), F.lit(60), F.lit(9)), F.lit(40), F.lit(30))).first()[0] is None
    got = one.select(*(G.upright_angle(F.lit(a)) for a in (-80.0, 80.0, 0.4, -10.0, 45.0))).first()
    assert tuple(got) == (10.0, -10.0, 0.0, -10.0, 45.0)
    assert one.select(G.raster_zoom(F.lit(595.0), F.lit(842.0))).first()[0] == pytest.approx(2200 / 842)
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3.0, 1.0), (1.0, 4.0), (2.0, 2.0))))
    assert tuple(one.select(G.polygon_bbox(points).alias("b")).first().b) == (1.0, 1.0, 3.0, 4.0)
