import pytest
from pyspark.sql import functions as F

from pagewright.llm import toxicity as X

CLEAN = [f"plain words number {w} about gardens and the weather today" for w in "abcdefghijklmnopqrst"]
TOXIC = [f"you {w} idiot are such a fool {w}{w} today" for w in "abcdefghijklmnopqrst"]


@pytest.fixture(scope="module")
def lexicon():
    return X.fit_texts([(t, 0) for t in CLEAN] + [(t, 1) for t in TOXIC])


def test_folding():
    assert X.folded_words("\u0455tupid 1D10T $ilLy \uff26OO\uff2c ce\u0301l\u200bl") == ["stupid", "idiot", "siiiy", "fooi", "ceii"]


def test_entries_are_found_under_disguise(lexicon):
    m = X.Matcher(lexicon)
    assert " idiot " in lexicon.weights
    for text in ("You IDIOT, such a fool", "you 1d10t are a f00l", "y\u043eu \u0456diot fool"):
        assert m.score(X.folded_words(text)) >= 0.5
    for text in ("", "plain words", "idiotic? no: idiots are not this word", "garden " * 500):
        assert m.score(X.folded_words(text)) < 0.5


def brute(words, lexicon):
    import math

    text = f" {' '.join(words)} "
    spared = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(text)) if text.startswith(p, i)]
    s = 0.0
    for e, w in lexicon.weights.items():
        for i in range(len(text)):
            if text.startswith(e, i) and not any(a <= i and i + len(e) <= b for a, b in spared):
                s += w
    return s / math.log2(16 + len(words)) if words else 0.0


def test_matcher_against_plain_search():
    lexicon = X.Lexicon({" bad ": 2.0, " worse": 3.0, " ba": 1.0}, [" not bad ", " bad luck "])
    m = X.Matcher(lexicon)
    for text in ("bad", "not bad", "bad bad luck", "not bad bad", "worsening bade", "worse", "a bad b", ""):
        assert m.total(text.split()) == pytest.approx(brute(text.split(), lexicon))
    assert m.total("so bad luck".split()) < m.total("so bad day".split())


def test_exceptions_are_learned():
    clean = [f"this is idiot proof design number {w} for gardens" for w in "abcde"] + CLEAN * 3
    toxic = TOXIC + [f"idiot {w} of the day {w}" for w in "klmnopqrst"]
    lexicon = X.fit_texts([(t + f" {i}x", 0) for i, t in enumerate(clean)] + [(t, 1) for t in toxic], times=2.0)
    assert " idiot proof " in lexicon.exceptions


def test_near_copies_do_not_fill_the_lexicon():
    copies = [("you idiot rareword otherword thirdword " + "z" * (i + 4), 1) for i in range(20)]
    lexicon = X.fit_texts(copies + [(t, 1) for t in TOXIC] + [(t, 0) for t in CLEAN])
    assert not any("rareword" in e or "otherword" in e for e in lexicon.weights)


def test_one_class_only():
    assert not X.fit_texts([("a", 0)]).weights
    assert X.Matcher(X.fit_texts([])).score(["x"]) < 0.5


def test_documents(odd, none, lexicon):
    rows = X.score(odd, lexicon).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert X.score(none, lexicon).count() == 0
    kept = X.keep_clean(odd, lexicon)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_labels_with_nulls_and_both_classes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN + TOXIC)] + [(None, "x")], "doc_id long, text string")
    rows = [(i, 0, int(i >= 20)) for i in range(40)] + [(0, 1, None), (None, 0, 1), (25, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    lexicon = X.fit(docs, labels, train=F.lit(True))
    assert " idiot " in lexicon.weights
    assert not X.fit(docs, labels.filter("toxic = 0")).weights
    assert not X.fit(docs, labels.filter("1 = 0")).weights


def test_the_held_out_fold_is_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(X.id_crc(), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.fit(docs, labels) == X.fit(docs, turned)
