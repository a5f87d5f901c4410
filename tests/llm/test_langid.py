import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES = [("en", "the house and the garden are here with the people of this town"), ("de", "das haus und der garten sind hier mit den leuten dieser stadt"), ("fr", "la maison et le jardin sont ici avec les gens de cette ville")] * 3


@pytest.fixture(scope="module")
def model():
    return langid.fit_texts(SAMPLES, PATH)


def every_segmentation(word, model):
    vocabulary = langid.lattice(PATH)
    index = {p: i for i, p in enumerate(vocabulary.pieces)}
    text = langid.MARK + word
    total = np.zeros(len(model.languages))
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        if all(p in index or len(p) == 1 for p in parts):
            total += np.prod([model.probability[index.get(p, len(vocabulary.pieces))] for p in parts], axis=0)
    return np.log(total)


@pytest.mark.parametrize("word", ["house", "häuserx", "a", "ciónñ", "中文", "garten"])
def test_forward_sums_all_segmentations(word, model):
    assert langid.word_scores([word], langid.lattice(PATH), model.probability)[0] == pytest.approx(every_segmentation(word, model))


def test_long_words_and_batches_agree(model):
    words = ["house", "abcdefg" * 6, "x" * 41, "stadt" * 200]
    vocabulary = langid.lattice(PATH)
    together = langid.word_scores(words, vocabulary, model.probability)
    for w, row in zip(words, together):
        assert row == pytest.approx(langid._long_word(w, vocabulary, model.probability))
    assert np.isfinite(together).all()


def test_expected_counts_are_probabilities(model):
    assert model.probability.sum(axis=0) == pytest.approx(np.ones(3))
    assert (model.probability > 0).all()


def test_identify(odd, none, model):
    rows = {r.doc_id: r for r in langid.identify(odd.filter("doc_id < 20"), model).collect()}
    assert rows[0].lang_pred == "en" and 0 <= rows[0].score <= 1
    assert rows[2].lang_pred == rows[8].lang_pred == "und" and rows[2].score == 0.0
    assert langid.identify(odd, model).count() == odd.count()
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit_texts([], PATH)).collect()} == {"und"}


def test_ties_go_to_the_first_language():
    both = langid.fit_texts([("b", "same words"), ("a", "same words")], PATH)
    scorer = langid._Scorer(both)
    total = scorer.totals(["same words"])[0]
    assert total[0] == total[1] and both.languages[int(total.argmax())] == "a"


def test_the_table_is_bounded_and_changes_nothing(model):
    texts = [" ".join(f"{a}{b}" for b in "abcdefghij") for a in "klmnopqrst"]
    small, large = langid._Scorer(model, keep=7), langid._Scorer(model)
    for x, y in zip(small.totals(texts), large.totals(texts)):
        assert x == pytest.approx(y)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter(F.pmod(langid.id_crc(), F.lit(4)) == 2)
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()


def test_the_sample_does_not_read_the_held_out_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(langid.id_crc(), F.lit(4)) == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert np.array_equal(langid.fit(docs).probability, langid.fit(other).probability)
    assert "xx" not in langid.fit(other).languages


def test_keep(odd, model):
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert all(t and any(c.isalpha() for c in t) for t in texts) and len(texts) == sum(
        bool(r.text) and any(c.isalpha() for c in r.text) for r in odd.collect()
    )


def test_scores_do_not_overflow(model):
    scorer = langid._Scorer(model)
    total = scorer.totals(["house " * 20000])[0]
    assert math.isfinite(total.max())


#: Runs of 35 and 40 letters that are no pieces: Lao, and mathematical bold.
RUNS = [pytest.param("ກຂຄງຈ" * 7, id="lao"), pytest.param("\U0001d41a" * 40, id="bold")]


@pytest.mark.parametrize("run", RUNS)
def test_runs_of_unknown_letters_do_not_underflow(run, model):
    vocabulary = langid.lattice(PATH)
    row = langid.word_scores(["house", run, "garten"], vocabulary, model.probability)[1]
    assert np.isfinite(row).all() and row == pytest.approx(langid._long_word(run, vocabulary, model.probability))


@pytest.mark.parametrize("run", RUNS)
def test_the_fit_counts_runs_of_unknown_letters(run):
    fitted = langid.fit_texts([(lang, f"{text} {run}") for lang, text in SAMPLES], PATH)
    assert np.isfinite(fitted.probability).all() and fitted.probability.sum(axis=0) == pytest.approx(np.ones(3))
    # Every segmentation of the run uses each of its letters once; the mark before it is a piece.
    use = langid._expected([run], np.full((1, 3), 2.0), langid.lattice(PATH), fitted.probability)
    assert use[-1] == pytest.approx(np.full(3, 2.0 * len(run))) and use.sum(axis=0) == pytest.approx(np.full(3, 2.0 * (len(run) + 1)))


@pytest.mark.parametrize("run", RUNS)
def test_a_run_of_unknown_letters_leaves_the_document(run, spark, model):
    docs = spark.createDataFrame([(1, f"the house and the garden {run} are here with the people of this town")], "doc_id long, text string")
    row = langid.identify(docs, model).first()
    assert row.lang_pred == "en" and 0.5 < row.score <= 1
    assert langid.keep_identified(docs, model).count() == 1


@pytest.mark.parametrize("letter", ["ກ", "\U0001d41a", "中"])
def test_words_of_unseen_letters_of_every_length(letter, model):
    vocabulary = langid.lattice(PATH)
    words = [letter * n for n in range(1, 61)]
    scores = langid.word_scores(words, vocabulary, model.probability)
    assert np.isfinite(scores).all()
    for n, row in enumerate(scores, 1):
        assert row == pytest.approx(langid._long_word(letter * n, vocabulary, model.probability))
    for n in range(1, 9):
        assert scores[n - 1] == pytest.approx(every_segmentation(letter * n, model))


def test_unseen_words_of_every_length_inside_texts(spark, model):
    texts = [f"the house and the garden {'ກ' * n} are here with the people" for n in range(1, 61)] + ["中" * n for n in range(1, 61)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = langid.identify(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "en" and r.score > 0.5 for r in rows if r.doc_id < 60)
    assert langid.keep_identified(docs, model).count() == len(texts)


def test_long_words_are_fitted(model):
    word = "donaudampfschifffahrtsgesellschaftskapitänsmütze"
    assert len(word) > langid.TOGETHER
    fitted = langid.fit_texts([("de", word), ("en", "ship")], PATH)
    vocabulary = langid.lattice(PATH)
    use = langid._expected([word], np.array([[3.0, 0.0]]), vocabulary, fitted.probability)
    lengths = np.array([len(p) for p in vocabulary.pieces] + [1])
    assert use[:, 0] @ lengths == pytest.approx(3.0 * (len(word) + 1)) and not use[:, 1].any()


def test_verdicts_like_brute_force(spark, model):
    texts = ["house garten", "la maison", "das haus", "x y", "ville town"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(docs, model).collect():
        total = sum(every_segmentation(w, model) for w in texts[r.doc_id].split())
        assert r.lang_pred == model.languages[int(total.argmax())]
        assert r.score == pytest.approx(np.exp(total.max()) / np.exp(total).sum())
