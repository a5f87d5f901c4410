from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import langid, toxicity
from pagewright.llm import queries as Q

from .test_jaccard import brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    scorer = langid._Scorer(model)
    kept = [i for i, t in sorted(rows.items()) if scorer.totals([t or ""])[0] is not None]
    staged = docs.filter(F.col("doc_id").isin(kept))
    matcher = toxicity.Matcher(toxicity.fit(staged, labels))
    kept = [i for i in kept if matcher.score(toxicity.folded_words(rows[i] or "")) < 0.5]
    parts = brute([rows[i] for i in kept])[1]
    kept = [i for k, i in enumerate(kept) if parts[k] == k]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(rows[i] or "", add_special_tokens=False).ids) + 1 for i in kept}

    found = corpus_pipeline.run(spark, sf_dir).collect()
    total, sequences = defaultdict(int), defaultdict(int)
    for r in found:
        total[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert dict(total) == sizes
    assert max(sequences.values()) <= 1024
    assert len(sequences) <= -(-sum(sizes.values()) // 1024) * 1.05 + 1


def test_stages_keep_the_columns(spark, odd, sf_dir):
    docs = odd.withColumn("source", F.lit("s"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_on_odd_rows(spark, sf_dir):
    """Null texts and texts without a letter go; of copies the smallest id stays; repeated rows and rows without an id stay."""
    text = "the same words of one document that has quite a few of them"
    rows = [(7, text, "a"), (3, text.upper(), "b"), (3, text.upper(), "b"), (None, "a text that has no id at all", "c"), (9, None, "d"), (8, "", "e"), (6, "123 !", "f")]
    rows += [(5, "one other text stands alone in here " * 2000, "g"), (4, "ກຂຄງຈ" * 8 + " and words around the run", "h")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, piece string, lang string").repartition(3)
    language, toxicity_, near = (f for _, f in corpus_pipeline.STAGES[:3])
    named = language(spark, docs, sf_dir)
    assert sorted(r.piece for r in named.collect()) == ["a", "b", "b", "c", "g", "h"]
    assert sorted(r.piece for r in toxicity_(spark, named, sf_dir).collect()) == ["a", "b", "b", "c", "g", "h"]
    left = near(spark, named, sf_dir)
    assert left.columns == docs.columns and sorted(r.piece for r in left.collect()) == ["b", "b", "c", "g", "h"]
    packed = corpus_pipeline.STAGES[3][1](spark, left, sf_dir).collect()
    assert sorted({str(r.doc_id) for r in packed}) == ["3", "4", "5", "None"] and sum(r.doc_id == 3 for r in packed) == 2


def test_language_stage_goes_by_the_scores(spark, sf_dir):
    """A text that is as likely in one language as in another is not identified, however many letters it has."""
    learned = [("en", "the house of the town and the garden"), ("fr", "la maison de la ville et le jardin")]
    rows = [(k, text, lang) for k, (lang, text) in enumerate(learned * 20)]
    rows += [(100, "information", None), (101, "the the la la information", None), (102, "the town of the garden", None), (103, "la ville et la maison", None), (104, "1 2 3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    scores = {r.doc_id: r.score for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert 0.5 <= scores[100] < 0.9 and 100 not in kept
    assert kept == {i for i, score in scores.items() if score >= corpus_pipeline.IDENTIFIED}
    assert {102, 103} <= kept and {k for k in range(40)} <= kept and 104 not in kept


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered_queries(spark, sf_dir, duck):
    names = list(Q.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    for name, sql in Q.oracle_sql().items():
        duck(Q.queries()[name](spark, sf_dir), sql)


def test_every_query_gives_a_row_for_each_row(spark, sf_dir):
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    table = {4: "pages", 9: "pages", 6: "embeddings"}
    for name, f in Q.queries().items():
        n = int(name[2:].split("_")[0])
        if n != 1:
            assert f(spark, sf_dir).count() == counts[table.get(n, "documents")], name
