"""A training-corpus pipeline over ``documents``: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents.  All but the last return the columns of ``documents``, whatever others they have;
an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import jaccard, langid, packing, toxicity
from pagewright.llm.common import write_table


#: Fixed value: the score from which on a language counts as identified.  Of the texts below it, 3 of 7 on check_l and
#: 5 of 10 on check_h have the language of their label, of those above it 99.3 % and 98.2 %.
IDENTIFIED = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, so that the scores decide.

    Texts that could as well be in another language go, and so do null texts and texts without a letter; repeated
    rows stay.
    """
    return langid.keep_identified(docs, langid.fit(docs), IDENTIFIED)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject; null and empty texts are clean, repeated rows stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows that repeat that id with its text stay, and so do rows without an id and texts without words.
    """
    return jaccard.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; a null text is the end token alone, each repeated row is packed."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("toxicity", clean), ("jaccard_join", one_of_each), ("best_fit_packing", packed)]

#: SQL can express neither the models nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spark.read.parquet(write_table(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
