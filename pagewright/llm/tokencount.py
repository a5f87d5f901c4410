"""Token counts: pieces counted once for each distinct pre-token, joined to document frequencies."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame

from .common import map_rows, prepare, text_of
from .pretokens import PreTokens
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _counter(path: str) -> PreTokens:
    return PreTokens(path, len)


def count_batch(texts: list[str], counter: PreTokens) -> list[int]:
    """Tokens of each text.

    The distinct pre-tokens of the block are counted once, and every document's pre-token
    frequencies are joined to those counts and summed; no list of ids is built.
    """
    frequencies = [Counter(counter.split(t)) for t in texts]
    pieces = counter.values(set().union(*frequencies)) if frequencies else {}
    return [sum(n * pieces[w] for w, n in f.items()) for f in frequencies]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """One row for each document: ``doc_id, n_bytes, n_tokens, over_limit``.

    The join of frequencies with piece counts is done inside each task, on blocks of documents.  A
    join over the whole corpus would shuffle a row for each (document, distinct pre-token), which
    measures at several times the input; the block join shuffles nothing and keeps at most a bounded
    table of counts in each worker.

    Null text counts as empty (0 bytes, 0 tokens).  Special strings inside a text count as the
    library's default does, one token each.  Repeated rows and null ids are kept row by row; other
    columns of ``docs`` are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    def make():
        counter = _counter(path)

        def work(batch):
            texts = batch["text"]
            n = count_batch(texts, counter)
            return {
                "doc_id": batch["doc_id"],
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            }

        return work

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows=256)
