import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import bpe, tokencount
from pagewright.llm.pretokens import FastIds, PreTokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
texts = st.one_of(st.text(max_size=60), st.text("abcdeinorst '.,12", max_size=60), st.text("Σσς éİ\u0301\x1c\x85\u00a0<|>", max_size=20))


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(WORD)


@pytest.fixture(scope="module")
def fast():
    return FastIds(BYTE)


@pytest.fixture(scope="module")
def counter():
    return PreTokens(BYTE, len, keep=50)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_word_encoder_equals_the_library(own, text):
    ids = own.library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(np.array(ids, "<u4")).decode() == own.library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_byte_ids_and_counts_equal_the_library(fast, counter, text):
    ids = fast.library.encode(text, add_special_tokens=False).ids
    assert fast.ids(text).tolist() == ids
    assert tokencount.count_batch([text], counter) == [len(ids)]


def test_backtracking_on_random_letters(own):
    r = random.Random(5)
    for _ in range(3000):
        word = "".join(r.choices("abcdeinorstlhu", k=r.randrange(1, 30)))
        assert own.encode(word) == own.library.encode(word, add_special_tokens=False).ids


def test_no_alphabet_for_a_symbol():
    table = bpe.MergeTable({"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]})
    assert table.encode("aab") == [0, 2]
    assert table.encode("axb") is None


def test_special_strings(own, fast):
    for text in ("<|endoftext|>", "a<|startoftext|>  b", "<|endoftext|><|endoftext|>", "<|endoftext|"):
        assert own.encode(text) == own.library.encode(text, add_special_tokens=False).ids
        assert fast.ids(text).tolist() == fast.library.encode(text, add_special_tokens=False).ids


def test_documents(spark, odd, own):
    library = Tokenizer.from_file(WORD)
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    encoded = bpe.encode_documents(odd, with_ids=True)
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.collect()), key=key) == sorted(want, key=key)
    again = bpe.decode_documents(encoded)
    assert sorted(r.text for r in again.collect()) == sorted(r.decoded for r in encoded.collect())


def test_token_counts(odd, none):
    library = Tokenizer.from_file(BYTE)
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()
    )
    rows = tokencount.token_counts(odd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert tokencount.token_counts(none).count() == 0
    assert bpe.encode_documents(none).count() == 0
