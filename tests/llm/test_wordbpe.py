import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailward.llm.wordbpe import WordCodec, codec, decode_ids, encode_texts, token_digests, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


TEXTS = [
    None, "", " \n ", "Hello, World's  end!! I'll 123 4.5", "don't DON'T 'S", "ΑΣ ΟΔΟΣ Σ", "éà ́x", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "x\x1cy\x1fz \x85q r s",
    "İstanbul ǅ ﬁ", "日本語 テキスト 😀👍🏽", "﻿​ zero", "Ünïcödé " * 3000, "a" * 5000, "½ ² Ⅷ ٣", "᠎ mongol",
]


def test_same_as_the_library(library):
    own = codec(vocabulary_path())
    for t in TEXTS:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=40))
def test_any_text(library, text):
    own = codec(vocabulary_path())
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.rendered(text) == (" ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


def test_rows(spark, library):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    for r in token_digests(docs, vocabulary_path()).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = decode_ids(encode_texts(docs, vocabulary_path()), vocabulary_path()).collect()
    assert {r.doc_id: r.text for r in back}[3] == library.decode(library.encode(TEXTS[3], add_special_tokens=False).ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert token_digests(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path()).count() == 0


def test_counts_are_those_of_the_ids():
    own = WordCodec(vocabulary_path(), remembered=20)
    for text in (None, "", "a b  a", "Über <|endoftext|> x " * 30, " ".join(f"w{i} {i}x" for i in range(200)), "q" * 5000):
        assert own.count(text) == own.count(text) == len(own.encode(text))
    assert len(own.lengths) <= 10
