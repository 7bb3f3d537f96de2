import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailward.llm.common import shared_dir
from mailward.llm.token_records import _PLAIN, END_ID, LibraryEncoder, frame, read_at, read_record, read_records, write_records
from mailward.llm.wordbpe import vocabulary_path

TEXTS = [(7, "Hello World's end!!"), (3, None), (5, ""), (5, "same id"), (1, "x\x1cy <|endoftext|> ΑΣ"), (40, "word " * 30_000), (2, "日本語 テキスト"), (9, "Hello"), (9, "Hello"), (None, "nobody")]


def test_round_trip_against_the_library(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in TEXTS], "doc_id long, text string, start int")
    folder = f"{shared_dir(spark)}/t-records"
    manifest = write_records(docs, folder, vocabulary_path(), 3)
    got = sorted(map(tuple, read_records(manifest).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(vocabulary_path())
    ids = {(d, t): library.encode(t or "", add_special_tokens=False).ids + [END_ID] for d, t in TEXTS}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((d or -1, len(ids[d, t]), crc(ids[d, t])) for d, t in TEXTS)
    assert [r[0] for r in got] == sorted((d for d, _ in TEXTS), key=lambda d: -1 if d is None else d)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    first = min(manifest.collect())
    doc_id, found = read_at(f"{first.file}.tok", f"{first.file}.idx", first.records - 1)
    assert list(found) in [ids[d, t] for d, t in TEXTS if d == doc_id]


def test_damage_is_seen():
    data = bytearray(frame(1, np.array([5, 70_000], np.uint32)))
    assert list(read_record(io.BytesIO(bytes(data)))[1]) == [5, 70_000]
    for at in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            read_record(io.BytesIO(bytes(bad)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_records(write_records(docs, f"{shared_dir(spark)}/t-none", vocabulary_path())).count() == 0


class Recorded:
    """A tokenizer that notes what it is asked."""

    def __init__(self, own, asked):
        self.own, self.asked = own, asked

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.own.encode_batch_fast(texts, **options)


def test_a_word_is_encoded_once_whatever_stands_around_it():
    encoder, library, asked = LibraryEncoder(vocabulary_path()), Tokenizer.from_file(vocabulary_path()), []
    for name, own in list(vars(encoder).items()):
        if isinstance(own, Tokenizer):
            setattr(encoder, name, Recorded(own, asked))
    for text in ("Hello, hello. HELLO! (hello) hello's $$$hello", "hello; Hello"):
        (ids,) = encoder.encode([text])
        assert list(ids) == library.encode(text, add_special_tokens=False).ids + [END_ID]
    assert " ".join(asked).lower().count("hello") == 1


def test_plain_characters_as_the_library_takes_them():
    encoder, library = LibraryEncoder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    plain = [c for c in map(chr, range(0x11000)) if _PLAIN(c)]
    texts = [t for c in plain for t in (c, f"a{c}", f"{c}b", f"1{c}2", f".{c}'{c}S", f"{c}{c}")]
    got = encoder.encode(texts)
    assert [list(g[:-1]) for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


LETTERS = st.one_of(st.sampled_from("aB'sStTreVE.,!09 \n\0\x1c<|>\u00e9\u00c9\u00df\u0130\u017f\u0301\u00b2\u2019\u2026\u03a3\u0141"), st.characters(min_codepoint=0x20, max_codepoint=0x24F))


@pytest.fixture(scope="module")
def limited():
    """An encoder that soon remembers no more, and the library."""
    return LibraryEncoder(vocabulary_path(), remembered=50), Tokenizer.from_file(vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=30), max_size=4))
def test_any_plain_text(limited, texts):
    encoder, library = limited
    for _ in range(2):
        assert [list(g) for g in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids + [END_ID] for t in texts]
