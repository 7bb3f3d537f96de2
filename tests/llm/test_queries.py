"""Every registered corpus query over a whole small table, against SQL, a library or plain Python."""

import hashlib
import math
import re
import zlib

import pytest

from mailward.llm import langid, licenses, oracle_sql, pii, queries
from mailward.llm.ngram_join import near_components
from mailward.llm.pii import Feistel, pseudonymise, pseudonymise_texts, restored
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_names():
    found = queries()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in found) == list(range(1, 14))
    assert set(oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    twin = db.execute(oracle_sql()[name])
    columns = [c[0] for c in twin.description]
    got = queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, twin.fetchall()))


def test_op1(spark, docs):
    got = queries()["op1_ngram_join"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, 3, 90)
    five = near_components(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(tuple(r) for r in five.collect()) == brute(docs, 5, 80)


def test_op2(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)}
    got: dict[int, list] = {}
    for r in queries()["op2_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [q for q in rows if q % 100 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        best = sorted((math.dist(rows[q], v), i) for i, v in rows.items() if i != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - math.dist(rows[q], rows[i])) < 1e-9 for _, i, s in mine)
        hits += len({i for _, i in best} & {i for _, i, _ in mine})
    assert hits >= 0.95 * 10 * len(asked)


def test_op3(spark, docs):
    rows = queries()["op3_packing"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    batches: dict[str, list] = {}
    for r in rows:
        assert 0 <= r.padding == r.bucket_length - r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or sum(r.bucket_length for r in own) <= 32_768


def test_op5(spark, docs):
    key = b"a key of the tests only"
    spark.conf.set(pii.KEY_SETTING, key.decode())
    try:
        rows = {r.doc_id: r for r in queries()["op5_pii"](spark, SF).collect()}
        found = pseudonymise_texts(spark.read.parquet(f"{SF}/documents.parquet"), spans_as="own").collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    f = Feistel(key)
    for d, text in docs:
        new, spans = pseudonymise(text, f)
        assert (rows[d].text, rows[d].n_replaced) == (new, len(spans))
        assert sum(rows[d][f"n_{k}"] for k in pii.KINDS) == len(spans)
    texts = dict(docs)
    for r in found:
        assert restored(r.text, [(s.kind, s.start, s.end) for s in r.own], f) == texts[r.doc_id]
    with pytest.raises(ValueError):
        pseudonymise_texts(spark.read.parquet(f"{SF}/documents.parquet"), back=True)


def test_op6_and_op10(spark, docs):
    import sys

    sys.path.insert(0, "/opt/tokenizers/..")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    own.no_truncation()
    own.no_padding()
    ids = {d: own.encode(t or "", add_special_tokens=False).ids for d, t in docs}
    rows = queries()["op6_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    at = 0
    for r in sorted(queries()["op10_token_records"](spark, SF).collect(), key=lambda r: r.doc_id):
        mine = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(mine), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in mine)))
        at += len(mine)


def naive_scores(model, text):
    """Class logits by the definition: every run of 2 to 4 folded bytes that no edge cuts inside."""
    fold = {**{b: b for b in range(0x61, 0x7B)}, **{b: b + 32 for b in range(0x41, 0x5B)}, **{b: b for b in range(0x80, 0x100)}}
    raw = [fold.get(b, 0x20) for b in text.encode()]
    total, count = [0.0] * len(model.classes), 0
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            part = raw[i : i + n]
            if 0x20 in part[1 : n - 1] or (n == 2 and part == [0x20, 0x20]):
                continue
            key = n
            for b in part:
                key = (key * 0x01000193 & 0xFFFFFFFF) ^ b
            bucket = (key * 2654435761 & 0xFFFFFFFF) >> 16
            total = [a + float(x) for a, x in zip(total, model.logits[bucket], strict=True)]
            count += 1
    return [a / max(1, count) + b for a, b in zip(total, model.bias, strict=True)]


def test_op7_sums(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for text in ("The cat and the dog", "Über den  Wolken, 12 Mal", "é", "a b c"):
        z = [x * model.temperature for x in naive_scores(model, text)]
        top = max(z)
        p = [math.exp(x - top) for x in z]
        names, scores = model.predict([text])
        assert names == [model.classes[p.index(max(p))]] and abs(scores[0] - max(p) / sum(p)) < 1e-4


def licence_labels(text):
    """Base and template labels by trying every start of every template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def holds(phrase):
        p = phrase.split()
        return any(words[i : i + len(p)] == p for i in range(len(words)))

    places = [(i, k) for k, phrase in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {k for _, k in places}
    for t in licenses.TEMPLATES:
        p = t.passage.split()
        best = max((sum(0 <= i + j < len(words) and words[i + j] == w for j, w in enumerate(p)) for i in range(-len(p), len(words))), default=0)
        if best >= len(p) - t.changed and all(map(holds, t.keys)):
            labels.add(t.label)
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({k for _, k in places})), ",".join(sorted(labels))


def test_op8(spark, docs):
    rows = {r.doc_id: r for r in queries()["op8_licenses"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, text in docs:
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == licence_labels(text)


def test_changed_passages(spark):
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit").passage.split()
    texts = [" ".join(["x", *mit[:i], "changed", *mit[i + 1 :], "y"]) for i in range(len(mit))] + [" ".join(mit), " ".join(mit[::-1]), "Licensed under CC BY-NC 4", "licensed under the GNU General Public License, version 3", " ".join(mit * 300), "software " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    found = licenses.scan(rows, licenses.document_frequencies(rows)).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert r.labels == licence_labels(texts[r.doc_id])[-1]
    # The frequencies decide only the order of look-ups.
    same = licenses.scan(rows, {}).select("doc_id", "labels", "score").collect()
    assert sorted(map(tuple, same)) == sorted((r.doc_id, r.labels, r.score) for r in found)
