"""Toxicity: exact neighbours against brute force, counts by definition, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mailward.llm import toxicity as tox
from mailward.llm.toxicity import BlockMaxIndex, isotonic, tied_terms, toxicity, vocabulary_counts, words_of

SF = "/root/testdata/sf0.01"


def some_vectors(rng, n, terms):
    out = []
    for _ in range(n):
        own = np.array(sorted(rng.sample(range(terms), min(terms, rng.randint(1, 6)))))
        w = np.array([rng.choice((1.0, 1.0, 2.0, rng.random() + 0.01)) for _ in own])
        out.append((own, w / math.sqrt(float((w * w).sum()))))
    return out


@pytest.mark.parametrize(("seed", "n", "terms", "block"), [(1, 0, 5, 4), (2, 3, 8, 32), (3, 300, 12, 8), (4, 500, 60, 32), (5, 200, 6, 1)])
def test_nearest_are_exact_with_ties(seed, n, terms, block):
    rng = random.Random(seed)
    vectors = some_vectors(rng, n, terms)
    index = BlockMaxIndex(vectors, terms, block)
    for t, w in some_vectors(rng, 40, terms):
        all_ = []
        for place, (t2, w2) in enumerate(vectors):
            other = dict(zip(t2.tolist(), w2.tolist(), strict=True))
            cosine = sum(a * other.get(k, 0.0) for k, a in zip(t.tolist(), w.tolist(), strict=True))
            if cosine > 0:
                all_.append((-round(cosine, 12), place))
        all_.sort()
        want = [x for x in all_ if x[0] <= all_[9][0]] if len(all_) > 10 else all_
        places, cosines = index.nearest(t, w, 10)
        assert [(-round(c, 12), p) for p, c in zip(places.tolist(), cosines.tolist(), strict=True)] == want


def test_isotonic():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y, w = rng.integers(0, 12, 40) / 4, rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.1
        got = np.interp(x, *isotonic(x, y, w))
        # The minimax formula of the least-squares rising step function.
        points = np.unique(x)
        for a in points:
            low = [min(np.average(y[(x >= b) & (x <= c)], weights=w[(x >= b) & (x <= c)]) for c in points if c >= a) for b in points if b <= a]
            assert abs(float(got[x == a][0]) - max(low)) < 1e-9


def test_words_are_never_cut(monkeypatch):
    text = "Alpha, Béta-gamma 12 d3lta " * 50
    whole = [w for part in words_of(text) for w in part]
    monkeypatch.setattr(tox, "PIECE", 7)
    assert [w for part in words_of(text) for w in part] == whole == re.findall(r"[^\W\d_]+", text.lower())


def test_counts():
    numbers = {"": 0, "idiot ": 1, "lowe": 2}
    assert vocabulary_counts("Idiot! Lowei loweiä idiots x", numbers, {}) == {0: 2, 1: 1, 2: 2}
    assert vocabulary_counts("", numbers, {}) == {}


def test_terms_of_a_family():
    texts = [Counter({"foulx ": 1, "foul": 1, "foulx": 1, "the ": 1})] * 30 + [Counter({"fouly ": 1, "foul": 1, "fouly": 1, "the ": 1})] * 30 + [Counter({"the ": 1})] * 200
    assert tied_terms(texts, [1] * 60 + [0] * 200, 100) == ["foul"]
    assert tied_terms(texts, [0] * 260, 100) == []


def test_op12(spark):
    rows = tox.op12_toxicity(spark, SF).collect()
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    hits = Counter()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert len(r.evidence) <= tox.SHOWN
        for e in r.evidence:
            assert labels[e.doc_id] == e.toxic and zlib.crc32(str(e.doc_id).encode()) % 4 != 2 and 0 < e.cosine <= 1 + 1e-9
        if r.held_out and r.doc_id in labels:
            hits[labels[r.doc_id], r.predicted] += 1
    assert hits[0, 1] <= 0.02 * hits[0, 0] and hits[1, 1] >= 0.6 * (hits[1, 0] + hits[1, 1])


def made(spark, toxic=True):
    rng = random.Random(2)
    words = [f"{a}{b}{c}en" for a in "bdfgklmn" for b in "aeiou" for c in "rst"]
    docs = [(i, " ".join(rng.choices(words, k=40)) + (" vermin filth" if toxic and i % 5 == 0 else "")) for i in range(400)]
    labels = [(i, int(toxic and i % 5 == 0), 1) for i in range(400)]
    return docs, labels


def test_odd_rows(spark):
    docs, labels = made(spark)
    extra = [(1000, None), (1001, ""), (1002, "vermin filth "), (1002, "vermin filth "), (None, "you vermin filth"), (1003, "baren " * 400_000 + "vermin filth"), (1004, "1 2 3")]
    odd = [(1, None, 1), (None, 1, 1), (77777, 1, 1), (0, 0, 0)]
    table = spark.createDataFrame([(*d, 1.0, "x") for d in docs + extra], "doc_id long, text string, score double, terms string")
    got = {}
    for r in toxicity(table, spark.createDataFrame(labels + odd, "doc_id long, toxic int, quality int")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs) + len(extra)
    blank = got[1000][0].score
    assert got[1001][0].score == blank == got[1004][0].score < 0.05 and got[1001][0].evidence == []
    assert len(got[1002]) == 2 and got[1002][0] == got[1002][1] and got[1002][0].score > 0.9 and got[None][0].score > 0.9
    assert all(got[i][0].score > 0.9 if i % 5 == 0 else got[i][0].score < 0.05 for i, _ in docs)


@pytest.mark.parametrize(("toxic", "want"), [(None, 0.0), (0, 0.0), (1, 1.0)])
def test_one_label_or_none(spark, toxic, want):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([] if toxic is None else [(i, toxic) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, labels).collect()} == {want}


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []
