"""Periodic runs against a search of every period and place, and the query against SQL."""

import hashlib
import random

import numpy as np
import pytest

from mailward.llm import periodic_runs
from mailward.llm.periodic_runs import find_runs, periodic_runs as searched, repeated_words, summaries


def brute(words):
    found = {}
    for p in range(1, max(1, len(words) // 4) + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b, p) for (a, b), p in found.items())


def laid(texts):
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.array([w for t in texts for w in t], np.int64), np.cumsum(lengths) - lengths, lengths


def some_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 5)):
        text = [rng.randint(0, rng.choice((1, 2, 4, 30))) for _ in range(rng.randint(0, 70))]
        if text and rng.random() < 0.5:
            a, p = rng.randrange(len(text)), rng.randint(1, 9)
            text = [text[i if i < a else a + (i - a) % p] for i in range(len(text))]
        texts.append(text)
    return texts


def test_every_run():
    rng = random.Random(5)
    for _ in range(400):
        texts = some_texts(rng)
        ids, first, lengths = laid(texts)
        want = [[a + int(at), b + int(at), p] for at, t in zip(first, texts, strict=True) for a, b, p in brute(t)]
        assert sorted(find_runs(ids, first, lengths).tolist()) == sorted(want)


def test_pieces_and_wrong_hashes(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    whole = periodic_runs._scattered
    monkeypatch.setattr(periodic_runs, "_scattered", lambda ids, attempt: whole(ids % 2 if attempt < 2 else ids, attempt))
    for _ in range(60):
        texts = some_texts(rng)
        ids, first, lengths = laid(texts)
        want = [[a + int(at), b + int(at), p] for at, t in zip(first, texts, strict=True) for a, b, p in brute(t)]
        assert sorted(find_runs(ids, first, lengths).tolist()) == sorted(want)


def test_thue_morse_and_one_word():
    word = [0]
    while len(word) < 1 << 13:
        word += [1 - x for x in word]
    assert find_runs(*laid([word])).tolist() == brute(word[:64]) == []
    assert find_runs(*laid([[7] * 50_000, [1, 2] * 3, [1, 2] * 4, [1] * 5])).tolist() == [[0, 50_000, 1], [50_006, 50_014, 2]]


def test_summary_by_definition():
    rng = random.Random(7)
    for doc_id in [*range(60), -3, None]:
        text = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + rng.choice(("", " \t", "\v é"))
        words = repeated_words(doc_id, text.encode().split())
        runs = sorted(((a, b - a, p) for a, b, p in brute(words)), key=lambda r: (r[0], r[2]))
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        inside = {i for a, n, p in runs for i in range(a + p, a + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in inside)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        want = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        assert summaries([(doc_id, text.encode())]) == [want]


def test_odd_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    long = "a b c " * 400_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "no no no no no no", "x"), (4, "one word", "x"), (4, "one word", "x"), (6, long, "x")]
    got = {}
    for r in searched(spark.createDataFrame(rows, "doc_id long, text string, start string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0].collapsed_sha256 == hashlib.sha256("one word".encode()).hexdigest()
    for k in (1, 2, 3):
        assert tuple(got[k][0]) == (k, 0, None, None, None, None, empty, empty)
    assert tuple(got[None][0])[1:6] == (1, 0, 6, 1, 6000) and got[None][0].collapsed_sha256 == hashlib.sha256(b"no").hexdigest()
    assert tuple(got[6][0])[1:5] == (1, 0, 1_200_000, 3)
    assert searched(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("h", [0])
def test_repeated_words(h):
    import zlib

    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == h]
    assert ids
    for i in ids:
        words = [str(k).encode() for k in range(37)]
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 37
        p = 1 + (37 - a) // (3 + g % 8)
        assert repeated_words(i, words) == [words[k if k < a else a + (k - a) % p] for k in range(37)]
