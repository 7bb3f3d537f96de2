import random
import re

import numpy as np

from mailward.llm.components import components, merged
from mailward.llm.ngram_join import BUCKET_BITS, keep_one_each, near_components, prefix_keys


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    w = min(width, len(words))
    return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1))


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return sorted((d, len(sets[i]), best[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, groups, copies, size):
    rng, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(60)]
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        base[:40] = common[:40]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(100)}"
            rows.append(" ".join(t))
    rows += ["", "  ", None, "one", "ONE", "one two", "é one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = corpus(1, 12, 60, 70) + [(5000 + i, t) for i, t in corpus(2, 4, 40, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x")
    for width, percent in ((3, 90), (5, 80)):
        got = sorted(tuple(r) for r in near_components(docs, width, percent).collect())
        assert got == brute(rows, width, percent)


def test_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text, "a"), (1, text + " more", "b"), (2, "alone it is", "c"), (None, None, None), (4, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert near_components(docs.limit(0)).count() == 0


def test_near_copies_beside_unrelated_rows_of_their_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "a"), (None, text + " more", "b"), (None, "quite another text without an id", "c"), (None, "", "d"), (None, None, "e"), (9, text + " end", "f"), (9, "a text of its own", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.sha for r in kept.collect()) == ["a", "c", "d", "e", "g"]


def test_every_link_has_a_key():
    """Pairs that link share a key that the smaller set needs as such, over all classes of frequency and small sizes."""
    met = 0
    for seed in range(3):
        rng, py = np.random.default_rng(seed), random.Random(seed)
        for _ in range(700):
            known = [0, 0, 6, 8, 9, 11, 12, 15] if py.random() < 0.7 else [6, 9, 12, 15]
            levels = np.repeat(rng.choice(np.array(known, np.uint8), 1 << 8), (1 << BUCKET_BITS) >> 8)
            percent, n = py.choice([40, 50, 60, 70, 80, 90, 95]), py.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 40, 100, 400])
            base = rng.integers(0, 1 << 63, n + 40, dtype=np.uint64) * np.uint64(2)
            a = set(base[:n].tolist())
            b = set(a)
            for _ in range(py.randrange(0, max(2, int(n * (100 - percent) / 100 * 1.3) + 1))):
                if b and py.random() < 0.5:
                    b.discard(py.choice(sorted(b)))
                else:
                    b.add(int(base[n + py.randrange(40)]))
            if not b or a == b or 100 * len(a & b) < percent * len(a | b):
                continue
            small, large = sorted((a, b), key=len)
            (k, needed), (other, _) = (prefix_keys(np.array(sorted(x), np.uint64), levels, percent) for x in (small, large))
            assert set(k[needed].tolist()) & set(other.tolist())
            met += 1
    assert met > 800


def test_components_beyond_one_task(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    few, many = ({tuple(r) for r in components(frame, n).collect()} for n in (1 << 18, 0))
    assert few == many and {(1100, 1000), (1000, 1000)} <= few
    more = spark.createDataFrame([(1000, 5000), (7000, 7001), (299, 1050)], "a long, b long")
    assert {tuple(r) for r in merged(components(frame), more).collect()} == {tuple(r) for r in components(frame.unionByName(more)).collect()}
    assert components(frame.limit(0)).count() == 0


def test_short_texts_of_one_passage_and_long_texts(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(24)]
    rows = [" ".join([*passage, *(f"o{rng.randrange(50)}" for _ in range(rng.randrange(6)))]) for _ in range(150)]
    long = [f"l{i}" for i in range(2500)]
    rows += [" ".join(long[k * 40 :] + [f"z{k}"]) for k in range(6)] + ["same words " * 400, "same words " * 401, "x" * 100_000]
    docs = list(enumerate(rows))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_components(frame, 3, 90).collect()) == brute(docs, 3, 90)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, 1), (5, text + " more", 2), (5, "something else altogether", 3), (None, "no id here at all", 4), (None, "no id here too but other", 5), (None, text + " end", 6), (7, text, 7), (7, text, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha int")
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns and sorted(r.sha for r in kept.collect()) == [1, 3, 4, 5]


def test_gathered_once_a_cell(spark):
    """A node that shares hundreds of keys with others has one row a cell, in later rounds too, and no pair of labels is lost."""
    from mailward.llm.ngram_join import gathered

    rows = [(k, n, n) for k in range(200) for n in (1, 2, 3)] + [(900, 3, 3), (900, 4, 4), (901, 5, 5), (901, 6, 5)]
    placed = gathered(spark.createDataFrame(rows, "key long, node long, label long"))
    assert sorted(map(tuple, placed.collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (3, 3, 3), (3, 4, 4)]
    again = gathered(placed.withColumnRenamed("cell", "key"))
    assert again.count() == 5
