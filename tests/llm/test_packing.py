from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mailward.llm.packing import best_boundaries, op3_packing, pack, pack_texts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_against_all_choices(hist, k):
    ls = sorted(hist)
    got = best_boundaries(np.array(ls), np.array([hist[x] for x in ls]), np.array([x * hist[x] for x in ls]), k)
    padding = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())
    best = min(padding([*c, ls[-1]]) for m in range(min(k, len(ls))) for c in combinations(ls[:-1], m))
    assert len(got) <= k and padding(got) == best


def check_batches(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        batches[r.batch_id].append(r)
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bucket_length <= budget
    return batches


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_packing(spark, sf).collect()
    words = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == words and len(rows) == len(words)
    check_batches(rows, 32_768)
    hist = defaultdict(int)
    for n in words.values():
        hist[n] += 1
    ls = np.array(sorted(hist))
    cs = np.array([hist[x] for x in ls])
    bounds = best_boundaries(ls, cs, ls * cs, 16)
    assert sum(r.padding for r in rows) == sum(min(b for b in bounds if b >= n) - n for n in words.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "w " * 40_000)], "doc_id long, text string")
    rows = pack_texts(docs, 3, 100).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 2, 2, 40_000]
    check_batches(rows, 100)
    assert pack_texts(docs.limit(0)).count() == 0


def test_full_batches(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "10L as n_tokens", "'x' as source")
    rows = pack(docs, "n_tokens", 4, 100).collect()
    assert len(check_batches(rows, 100)) == 100 and {r.source for r in rows} == {"x"}


def test_lengths_in_tokens(spark):
    import corpus_pipeline
    from mailward.llm.wordbpe import codec, vocabulary_path

    texts = {1: "extraordinarily unbreakable words", 2: "日本語" * 500, 3: "Zm9vYmFyYmF6" * 300, 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    want = {d: len(codec(vocabulary_path()).encode(t)) for d, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == want and min(want[2], want[3]) > 300
    check_batches(rows, 32_768)
