import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mailward.llm.exact_dedup import copy_groups, drop_copies
from mailward.llm.quotient import CountingQuotientFilter


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 40), st.just(2**64 - 1)), max_size=300), st.integers(0, 6))
def test_filter_is_a_lossless_multiset(values, bits):
    half = len(values) // 2
    parts = [CountingQuotientFilter.build(np.array(v, np.uint64)) for v in (values[:half], values[half:])]
    ranges = defaultdict(list)
    for p in parts:
        for prefix, piece in p.split(bits):
            ranges[prefix].append(CountingQuotientFilter.from_bytes(piece.to_bytes()))
    found = {}
    for filters in ranges.values():
        got, counts = CountingQuotientFilter.merge(filters).items()
        assert list(got) == sorted(map(int, got))
        found |= dict(zip(map(int, got), map(int, counts), strict=True))
    assert found == {v: values.count(v) for v in values}


def test_large_counts_survive():
    f = CountingQuotientFilter.build(np.array([5, 9], np.uint64), np.array([254, 10**12], np.uint64))
    g = CountingQuotientFilter.from_bytes(f.to_bytes())
    assert (g.count(5), g.count(9), g.count(6)) == (254, 10**12, 0)


ROWS = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (2, None), (7, ""), (8, " \t\n\x0b\x0c\r"), (1, "unique"), (4, "a b"),
    (6, "x" * 50_000), (11, "x" * 50_000), (12, "rep"), (12, "rep"), (13, "é x"), (14, "éx"), (None, "ab"),
]


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d if d is not None else 2**63, d))
    out, seen = [], set()
    for d, t in rows:
        g = groups[norm(t)]
        keep = min(g)[2]
        first = (d, norm(t)) not in seen
        seen.add((d, norm(t)))
        out.append((d, keep, len(g), d == keep and first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in ROWS], "doc_id long, text string, fp int, kept int").repartition(3)
    got = sorted((tuple(r) for r in copy_groups(docs).collect()), key=str)
    assert got == brute(ROWS)


def test_drop_copies_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t in ROWS], "doc_id long, text string, sha string")
    got = drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(9, "a  b"), (8, " \t\n\x0b\x0c\r"), (1, "unique"), (4, "a b"), (6, "x" * 50_000), (12, "rep"), (13, "é x")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert copy_groups(docs).count() == 0 and drop_copies(docs).count() == 0


NULL_IDS = [
    (None, "all null"), (None, "all  null"), (None, "all null"), (1, "long est"), (None, "long  est"), (None, "lone"),
    (2**63 - 1, "top"), (None, "top"), (7, "same id"), (7, "same  id"), (-(2**63), "low"), (5, "low"),
]


def test_null_ids_keep_one_of_each_group(spark):
    docs = spark.createDataFrame(NULL_IDS, "doc_id long, text string").repartition(3)
    rows = copy_groups(docs).collect()
    keep = {r.text_sha256: r.keep_id for r in rows}
    assert [keep[hashlib.sha256(t.encode()).hexdigest()] for t in ("allnull", "longest", "lone", "top", "sameid", "low")] == [None, None, None, 2**63 - 1, 7, -(2**63)]
    assert sum(r.kept for r in rows) == len(keep) == 6
    got = sorted(((r.doc_id, r.text) for r in drop_copies(docs).collect()), key=str)
    assert got == sorted([(None, "all  null"), (None, "long  est"), (None, "lone"), (2**63 - 1, "top"), (7, "same  id"), (-(2**63), "low")], key=str)
