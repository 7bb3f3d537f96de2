"""Chain walks and running values against plain loops over small graphs and sequences."""

import random

import pytest
from pyspark.sql import functions as F

from mailward.operators import chains
from mailward.operators.sequences import running


def walked(rows):
    """The definition, one run at a time."""
    by_sha = {}
    for run, sha, _ in rows:
        by_sha.setdefault(sha, []).append(run)
    previous = {run: p for run, _, p in rows}
    parent = {run: by_sha[p][0] if p is not None and len(by_sha.get(p, ())) == 1 else None for run, p in previous.items()}
    out = {}
    for run in parent:
        path = [run]
        while parent[path[-1]] is not None and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        end, children = path[-1], sum(v == run for v in parent.values())
        if parent[end] is None:
            out[run] = (run, "root" if previous[end] is None else "lost", end, len(path) - 1, False, children)
        else:
            at = path.index(parent[end])
            out[run] = (run, "cycle", min(path[at:]), None, at == 0, children)
    return sorted(out.values())


def check(spark, rows):
    got = chains.chain_walk(spark.createDataFrame(rows, "run_id long, manifest_sha string, previous_sha string"))
    assert sorted(map(tuple, got.collect())) == walked(rows)


def test_shapes(spark):
    line = [(i, f"s{i}", f"s{i - 1}" if i else None) for i in range(40)]
    ring = [(100 + i, f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(200, "t", "r3"), (201, "u", "t"), (202, "own", "own")]
    star = [(300 + i, f"x{i}", "s0") for i in range(20)]
    odd = [(400, "dup", None), (401, "dup", None), (402, "v", "dup"), (403, None, None), (404, "w", "nowhere"), (405, "y", "w"), (406, None, "s3")]
    check(spark, line + ring + star + odd)


def test_random_graphs(spark):
    rng = random.Random(4)
    for n in (1, 2, 33):
        check(spark, [(i, f"s{i}", rng.choice([None, f"s{rng.randrange(n)}", f"s{rng.randrange(n)}", "lost"])) for i in range(n)])


def test_no_runs(spark):
    assert chains.chain_walk(spark.createDataFrame([], "run_id long, manifest_sha string, previous_sha string")).collect() == []


@pytest.mark.parametrize("ranges", [1, 5])
def test_running_values_of_hot_groups(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    table = spark.createDataFrame(rows, "g string, at long, v long").repartition(7)
    v = F.col("v")
    got = {r["at"]: r for r in running(table, "g", ["at"], {"last": v}, {"most": v}, {"total": v}, ranges=ranges).collect()}
    assert len(got) == len(rows)
    for g, i, x in rows:
        earlier = [e[2] for e in rows[:i] if e[0] == g]
        known = [e for e in earlier if e is not None]
        assert (got[i].v, got[i].last, got[i].most, got[i].total) == (x, earlier[-1] if earlier else None, max(known, default=None), sum(known))


def test_sequence_rules(spark):
    base = dict(chain=1, sequence=1, started=10, finished=15, core="old", source_sha="s", source_count=9, pre_total=0, pre_error=0, post_total=9, post_error=4)
    second = base | dict(sequence=2, started=20, finished=25, core="new", pre_total=9, pre_error=4, post_error=3)
    third = second | dict(sequence=3, started=30, finished=35, pre_error=3, post_error=3)
    cases = {
        "": {}, "core_changes_once": {"core": "newer"}, "source_unchanged": {"source_sha": "t"}, "interval_not_empty": {"finished": 30}, "sequence_contiguous": {"sequence": 4}, "accounting_links": {"pre_total": 8}, "errors_never_rise": {"post_error": 4},
        "after_previous,after_all_earlier": {"started": 24}, "sequence_contiguous,order_agrees": {"sequence": 2}, "accounting_links,errors_never_rise": {"pre_error": None}, "interval_not_empty,after_previous,after_all_earlier": {"started": 26, "finished": 26, "_second": {"finished": 29}},
    }
    rows, names = [], list(base)
    for k, (broken, change) in enumerate(cases.items()):
        change = dict(change)
        other = second | change.pop("_second", {})
        rows += [(3 * k + j, *({**r, "chain": k}[c] for c in names)) for j, r in enumerate((base, other, third | change))]
    schema = "run_id long, " + ", ".join(f"{c} {'string' if c in ('core', 'source_sha') else 'long'}" for c in names)
    got = {r.run_id: r.broken for r in chains.sequence_violations(spark.createDataFrame(rows, schema), ranges=3).collect()}
    assert [got[3 * k + 2] for k in range(len(cases))] == list(cases) and all(got[3 * k] == got[3 * k + 1] == "" for k in range(len(cases)))


def test_an_old_overlap_is_seen(spark):
    rows = [(1, 1, 0, 100), (2, 1, 10, 11), (3, 1, 20, 21)]
    runs = spark.createDataFrame(rows, "run_id long, chain long, started long, finished long")
    runs = runs.selectExpr("*", "run_id AS sequence", "'c' AS core", "'s' AS source_sha", "1 AS source_count", "0 AS pre_total", "0 AS pre_error", "0 AS post_total", "0 AS post_error")
    assert [r.broken for r in chains.sequence_violations(runs).orderBy("run_id").collect()] == ["", "after_previous,after_all_earlier", "after_all_earlier"]
    assert [tuple(r) for r in chains.intervals(runs).collect()] == [(1, 3, 0, 100, 0)]


def test_utc_text(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.range(1).select(chains.utc_text(F.lit("2026-08-21 21:05:22.017897").cast("timestamp")).alias("t")).first().t == "2026-08-21T21:05:22.017897Z"


def test_walk_writes_what_moves(spark, monkeypatch):
    """A run is written again only while its walk goes on."""
    counts = []
    kept = chains._kept

    def counted(rows, name):
        found = kept(rows, name)
        counts.append((name, found.count()))
        return found

    monkeypatch.setattr(chains, "_kept", counted)
    rows = [(i, f"s{i}", None if i % 100 else f"s{i - 100}" if i else None) for i in range(800)]
    found = {r.run_id: r.depth for r in chains.chain_walk(spark.createDataFrame(rows, "run_id long, manifest_sha string, previous_sha string")).collect()}
    assert found == {i: 0 if i % 100 else i // 100 for i in range(800)}
    assert [n for name, n in counts if name == "walk"] == [800, 7, 6, 4]
