import sqlite3

import pytest
from pyspark.sql import functions as F

from mailward import schema
from mailward.functions import privacy
from mailward.operators import leaves, metrics, quality, store
from mailward.sources import files

BASE = {"scanned_at": "2026-01-01 00:00:00", "dmarc_pct": "100", "dmarc_adkim": "r", "dmarc_aspf": "r", "domain_exists": "1", "spf_lookup_count": "0", "query_statuses": "{}", "dmarc_policy": "absent"}


def flat(**given):
    row = {c: "0" if c in schema.FLAGS else "[]" if c in schema.NESTED else "" for c in schema.ALL} | BASE | given
    return tuple(row[c] for c in schema.ALL)


ROWS = [
    flat(domain="c1", has_mx="1", mx_provider="google_workspace", has_spf="1", spf_all_mechanism="hardfail", has_legacy_spf_rrtype="1", has_dkim="1", dkim_testing_mode="1", dkim_weak_key="1", has_dmarc="1", dmarc_policy="reject", dmarc_pct="50", dmarc_adkim="s",
         has_ds_record="1", ns_hosts='["n"]', mx_unresolvable="1", has_bimi="1", has_mta_sts="1", has_tlsrpt="1", has_caa="1", has_tlsa_record="1"),
    flat(domain="c2", has_mx="1", mx_provider="hostpoint", has_spf="1", spf_all_mechanism="softfail", has_dmarc="1", dmarc_policy="none", ns_hosts='["n"]'),
    flat(domain="c3", has_mx="1", mx_provider="other"),
    flat(domain="c4", has_mx="1", mx_provider="unknown", has_spf="1", spf_all_mechanism="neutral", has_dmarc="1"),
    flat(domain="c5", has_mx="1", mx_provider="self_hosted", has_spf="1", spf_all_mechanism="pass", has_dmarc="1", dmarc_policy="unsupported", dmarc_aspf="s"),
    flat(domain="c6", has_spf="1", spf_all_mechanism="hardfail", has_dmarc="1", dmarc_policy="quarantine", has_ds_record="1"),
    flat(domain="c7", domain_exists="0"),
    flat(domain="c8", has_mx="1", mx_provider="microsoft365", has_dmarc="1", dmarc_policy="reject", query_statuses='{"MX c8": "error"}', error="mx_query_error"),
]


def stored(spark, rows=ROWS):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schema.ALL))


def test_golden_counts(spark):
    rows = schema.typed(quality.refused(stored(spark)))
    found = metrics.counted(rows)
    n = {r.metric_id: r for r in found.collect()}
    expected = {"population.total": 8, "population.analyzable": 7, "population.error": 1, "mx.present": 5, "mx.absent": 2, "mx.provider.google_workspace": 1, "mx.provider.unknown": 1, "spf.no_terminal_mechanism": 0, "spf.no_mx_present": 1, "dmarc.genuine_no_record": 1,
                "dmarc.missing_policy": 1, "dmarc.unsupported_policy": 1, "dmarc.no_supported_effective_policy": 3, "dmarc.no_detected_enforcement": 4, "dmarc.strict_alignment": 2, "ns.answer_present": 2, "tlsa.record_present": 1, "mx.unresolvable": 1}
    assert {k: n[k].numerator for k in expected} == expected
    assert n["mx.present"].percent == "71.43" and n["dkim.weak_key_heuristic"].denominator == 1 and n["dmarc.partial_pct"].denominator == 5
    assert len(quality.accepted(found)) == 68
    assert {r.metric_id: r.numerator for r in metrics.recounted(rows).collect()} == {k: r.numerator for k, r in n.items()}
    old = metrics.counted(schema.canonical(schema.legacy(rows)))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, found.collect()))
    lines = {(r.section, r.label): (r.n, r.percent) for r in metrics.report(rows).collect()}
    assert lines["population", "errored"] == (1, 12.5) and lines["population", "mx present"] == (5, 71.4) and lines["dmarc", "absent or monitoring only"] == (3, 60.0)


@pytest.mark.parametrize("change,rule", [
    ({"query_statuses": '{"MX c": "error"}'}, "error_status"), ({"error": "query_errors: x"}, "error_status"), ({"has_spf": "2"}, "flags"), ({"dmarc_pct": None}, "pct"), ({"dmarc_pct": "all"}, "pct"), ({"dmarc_adkim": None}, "texts"), ({"mx_provider": None}, "provider"),
    ({"query_statuses": "x"}, "statuses"), ({"query_statuses": "[]"}, "statuses"), ({"query_statuses": '{"MX c": "lost"}'}, "status_values"), ({"has_mx": "1", "mx_provider": "nobody"}, "provider"), ({"ns_hosts": "[1]"}, "lists"), ({"ns_hosts": "{}"}, "lists"), ({"domain": ""}, "texts"),
    ({"spf_lookup_count": "-1"}, "lookups"), ({"has_spf": "1", "spf_all_mechanism": "maybe"}, "spf_terminal"), ({"dmarc_sp": None}, "dmarc_null"), ({"error": None}, "error_null"),
])
def test_refuses(spark, change, rule):
    rows = stored(spark, [*ROWS, flat(**{"domain": "bad"} | change)])
    assert rule in {r.rule for r in quality.broken_rows(rows).collect()}
    with pytest.raises(ValueError, match=rule):
        quality.refused(rows)


def test_lists_of_text(spark):
    sound = ['["a, null, b"]', "[]", '["]", "null", "[", "\\"", ","]', ' [ "x" ] ', '["é", ""]']
    broken = ["[null]", '["a", null]', "[1]", '["a", 1]', '[["a"]]', '[{"a": 1}]', "{}", '"a"', "null", "", None, "[", '["a"] ["b"]', '["a"]]', '["a"],["b"]', '["a",]']
    rows = spark.createDataFrame([flat(domain=f"d{i}", ns_hosts=t) for i, t in enumerate(sound + broken)], ", ".join(f"{c} string" for c in schema.ALL))
    got = {r.domain for r in quality.broken_rows(rows).filter("rule = 'lists'").collect()}
    assert got == {f"d{i + len(sound)}" for i in range(len(broken))}


def test_crash_rows_and_layouts(spark):
    assert quality.refused(stored(spark, [flat(domain="x", error="scan_exception: oops")])).count() == 1
    with pytest.raises(ValueError, match="unknown schema"):
        quality.violations(stored(spark).drop("error"))
    with pytest.raises(ValueError):
        quality.counts_only(stored(spark).select("domain"))


def test_metric_checks(spark):
    good = metrics.counted(schema.typed(stored(spark)))
    bad = good.withColumn("percent", F.when(F.col("metric_id") == "mx.absent", "0.01").otherwise(F.col("percent")))
    with pytest.raises(ValueError, match="mx.absent"):
        quality.accepted(bad)
    with pytest.raises(ValueError):
        metrics.exact_percentage(2, 1)
    assert metrics.rounded(metrics.exact_percentage(1190194, 1700148), 2) == "70.01" and metrics.localised("70.01") == "70,01"
    big = spark.range(1).select(metrics.display(F.lit(2**62 - 1), F.lit(2**62)).alias("a"), metrics.display(F.lit(1), F.lit(8)).alias("b"), metrics.sixteen_places(F.lit(5), F.lit(7)).alias("c")).first()
    assert (big.a, big.b, big.c) == ("100.00", "12.50", "71.4285714285714286")
    missing = metrics.missing_labels(spark, metrics.labels(spark, {"de": {"mx.present": "x"}}))
    assert missing.filter("locale = 'de'").count() == 67 and missing.filter("locale = 'fr'").count() == 68
    # Counts of an earlier run, and what must add up in them.
    frozen = {"dmarc.genuine_no_record": 976814, "dmarc.missing_policy": 308, "dmarc.unsupported_policy": 180, "dmarc.none": 219990, "dmarc.no_supported_effective_policy": 977302, "dmarc.no_detected_enforcement": 1197292, "dmarc.reject": 227927, "dmarc.quarantine": 283399, "dmarc.detected": 731804}
    for k in ("dmarc_policy", "no_supported", "no_enforcement"):
        left, right = metrics.IDENTITIES[k]
        assert sum(frozen[m] for m in left) == sum(frozen[m] for m in right)


def test_sqlite_and_parquet(spark, tmp_path):
    path = str(tmp_path / "r.db")
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {files.TABLE} ({', '.join(schema.ALL)})")
        db.executemany(f"INSERT INTO {files.TABLE} VALUES ({', '.join('?' * 45)})", ROWS)
    rows = files.sqlite_results(spark, path)
    assert sorted(map(tuple, rows.collect())) == sorted(ROWS)
    out = str(tmp_path / "p")
    files.guarded_write(schema.typed(rows), out)
    again = spark.read.parquet(out)
    assert sorted(map(tuple, schema.stored(again).collect())) == sorted(r for r in ROWS) or again.count() == 8
    spark.range(1).write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError):
        files.guarded_write(schema.typed(rows), str(tmp_path / "q"))
    assert files.checksums(spark, out).count() >= 1


def test_lists_and_plans(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a.ch\n\n b.ch. \n  \nc.ch\n")
    plan = files.domain_list(spark, str(tmp_path / "a.txt"))
    assert sorted(map(tuple, plan.collect())) == [(1, "a.ch"), (2, "b.ch"), (3, "c.ch")]
    import hashlib

    assert files.ordered_digest(plan) == (hashlib.sha256(b"a.ch\nb.ch\nc.ch\n").hexdigest(), 3)
    many = spark.range(1, 101).select(F.col("id").alias("pos"), F.concat(F.lit("d"), "id").alias("domain"))
    import random

    expected = [f"d{i}" for i in range(1, 101)]
    random.Random(42).shuffle(expected)
    mixed = store.shuffled(store.unique_plan(many), limit=10)
    assert [r.domain for r in mixed.orderBy("pos").collect()] == expected[:10]
    assert store.same_plan(many, many) and not store.same_plan(many, store.shuffled(many))
    with pytest.raises(ValueError):
        store.unique_plan(many.unionByName(many))
    with pytest.raises(ValueError):
        files.strict_json(b'{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        files.strict_json(b'{"a": NaN}')


@pytest.mark.parametrize("text,codes", [
    ("plain", set()), ("V%3Dspf1 x", {"dns_payload"}), ("see %2Fetc%2Fpasswd", {"posix_path"}), ("http://0x7f.1/x", {"url_ip"}), ("at 2130706433 now", {"decimal_ip"}), ("010.1.1.1", {"ip"}), ("at 2001:db8::1 x", {"ip"}), ("mail a&#46;example&period;ch", {"name"}),
    ("f" * 40, {"digest"}), ("f" * 41, set()), ("C:\\temp\\x", {"windows_path"}), ("bücher.example", {"name"}), ("0x7f000001", {"encoded_ip"}),
])
def test_privacy(spark, text, codes):
    got = spark.createDataFrame([(text,)], "t string").select(privacy.violation_codes(F.col("t")).alias("c")).first().c
    assert codes <= set(got) and (codes or not got)


def test_names_and_leaves(spark):
    got = spark.createDataFrame([("Bücher.example and x.y.ch, 1.2",)], "t string").select(privacy.names(F.col("t")).alias("n")).first().n
    assert got == ["xn--bcher-kva.example", "x.y.ch"]
    rows = spark.createDataFrame([(1, '{"a": [{"b": 1}, true, null], "c": "x"}')], "id long, t string")
    assert sorted((".".join(r.path), r.leaf) for r in leaves.json_leaves(rows, "id", "t").collect()) == [("a.*.b", "1"), ("c", "x")]
    odd = spark.createDataFrame([("0x7f.1",), ("127.0.0.1",)], "h string").select(privacy.odd_ipv4(F.col("h")).alias("o")).collect()
    assert [r.o for r in odd] == [True, False]


def test_path_patterns(spark):
    rows = spark.createDataFrame([(["a", "*", "b"],), (["a", "x", "b"],), (["a", "b"],)], "path array<string>")
    assert [r.path for r in leaves.forbidden(rows, [["a", "*", "b"]]).collect()] == [["a", "b"]]
