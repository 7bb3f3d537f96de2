"""Manifests: the writer and the check agree, and each change of a fact is seen."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mailward.operators import manifests

def accounts(total, errors):
    return F.struct(F.lit(total).alias("total_rows"), F.lit(total - errors).alias("analyzable_rows"), F.lit(errors).alias("error_rows"))


def fields(**given):
    """Columns of a sound fresh run of nine domains."""
    number, sha, git, none = F.lit, F.lit("a" * 64), F.lit("b" * 40), F.lit(None).cast("string")
    out = {k: sha if v == "sha256" else number(9) for k, v in manifests.V2.items() if v in ("sha256", "count", "positive")} | {
        "manifest_schema_version": number(2), "previous_run_manifest_sha256": none, "input_sqlite_sha256": none, "input_sqlite_size_bytes": F.lit(None).cast("long"), "planned_excluded_count": number(0), "database_pre": accounts(0, 0), "database_post": accounts(9, 2),
        "scanner_git_revision": git, "scanner_git_dirty": F.lit(False), "started_at_utc": F.lit("2026-01-01T00:00:00.5Z"), "finished_at_utc": F.lit("2026-01-01T00:00:01Z"), "run_mode": F.lit("fresh"), "limit": F.lit(None).cast("long"), "shuffle": F.lit(True), "shuffle_seed": number(42),
        "resolver_configuration": F.struct(F.array(F.lit("1.1.1.1")).alias("nameservers"), F.lit(True).alias("rotate"), F.lit(4.5).alias("timeout_seconds"), F.lit(6.0).alias("lifetime_seconds"), F.lit("disabled").alias("cache_policy"), F.lit("2.6").alias("dnspython_version")),
        "planned_input_order": F.lit("seeded_shuffle_then_limit"), "python_version": F.lit("3.13"), "measurement_core_algorithm": F.lit("é\n\"framed\""), "measurement_core_files": F.array(F.lit("a.py")), "measurement_core_transition": none,
        "root_measurement_core_attestation": F.struct(F.lit("run_id").alias("root_identifier_kind"), none.alias("root_identifier"), F.lit(2).alias("manifest_schema_version"), git.alias("scanner_git_revision"), sha.alias("measurement_core_sha256"), F.lit("embedded").alias("attestation_method")),
        "release_eligible": F.lit(True)} | given
    out.pop("run_id", None)
    return out


@pytest.fixture(scope="module")
def text(spark):
    return spark.range(1).select(manifests.document(fields()).alias("t")).first().t


def codes(spark, texts):
    rows = manifests.violations(spark.createDataFrame([(str(k), t) for k, t in texts.items()], "name string, text string")).collect()
    return {r.name: r.codes for r in rows}


def test_writer_and_check_agree(spark, text):
    later = json.loads(text)
    again = {**later, "run_mode": "resume_retry_partial_errors", "previous_run_manifest_sha256": "c" * 64, "input_sqlite_sha256": "c" * 64, "input_sqlite_size_bytes": 5, "database_pre": {"total_rows": 9, "analyzable_rows": 7, "error_rows": 2}, "planned_excluded_count": 7, "attempted_input_normalized_line_count": 2, "rows_written": 2}
    canon = json.dumps({k: v for k, v in again.items() if k != "run_id"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("6.0", "6")
    again["run_id"] = hashlib.sha256(("mail-run-v2\0" + canon).encode()).hexdigest()
    shuffled = dict(reversed(list(later.items())))
    assert set(codes(spark, {1: text, 2: json.dumps(shuffled, indent=2), 3: json.dumps(again, ensure_ascii=False)}).values()) == {""}
    assert later["root_measurement_core_attestation"]["root_identifier"] == later["run_id"]


def test_each_change_is_seen(spark, text):
    found = {
        "identity": text.replace("3.13", "3.14"), "json": text[:-1], "written_equals_attempted,identity": text.replace('"rows_written":9', '"rows_written":8'), "keys": text.replace('"limit":null,', ""), "kind:scanner_git_dirty": text.replace('"scanner_git_dirty":false', '"scanner_git_dirty":0'),
        "version": text.replace('"manifest_schema_version":2,"measurement_core_alg', '"manifest_schema_version":3,"measurement_core_alg'), "kind:manifest_schema_version": text.replace('"manifest_schema_version":2,"measurement_core_alg', '"manifest_schema_version":"2","measurement_core_alg'), "interval,identity": text.replace("00:00:01Z", "00:00:00Z"), "kind:database_post": text.replace('"database_post":{"total_rows":9', '"database_post":{"total_rows":9.5'), "kind:finished_at_utc": text.replace("2026-01-01T00:00:01Z", "2026-13-01T00:00:01Z"),
        "kind:resolver_configuration": text.replace('"rotate":true', '"rotate":null'), "eligible,identity": text.replace('"release_eligible":true', '"release_eligible":false'), "run_order,identity": text.replace('"shuffle_seed":42', '"shuffle_seed":null'), "kind:concurrency": text.replace('"concurrency":9', '"concurrency":0'),
    }
    doubled = {"twice": text.replace('"shuffle":true', '"shuffle":true,"shuffle":true'), "deep": text.replace('"rotate":true', '"rotate":true,"rotate":true'), "list": "[1]", "word": '"x"', "empty": "", "none": None, "number": text.replace(":9,", ":NaN,", 1), "more": text + "{}", "brace": text + "}"}
    got = codes(spark, {**found, **doubled})
    assert {k: got[k] for k in found} == {k: k for k in found} and {got[k] for k in doubled} == {"json"}


def test_first_version(spark):
    first = {k: {"sha256": "a" * 64, "positive": 9, "count": 9, "sha1": "b" * 40, "flag": False, "text": "x", "time": "2026-01-01T00:00:00Z"}.get(v) for k, v in manifests.V1.items()}
    first["resolver_configuration"] = {"nameservers": ["x"], "rotate": True, "timeout_seconds": 4, "lifetime_seconds": 6.5, "cache_policy": "disabled", "dnspython_version": "2"}
    texts = {"": json.dumps(first), "keys": json.dumps({**first, "more": 1}), "kind:limit": json.dumps({**first, "limit": "9"})}
    rows = manifests.violations(spark.createDataFrame([(k, t) for k, t in texts.items()], "name string, text string")).collect()
    assert {r.name: r.codes for r in rows} == {k: k for k in texts} and {r.version for r in rows} == {1}


def test_archive_and_discovery(spark, tmp_path, text):
    folder = f"file://{tmp_path}"
    names = {manifests.archived(spark, t, folder) for t in (text, text + "\n", text)}
    assert names == {hashlib.sha256(t.encode()).hexdigest() for t in (text, text + "\n")}
    assert {r.name for r in manifests.discovered(spark, folder).collect()} == {f"{n}.json" for n in names} and not [p for p in tmp_path.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    (tmp_path / "other.json").write_bytes(b"\xff\xfe")
    assert [r.text for r in manifests.stored_texts(spark, folder).filter("name = 'other.json'").collect()] == [None]
    with pytest.raises(ValueError, match="1 of them"):
        manifests.discovered(spark, folder)
    with pytest.raises(ValueError, match="manifests"):
        manifests.discovered(spark, folder, least=4)


def test_facts_of_a_run(spark):
    def results(rows):
        return spark.createDataFrame(rows, "domain string, error string, query_statuses map<string,string>")

    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "domain string")
    before = results([("a", "", {"MX a": "ok"}), ("b", "mx_query_error", {"MX b": "error"}), ("c", "", {"DS c": "error"})])
    after = results([("a", "", None), ("b", "", {}), ("c", "query_errors: DS c", {"DS c": "error"}), ("d", "", {})])
    assert manifests.run_facts(plan, before, after).first().asDict() == {"planned": 4, "excluded": 1, "attempted": 3, "pre_total": 3, "pre_error": 2, "pre_ok": 1, "post_total": 4, "post_error": 1, "post_ok": 3}
    assert set(manifests.run_facts(plan.limit(0), before.limit(0), after.limit(0)).first()) == {0}


def test_documents_need_all_fields(spark):
    with pytest.raises(ValueError, match="limit"):
        manifests.document({k: v for k, v in fields().items() if k != "limit"})


def test_canonical_is_the_variant_text(spark):
    """The short way gives what the fields one by one give, and is taken for plain documents alone."""
    from pyspark.sql import functions as F

    from mailward.operators import manifests

    texts = ['{"b": 1.50, "run_id": "x", "a": {"z": [1, {"d": null, "c": "\\" \\u0001/"}], "y": 1e3}}', '{"run_id": 1}', '{"run_id": null, "a": 1}', '{"a": 1, "run_id": {"run_id": 2}}', '{"a": {"run_id": 1}, "run_id": 1}', '{"a": {"run_id": 1}}', '{"a": "\\"run_id\\":1,", "run_id": 1}',
             '{"run_id": [1, 2], "s": "run_id"}', '{"run_id": {"x": 1}}', '{"\\ud83d\\ude00": 1, "\\uff5e": 2, "run_id": 3}', '{"\\"q\\"": 1, "a\\\\b": 2, "": 3, "run_id": ","}', '{}', '[1]', '"run_id"', 'null', 'x', None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("v", F.try_parse_json("text"))
    for key in (None, "run_id"):
        found = rows.select(manifests.canonical(F.col("v"), key).alias("a"), manifests._by_fields(F.col("v"), key).alias("b"), "text").collect()
        assert [r.a for r in found] == [r.b for r in found]
    plan = rows.select(manifests.canonical(F.col("v")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan.lower() or "octetlength" in plan.lower()
