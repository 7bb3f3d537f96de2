"""Manifest documents of the runs made from orders, some of them tampered with, and what is wrong with each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests
from ..operators.tasks import spread
from .registry import query
from .release_queries import _RUN_CASES, RUNS_SQL

_MODE = "CASE run_mode WHEN 'resume' THEN 'resume_retry_partial_errors' ELSE run_mode END"
_HEX = "0123456789abcdef"


def _int(sql: str) -> str:
    return f"CAST({sql} AS STRING)"


def _quoted(sql: str) -> str:
    return f"""concat('"', {sql}, '"')"""


_SHA_OF = {k: f"concat('{c}', repeat('{_HEX[i]}', 63))" for i, (k, c) in enumerate({"source": "a", "planned": "b", "attempted": "c", "output": "d", "input": "e", "core": "f"}.items())}
_FRESH = "nth = 1"


def _accounts(side: str) -> str:
    return f"""concat('{{"analyzable_rows":', {_int(f'{side}_ok')}, ',"error_rows":', {_int(f'{side}_error')}, ',"total_rows":', {_int(f'{side}_total')}, '}}')"""


# A document's fields as JSON text, by sorted key.
_FIELDS = {
    "attempted_input_normalized_line_count": _int("attempted"), "attempted_input_normalized_sha256": _quoted(_SHA_OF["attempted"]), "batch_pool_size": "'300'", "concurrency": "CASE WHEN run_id % 19 = 0 THEN '0' ELSE '120' END", "database_post": _accounts("post"), "database_pre": _accounts("pre"),
    "finished_at_utc": "CASE WHEN run_id % 59 = 0 THEN '\"2026-08-21T01:00:00Z\"' ELSE '\"2026-08-21T21:10:00.25Z\"' END", "input_sqlite_sha256": f"CASE WHEN {_FRESH} THEN 'null' ELSE {_quoted(_SHA_OF['input'])} END", "input_sqlite_size_bytes": f"CASE WHEN {_FRESH} THEN 'null' ELSE '4096' END", "limit": "coalesce(CAST(limit_rows AS STRING), 'null')",
    "manifest_schema_version": "'2'", "measurement_core_algorithm": "'\"framed\"'", "measurement_core_files": "'[\"a.py\",\"b.py\"]'", "measurement_core_sha256": _quoted(_SHA_OF["core"]), "measurement_core_transition": "'null'", "output_sqlite_sha256": _quoted(_SHA_OF["output"]), "output_sqlite_size_bytes": "'8192'",
    "planned_excluded_count": _int("excluded"), "planned_input_normalized_line_count": _int("planned"), "planned_input_normalized_sha256": _quoted(_SHA_OF["planned"]), "planned_input_order": "CASE WHEN run_id % 31 = 0 THEN '\"source_order_then_limit\"' ELSE '\"seeded_shuffle_then_limit\"' END",
    "previous_run_manifest_sha256": f"CASE WHEN {_FRESH} OR run_id % 23 = 0 THEN 'null' ELSE {_quoted(_SHA_OF['input'])} END", "python_version": "'\"3.13.1\"'", "release_eligible": "CASE WHEN run_id % 5 = 0 THEN 'false' ELSE 'true' END",
    "resolver_configuration": """'{"cache_policy":"disabled","dnspython_version":"2.6.1","lifetime_seconds":6,"nameservers":["1.1.1.1","8.8.8.8"],"rotate":true,"timeout_seconds":4}'""",
    "root_measurement_core_attestation": f"""concat('{{"attestation_method":"embedded","manifest_schema_version":2,"measurement_core_sha256":"', {_SHA_OF["core"]}, '","root_identifier":', CASE WHEN {_FRESH} THEN 'null' ELSE {_quoted(_SHA_OF["source"])} END, ',"root_identifier_kind":"run_id","scanner_git_revision":"', repeat('1', 40), '"}}')""",
    "rows_written": _int("written"), "run_mode": _quoted(_MODE), "scanner_git_dirty": "CASE WHEN dirty THEN 'true' ELSE 'false' END", "scanner_git_revision": "concat('\"', repeat('1', 40), '\"')", "shuffle": "'true'", "shuffle_seed": "'42'",
    "source_input_normalized_line_count": _int("source_count"), "source_input_normalized_sha256": _quoted(_SHA_OF["source"]), "started_at_utc": "'\"2026-08-21T21:05:22.017897Z\"'",
}
_BODY = "concat('{', " + ", ',', ".join(f"""'"{k}":', {v}""" for k, v in sorted(_FIELDS.items())) + ", '}')"


def _documents_sql(sha: str) -> str:
    """run_id and text, some texts changed afterwards; sha names the engine's digest of the placeholder x."""
    own = sha.replace("x", "concat('mail-run-v2', chr(0), body)")
    whole = f"""SELECT run_id, replace(concat('{{"run_id":"', id, '",', substring(body, 2, 100000)), '"root_identifier":null', concat('"root_identifier":"', id, '"')) AS text FROM (SELECT *, {own} AS id FROM (SELECT run_id, {_BODY} AS body FROM ({RUNS_SQL}) AS runs) AS written) AS named"""
    changed = f"""CASE run_id % 13 WHEN 1 THEN replace(text, '"rows_written":', '"rows_written":1') WHEN 2 THEN replace(text, '"limit":null,', '') WHEN 3 THEN replace(text, '"scanner_git_dirty":false', '"scanner_git_dirty":0') WHEN 4 THEN replace(text, '"shuffle":true', '"shuffle":true,"shuffle":true')
      WHEN 5 THEN substring(text, 1, 900) WHEN 6 THEN replace(text, '"manifest_schema_version":2,"measurement_core_algorithm"', '"manifest_schema_version":3,"measurement_core_algorithm"') WHEN 7 THEN replace(text, {_SHA_OF["source"]}, upper({_SHA_OF["source"]})) WHEN 8 THEN replace(text, '017897Z', '017897') WHEN 9 THEN replace(text, '"shuffle":', '"more":1,"shuffle":')
      WHEN 10 THEN replace(text, ',"', ' , "') WHEN 11 THEN replace(text, '"error_rows"', '"errors"') WHEN 12 THEN '[1]' ELSE text END"""
    return f"SELECT run_id, {changed} AS text FROM ({whole}) AS documents"


# The twin reads the texts with its own JSON functions.
_SHA256, _SHA1 = "json_type({j}) = 'VARCHAR' AND regexp_full_match({j} ->> '$', '[0-9a-f]{{64}}')", "json_type({j}) = 'VARCHAR' AND regexp_full_match({j} ->> '$', '[0-9a-f]{{40}}')"
_TESTS = {
    "count": "json_type({j}) = 'UBIGINT'", "positive": "json_type({j}) = 'UBIGINT' AND CAST({j} AS BIGINT) > 0", "flag": "json_type({j}) = 'BOOLEAN'", "text": "json_type({j}) = 'VARCHAR'", "texts": "json_type({j}) = 'ARRAY'", "sha256": _SHA256, "sha1": _SHA1, "any": "json_type({j}) IN ('NULL', 'VARCHAR', 'OBJECT')",
    "time": "json_type({j}) = 'VARCHAR' AND regexp_full_match({j} ->> '$', '[0-9-]{{10}}T[0-9:]{{8}}([.][0-9]{{1,6}})?Z') AND TRY_CAST({j} ->> '$' AS TIMESTAMPTZ) IS NOT NULL",
    "accounting": "list_sort(json_keys({j})) = ['analyzable_rows', 'error_rows', 'total_rows']", "resolver": "len(json_keys({j})) = 6", "root": "len(json_keys({j})) = 6 AND regexp_full_match({j} ->> '$.root_identifier', '[0-9a-f]{{64}}')",
}


def _wrong(field: str, kind: str) -> str:
    j = f"json_extract(j, '$.{field}')"
    test = _TESTS[kind.rstrip("?")].format(j=j)
    held = f"json_type({j}) = 'NULL' OR ({test})" if kind.endswith("?") else test
    return f"CASE WHEN json_exists(j, '$.{field}') AND NOT coalesce({held}, false) THEN 'kind:{field}' END"


def _number(path: str) -> str:
    return f"TRY_CAST(json_extract_string(j, '$.{path}') AS BIGINT)"


_STATED = {
    "planned": _number("planned_input_normalized_line_count"), "excluded": _number("planned_excluded_count"), "attempted": _number("attempted_input_normalized_line_count"), "written": _number("rows_written"), "source_count": _number("source_input_normalized_line_count"), "limit_rows": _number("limit"),
    **{f"{s}_{k}": _number(f"database_{s}.{f}") for s in ("pre", "post") for k, f in (("total", "total_rows"), ("ok", "analyzable_rows"), ("error", "error_rows"))},
    "run_mode": "CASE j ->> '$.run_mode' WHEN 'resume_retry_partial_errors' THEN 'resume' ELSE j ->> '$.run_mode' END", "previous": "j ->> '$.previous_run_manifest_sha256'", "input": "j ->> '$.input_sqlite_sha256'",
}
_FACT_CASES = [
    ("interval", "TRY_CAST(j ->> '$.finished_at_utc' AS TIMESTAMPTZ) < TRY_CAST(j ->> '$.started_at_utc' AS TIMESTAMPTZ)"), ("run_order", "j ->> '$.planned_input_order' <> 'seeded_shuffle_then_limit'"), ("planned", "planned <> CASE WHEN limit_rows IS NULL OR limit_rows > source_count THEN source_count ELSE limit_rows END"),
    ("links", "CASE WHEN run_mode = 'fresh' THEN previous IS NOT NULL OR input IS NOT NULL ELSE previous IS NULL OR input IS NULL OR limit_rows IS NOT NULL END"), ("root", "run_mode = 'fresh' AND j ->> '$.root_measurement_core_attestation.root_identifier' <> j ->> '$.run_id'"), *_RUN_CASES,
    ("eligible", "(j ->> '$.release_eligible' = 'true') <> (limit_rows IS NULL AND j ->> '$.scanner_git_dirty' = 'false' AND planned = source_count AND post_total = source_count AND CASE WHEN run_mode = 'fresh' THEN attempted = source_count ELSE pre_total = source_count END)"),
    ("identity", "j ->> '$.run_id' <> sha256('mail-run-v2' || chr(0) || CASE WHEN run_mode = 'fresh' THEN regexp_replace(canon, '\"root_identifier\":\"[0-9a-f]+\"', '\"root_identifier\":null') ELSE canon END)"),
]


def _listed(items: list[str]) -> str:
    return "[x FOR x IN [" + ", ".join(items) + "] IF x IS NOT NULL]"


_SQL = f"""WITH texts AS ({_documents_sql('sha256(x)')}), once AS (SELECT run_id, TRY_CAST(text AS JSON) AS j FROM texts), read AS (SELECT run_id, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = len(list_distinct(json_keys(j))) THEN j END AS j FROM once),
  sorted AS (SELECT *, '{{' || array_to_string(['"' || k || '":' || CAST(json_extract(j, '$.' || k) AS VARCHAR) FOR k IN list_sort(json_keys(j)) IF k <> 'run_id'], ',') || '}}' AS canon FROM read),
  stated AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in _STATED.items())}, CASE WHEN j IS NULL THEN ['json'] WHEN j ->> '$.manifest_schema_version' <> '2' THEN ['version']
    ELSE {_listed([f"CASE WHEN list_sort(json_keys(j)) <> {sorted(manifests.V2)} THEN 'keys' END", *[_wrong(f, k) for f, k in manifests.V2.items()]])} END AS forms FROM sorted)
  SELECT run_id, CASE WHEN j ->> '$.manifest_schema_version' = '2' THEN 2 END AS version, array_to_string(CASE WHEN len(forms) > 0 THEN forms ELSE {_listed([f"CASE WHEN {c} THEN '{k}' END" for k, c in _FACT_CASES])} END, ',') AS codes FROM stated"""


def documents(spark, d):
    """name (a run_id) and text of each manifest."""
    runs = spark.sql(RUNS_SQL.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    dealt = spread(runs, 5, "run_id")  # a run's document takes as long as five plain rows and more
    rows = spark.sql(_documents_sql("sha2(x, 256)").replace(f"({RUNS_SQL})", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{runs}"), runs=dealt)
    return rows.withColumnRenamed("run_id", "name")


@query("manifest_violations", _SQL)
def manifest_violations(spark, d):
    return manifests.violations(documents(spark, d)).withColumnRenamed("name", "run_id")


@query("manifest_identities", f"""WITH texts AS ({_documents_sql('sha256(x)')}), read AS (SELECT run_id, text, TRY_CAST(text AS JSON) AS j FROM texts) SELECT run_id, sha256(text) AS sha256, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = len(list_distinct(json_keys(j))) THEN sha256(
  '{{' || array_to_string(['"' || k || '":' || CAST(json_extract(j, '$.' || k) AS VARCHAR) FOR k IN list_sort(json_keys(j))], ',') || '}}') END AS canonical_sha256 FROM read""")
def manifest_identities(spark, d):
    parsed = documents(spark, d).withColumn("v", F.try_parse_json("text"))
    return parsed.select(F.col("name").alias("run_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.sha2(manifests.canonical(F.col("v")).cast("binary"), 256).alias("canonical_sha256"))
