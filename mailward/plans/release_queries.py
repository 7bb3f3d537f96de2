"""Queries of validation, plans, runs and the privacy of what is published."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import chains, leaves, quality, store
from ..schema import COLUMNS, FLAGS, LEGACY, NESTED
from ..sources.files import domain_list
from ..sources.folders import shared_path
from ..sources.projection import _of
from .registry import ORACLES, QUERIES, query

_TAMPERED = {
    "domain": "CASE WHEN k % 83 = 0 THEN '' ELSE concat('d', CAST(k AS STRING), '.ch') END", "has_mx": "CASE WHEN k % 71 = 0 THEN '2' WHEN k % 3 = 0 THEN '0' ELSE '1' END", "has_spf": "CASE WHEN k % 5 = 0 THEN '0' WHEN k % 67 = 0 THEN 'yes' ELSE '1' END",
    "mx_provider": "CASE WHEN k % 59 = 0 THEN NULL WHEN k % 61 = 0 THEN 'nobody' WHEN k % 3 = 0 THEN '' ELSE 'hostpoint' END", "spf_all_mechanism": "CASE WHEN k % 53 = 0 THEN 'maybe' WHEN k % 5 = 0 THEN '' ELSE 'none' END",
    "spf_lookup_count": "CASE WHEN k % 79 = 0 THEN '-1' ELSE '3' END", "dmarc_pct": "CASE WHEN k % 73 = 0 THEN NULL WHEN k % 29 = 0 THEN 'half' ELSE '-5' END", "dmarc_policy": "CASE WHEN k % 89 = 0 THEN NULL ELSE 'none' END",
    "ns_hosts": """CASE WHEN k % 47 = 0 THEN '{}' WHEN k % 43 = 0 THEN '[1]' WHEN k % 41 = 0 THEN 'x' ELSE '["a.example"]' END""",
    "query_statuses": """CASE k % 13 WHEN 0 THEN '{"MX d":"error"}' WHEN 1 THEN '{"MX d":"lost"}' WHEN 2 THEN 'x' WHEN 3 THEN '{}' ELSE '{"MX d":"ok"}' END""",
    "error": "CASE WHEN k % 97 = 0 THEN NULL WHEN k % 13 IN (0, 3) AND k % 2 = 0 THEN 'mx_query_error' WHEN k % 13 = 3 THEN 'scan_exception: broke' WHEN k % 31 = 0 THEN 'query_errors: DS d' ELSE '' END", "scanned_at": "'2026-01-01 00:00:00'",
}


def _cell(c: str) -> str:
    return _TAMPERED.get(c) or ("'0'" if c in FLAGS else "'[]'" if c in NESTED else "''")


#: Stored rows as text, some of which break a rule.
TAMPERED_SQL = "SELECT " + ", ".join(f"{_cell(c)} AS {c}" for c in COLUMNS) + " FROM (SELECT c_custkey AS k FROM customer) AS keyed"


def _tampered(spark, d):
    return _of(spark, d, TAMPERED_SQL)


_LISTS = [c for c in NESTED if c != "query_statuses"]
_TEXTS = [c for c, t in COLUMNS.items() if t == "string" and c != "error"]
_FAILED = "len([1 FOR x IN coalesce(json_extract_string(s, '$.*'), []) IF x = 'error']) > 0"
_BROKEN = {
    "flags": " OR ".join(f"coalesce({c}, '') NOT IN ('0', '1')" for c in FLAGS),
    "lookups": "NOT regexp_matches(coalesce(spf_lookup_count, ''), '^[0-9]+$')",
    "pct": "NOT regexp_matches(coalesce(dmarc_pct, ''), '^-?[0-9]+$')",
    "lists": " OR ".join(f"NOT json_valid({c}) OR json_type(TRY_CAST({c} AS JSON)) <> 'ARRAY' OR len([1 FOR x IN json_transform(TRY_CAST({c} AS JSON), '[\"JSON\"]') IF json_type(x) <> 'VARCHAR']) > 0" for c in ["ns_hosts"]),
    "texts": " OR ".join(f"{c} IS NULL" for c in _TEXTS) + " OR domain = '' OR scanned_at IS NULL OR scanned_at = ''",
    "error_null": "error IS NULL",
    "provider": "mx_provider IS NULL OR (has_mx = '1' AND mx_provider NOT IN ('hostpoint')) OR (has_mx = '0' AND mx_provider <> '')",
    "spf_terminal": "(has_spf = '1' AND spf_all_mechanism NOT IN ('hardfail', 'softfail', 'neutral', 'pass', 'none')) OR (has_spf = '0' AND spf_all_mechanism <> '')",
    "dmarc_null": "dmarc_policy IS NULL OR dmarc_sp IS NULL",
    "statuses": "s IS NULL OR json_type(s) <> 'OBJECT'",
    "status_values": "len([1 FOR x IN coalesce(json_extract_string(s, '$.*'), []) IF x NOT IN ('ok', 'nxdomain', 'noanswer', 'error')]) > 0",
    "error_status": f"coalesce((error = '' AND {_FAILED}) OR (error <> '' AND NOT ({_FAILED}) AND NOT (starts_with(error, 'scan_exception: ') AND query_statuses = '{{}}')), false)",
}
_BAD_HEAD = f"WITH bad AS (SELECT *, TRY_CAST(query_statuses AS JSON) AS s FROM ({TAMPERED_SQL}))"


@query("validate_results", f"{_BAD_HEAD} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {p}) AS violations FROM bad" for k, p in _BROKEN.items()))
def validate_results(spark, d):
    return quality.violations(_tampered(spark, d))


for _name, _rules in {"validate_flags": ["flags", "lookups", "pct"], "validate_status_values": ["statuses", "status_values", "lists"], "validate_error_status": ["error_null", "error_status"], "validate_provider": ["provider", "spf_terminal", "dmarc_null"]}.items():
    def _run(spark, d, rules=tuple(_rules)):
        return quality.broken_rows(_tampered(spark, d)).filter(F.col("rule").isin(*rules))

    QUERIES[_name] = _run
    ORACLES[_name] = f"{_BAD_HEAD} " + " UNION ALL ".join(f"SELECT domain, '{r}' AS rule FROM bad WHERE {_BROKEN[r]}" for r in _rules)


_LINES = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(' a', CAST(c_custkey AS STRING), '.ch.. ') ELSE concat('B', CAST(c_custkey AS STRING), '.ch') END AS line FROM customer"


@query("src_domain_list", f"SELECT row_number() OVER (ORDER BY k) AS pos, rtrim(trim(line), '.') AS domain FROM ({_LINES}) WHERE trim(line) <> ''")
def src_domain_list(spark, d):
    path = shared_path(spark, "lines")
    _of(spark, d, _LINES).orderBy("k").select("line").write.text(path)
    return domain_list(spark, path)


# Chains of runs made from orders: one chain a customer, one run an order; some facts are wrong on purpose.
RUNS_SQL = """
SELECT o_orderkey AS run_id, o_custkey AS chain, nth, CASE WHEN nth = 1 THEN 'fresh' WHEN o_orderkey % 61 = 0 THEN 'other' ELSE 'resume' END AS run_mode, CAST(100 AS BIGINT) AS source_count,
  CAST(CASE WHEN o_orderkey % 37 = 0 THEN 50 END AS INTEGER) AS limit_rows, o_orderkey % 41 = 0 AS dirty,
  CAST(CASE WHEN o_orderkey % 43 = 0 THEN 99 ELSE 100 END AS BIGINT) AS planned, CAST(CASE WHEN nth = 1 THEN 0 ELSE 100 - errors_before END AS BIGINT) AS excluded, CAST(CASE WHEN nth = 1 THEN 100 ELSE errors_before END AS BIGINT) AS attempted,
  CAST(CASE WHEN nth = 1 THEN 100 WHEN o_orderkey % 47 = 0 THEN 1 ELSE errors_before END AS BIGINT) AS written,
  CAST(CASE WHEN nth = 1 THEN 0 ELSE 100 END AS BIGINT) AS pre_total, CAST(CASE WHEN nth = 1 THEN 0 ELSE 100 - errors_before END AS BIGINT) AS pre_ok, CAST(CASE WHEN nth = 1 THEN 0 ELSE errors_before END AS BIGINT) AS pre_error,
  CAST(100 AS BIGINT) AS post_total, CAST(100 - errors_after AS BIGINT) AS post_ok, CAST(CASE WHEN o_orderkey % 53 = 0 THEN errors_after + 1 ELSE errors_after END AS BIGINT) AS post_error,
  CAST(nth * 10 - CASE WHEN o_orderkey % 59 = 0 THEN 9 ELSE 0 END AS BIGINT) AS started, CAST(nth * 10 + 5 AS BIGINT) AS finished
FROM (SELECT o_orderkey, o_custkey, nth, 40 - least(nth - 1, 20) AS errors_before, 40 - least(nth, 20) AS errors_after FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) AS numbered) AS counted
"""
_SHA = "concat_ws('|', CAST(run_id AS STRING), CAST(chain AS STRING), CAST(nth AS STRING), run_mode, CAST(post_ok AS STRING), CAST(post_error AS STRING))"


def _linked_sql(sha: str) -> str:
    return f"SELECT *, CASE WHEN run_id % 67 = 0 THEN 'lost' ELSE lag(manifest_sha) OVER (PARTITION BY chain ORDER BY nth) END AS previous_sha FROM (SELECT *, {sha} AS manifest_sha FROM ({RUNS_SQL}) AS runs) AS hashed"


def _runs(spark, d):
    return spark.sql(_linked_sql(f"sha2({_SHA}, 256)").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))


_RUNS_HEAD = f"WITH runs AS ({_linked_sql(f'sha256({_SHA})')})"


@query("run_chain_links", f"""{_RUNS_HEAD}, chained AS (SELECT r.*, lag(manifest_sha) OVER w AS p_sha, lag(finished) OVER w AS p_fin, lag(post_total) OVER w AS p_total, lag(post_ok) OVER w AS p_ok, lag(post_error) OVER w AS p_error FROM runs AS r WINDOW w AS (PARTITION BY chain ORDER BY nth))
  SELECT run_id, previous_sha IS NULL AS is_root, previous_sha IS NULL OR coalesce(previous_sha = p_sha, false) AS linked, previous_sha IS NULL OR coalesce(previous_sha = p_sha AND started >= p_fin, false) AS in_order,
  previous_sha IS NULL OR coalesce(previous_sha = p_sha AND pre_total = p_total AND pre_ok = p_ok AND pre_error = p_error, false) AS counts_link FROM chained""")
def run_chain_links(spark, d):
    return store.chain_links(_runs(spark, d))


_RUN_CASES = [
    ("mode_known", "run_mode NOT IN ('fresh', 'resume')"), ("pre_partition", "pre_total <> pre_ok + pre_error"), ("post_partition", "post_ok + post_error <> post_total"), ("written_equals_attempted", "attempted <> written"), ("excluded_plus_attempted", "planned <> attempted + excluded"),
    ("post_total_range", "post_total < pre_total OR post_total > pre_total + attempted"), ("nothing_attempted_nothing_changed", "attempted = 0 AND (post_total, post_ok, post_error) <> (pre_total, pre_ok, pre_error)"),
    ("fresh_starts_empty", "run_mode = 'fresh' AND pre_total + pre_ok + pre_error <> 0"), ("fresh_excludes_none", "run_mode = 'fresh' AND (excluded <> 0 OR attempted <> planned)"), ("fresh_keeps_all", "run_mode = 'fresh' AND post_total <> attempted"),
    ("retry_plans_all", "run_mode = 'resume' AND planned <> pre_total"), ("retry_attempts_errors", "run_mode = 'resume' AND attempted <> pre_error"), ("retry_excludes_analyzable", "run_mode = 'resume' AND excluded <> pre_ok"), ("retry_keeps_total", "run_mode = 'resume' AND post_total <> pre_total"), ("retry_lowers_errors", "run_mode = 'resume' AND post_error > pre_error"),
]
_RUN_BROKEN = "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _RUN_CASES) + "] IF x IS NOT NULL], ',')"


@query("run_summary_invariants", f"{_RUNS_HEAD} SELECT run_id, {_RUN_BROKEN} AS broken FROM runs")
def run_summary_invariants(spark, d):
    return store.broken_rules(_runs(spark, d))


@query("release_eligible", f"{_RUNS_HEAD} SELECT run_id, {_RUN_BROKEN} = '' AND limit_rows IS NULL AND NOT dirty AND planned = 100 AND post_total = 100 AND CASE WHEN run_mode = 'fresh' THEN attempted = 100 ELSE pre_total = 100 END AS release_eligible FROM runs")
def release_eligible(spark, d):
    return store.eligible(_runs(spark, d))


# The same chains with links that fork, lead back into a cycle, or name nothing, and with facts of a sequence.
_BENT = "CASE WHEN chain % 29 = 0 AND nth = 1 THEN last_value(manifest_sha) OVER (PARTITION BY chain ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) WHEN run_id % 71 = 0 AND nth > 2 THEN first_value(manifest_sha) OVER (PARTITION BY chain ORDER BY nth) ELSE previous_sha END"


def _bent_sql(sha: str) -> str:
    return f"""SELECT run_id, chain, nth, manifest_sha, {_BENT} AS previous_sha, nth + CASE WHEN run_id % 101 = 0 THEN 1 ELSE 0 END AS sequence, started, finished - CASE WHEN run_id % 83 = 0 THEN 20 ELSE 0 END + CASE WHEN run_id % 89 = 0 THEN 25 ELSE 0 END AS finished,
  CASE WHEN run_id % 73 = 0 THEN 'odd' WHEN nth = 1 THEN 'old' ELSE 'new' END AS core, CASE WHEN run_id % 79 = 0 THEN 'other' ELSE 'source' END AS source_sha, source_count, run_mode, attempted, pre_total, pre_error, post_total, post_error FROM ({_linked_sql(sha)}) AS linked"""


def _bent(spark, d):
    return spark.sql(_bent_sql(f"sha2({_SHA}, 256)").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))


_BENT_HEAD = f"WITH RECURSIVE runs AS ({_bent_sql(f'sha256({_SHA})')})"


@query("run_chain_walk", f"""{_BENT_HEAD}, link AS (SELECT r.run_id, r.previous_sha, p.run_id AS parent FROM runs AS r LEFT JOIN runs AS p ON p.manifest_sha = r.previous_sha),
  walk AS (SELECT run_id, run_id AS place, parent, previous_sha, [run_id] AS path FROM link UNION ALL SELECT w.run_id, l.run_id, l.parent, l.previous_sha, list_append(w.path, l.run_id) FROM walk AS w JOIN link AS l ON l.run_id = w.parent WHERE NOT list_contains(w.path, l.run_id)),
  last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY len(path) DESC) = 1)
  SELECT run_id, CASE WHEN parent IS NOT NULL THEN 'cycle' WHEN previous_sha IS NOT NULL THEN 'lost' ELSE 'root' END AS kind, CASE WHEN parent IS NULL THEN place ELSE list_min(path[list_position(path, parent):]) END AS root,
  CASE WHEN parent IS NULL THEN len(path) - 1 END AS depth, coalesce(parent = run_id OR (parent IS NOT NULL AND list_position(path, parent) = 1), false) AS in_cycle, (SELECT count(*) FROM link AS c WHERE c.parent = last.run_id) AS children FROM last""")
def run_chain_walk(spark, d):
    return chains.chain_walk(_bent(spark, d))


_EARLIER = "(PARTITION BY chain ORDER BY started, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SEQUENCED = f"""placed AS (SELECT *, lag(core) OVER w AS p_core, row_number() OVER w AS place FROM runs WINDOW w AS (PARTITION BY chain ORDER BY started, run_id)), turned AS (SELECT *, place > 1 AND core <> p_core AS turned FROM placed),
  seen AS (SELECT *, lag(sequence) OVER w AS p_sequence, lag(finished) OVER w AS p_finished, lag(source_sha) OVER w AS p_source, lag(post_total) OVER w AS p_total, lag(post_error) OVER w AS p_error, max(finished) OVER {_EARLIER} AS latest, count(*) FILTER (WHERE turned) OVER {_EARLIER} AS turns FROM turned WINDOW w AS (PARTITION BY chain ORDER BY started, run_id))"""
_SEQUENCE_BROKEN = [
    ("sequence_contiguous", "sequence - 1 <> coalesce(p_sequence, 0)"), ("interval_not_empty", "started >= finished"), ("after_previous", "place > 1 AND started < p_finished"), ("after_all_earlier", "place > 1 AND latest > started"),
    ("core_changes_once", "turned AND (place <> 2 OR turns > 0)"), ("source_unchanged", "place > 1 AND source_sha <> p_source"), ("accounting_links", "place > 1 AND (pre_total <> p_total OR pre_error <> p_error)"), ("errors_never_rise", "place > 1 AND post_error > pre_error"), ("order_agrees", "place > 1 AND sequence <= p_sequence"),
]


@query("run_overlaps", f"{_BENT_HEAD}, {_SEQUENCED} SELECT run_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _SEQUENCE_BROKEN) + "] IF x IS NOT NULL], ',') AS broken FROM seen")
def run_overlaps(spark, d):
    return chains.sequence_violations(_bent(spark, d))


_PINS = "SELECT c_custkey AS chain, CASE WHEN c_custkey % 31 = 0 THEN 'other' ELSE 'source' END AS pin_source, CAST(100 AS BIGINT) AS pin_count, CASE WHEN c_custkey % 37 = 0 THEN 'odd' ELSE 'old' END AS pin_root_core, 'new' AS pin_core, CAST(30 AS BIGINT) AS pin_errors FROM customer WHERE c_custkey % 41 <> 0"


@query("run_chain_pinned", f"""{_BENT_HEAD}, pins AS ({_PINS}), placed AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY started, run_id) AS place, row_number() OVER (PARTITION BY chain ORDER BY started DESC, run_id DESC) AS back FROM runs)
  SELECT p.chain, run_id, array_to_string([x FOR x IN [CASE WHEN pin_source IS NULL THEN 'chain_pinned' END, CASE WHEN pin_source IS NULL OR source_sha <> pin_source OR source_count <> pin_count THEN 'source_pinned' END,
    CASE WHEN place = 1 AND (pin_source IS NULL OR run_mode <> 'fresh' OR core <> pin_root_core OR attempted <> pin_count OR pre_total + pre_error > 0 OR post_total <> pin_count) THEN 'root_pinned' END,
    CASE WHEN place > 1 AND (pin_source IS NULL OR run_mode <> 'resume' OR core <> pin_core OR pre_total <> pin_count OR post_total <> pin_count OR attempted <> pre_error) THEN 'retry_pinned' END,
    CASE WHEN back = 1 AND (pin_source IS NULL OR post_total <> pin_count OR post_error <> pin_errors) THEN 'final_accounts' END] IF x IS NOT NULL], ',') AS broken FROM placed AS p LEFT JOIN pins ON pins.chain = p.chain
  UNION ALL SELECT chain, NULL, 'chain_missing' FROM pins WHERE chain NOT IN (SELECT chain FROM runs)""")
def run_chain_pinned(spark, d):
    return chains.pinned_violations(_bent(spark, d), _of(spark, d, _PINS))


@query("run_intervals", f"{_BENT_HEAD}, e AS (SELECT *, max(finished) OVER {_EARLIER} AS latest FROM runs) SELECT chain, count(*) AS runs, min(started) AS started, max(finished) AS finished, coalesce(max(greatest(started - latest, 0)), 0) AS longest_gap FROM e GROUP BY chain")
def run_intervals(spark, d):
    return chains.intervals(_bent(spark, d))


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query("privacy_scan_sha", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9A-Fa-f])([0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})($|[^0-9A-Fa-f])')")
def privacy_scan_sha(spark, d):
    return _documents(spark, d).filter(F.size(privacy.digests(F.col("text"))) > 0).select("doc_id")


@query("privacy_scan_ip", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9A-Fa-f:.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9A-Fa-f:.])')")
def privacy_scan_ip(spark, d):
    return _documents(spark, d).filter(F.size(privacy.ipv4_runs(F.col("text"))) > 0).select("doc_id")


_PAYLOADS = "SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN 'see v = DMARC1 here' WHEN 1 THEN 'RUF = mailto:x' WHEN 2 THEN 'file://x y' WHEN 3 THEN 'at /etc/passwd' WHEN 4 THEN 'C:/temp/x' WHEN 5 THEN 'the mx_hosts list' WHEN 6 THEN 'no v=spf12' WHEN 7 THEN 'host 0x7f.0x0.0x0.0x1' ELSE 'plain text' END AS text FROM customer"


@query("privacy_scan_dns", f"SELECT k FROM ({_PAYLOADS}) WHERE k % 9 IN (0, 1)")
def privacy_scan_dns(spark, d):
    return _of(spark, d, _PAYLOADS).filter(F.rlike("text", F.lit(privacy.PATTERNS["dns_payload"]))).select("k")


@query("privacy_codes", f"SELECT k, CASE k % 9 WHEN 0 THEN 'dns_payload' WHEN 1 THEN 'dns_payload' WHEN 2 THEN 'file_uri' WHEN 3 THEN 'posix_path' WHEN 4 THEN 'windows_path' WHEN 5 THEN 'private_field' WHEN 7 THEN 'encoded_ip' ELSE '' END AS codes FROM ({_PAYLOADS})")
def privacy_codes(spark, d):
    return _of(spark, d, _PAYLOADS).select("k", F.array_join(privacy.violation_codes(F.col("text")), ",").alias("codes"))


@query("extract_domains", r"SELECT page_id, lower(regexp_extract(url, '://([^/:]+)', 1)) AS domain FROM pages")
def extract_domains(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return pages.select("page_id", F.explode(privacy.names(host)).alias("domain"))


# A text for each code, some under a disguise, made different in each row; the code or codes that it breaks.
_DISGUISED = [
    ("concat('the MX_Hosts of ', k)", "private_field"), ("concat('V%253Dspf1 ', k)", "dns_payload"), ("concat('version : STSv1 ', k)", "dns_payload"), ("concat('file:', chr(92), chr(92), k, ' here')", "file_uri"), ("concat('D:', chr(92), 'tmp', k)", "windows_path"), ("concat('see %2Fsrv/', k)", "posix_path"),
    ("concat('(', repeat('aB', 20), ')', k, '-')", "digest"), ("concat(repeat('f', 64), 'x', k)", "digest"), ("concat('0x7f0000', CASE WHEN k % 2 = 0 THEN '01' ELSE 'fe' END)", "encoded_ip"), ("'by 0x7f.0x0.0x0.0xA'", "encoded_ip"), ("'at 017700000001 now'", "encoded_ip"), ("concat('mail&period;host', k, '&#46;example')", "name"), ("concat('bücher', k, '。example')", "name"),
    ("concat('http://user', chr(64), '0x7f.', k % 256, '/x')", "url_ip"), ("concat('https://010.1.', k % 65536, ':8080')", "url_ip"), ("concat('call ', 2130706433 + k % 1000, ' today')", "decimal_ip"), ("concat('from 10.1.2.', k % 256)", "ip"), ("concat('from 10.1.2.', 256 + k % 700)", "ip"), ("concat('at 2001:db8::', k % 9000)", "ip"), ("'at ::ffff:7'", "ip"),
    ("concat('1.1.1.1 and 8.8.8.8 serve ', k)", ""), ("concat('plain ', k, ' text: a.b1 12:30:45 1.2 v1..2 x_.y')", ""), ("concat('0x7f00001 ', 4294967296, ' ', 99999999999)", ""), ("concat(repeat('a', 41), k)", ""), ("'mx_hosts at /etc with v=dmarc1 and 1.2.3.4'", "private_field,dns_payload,posix_path,ip"),
]
_DISGUISED_SQL = "SELECT k, CASE k % 25 " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_DISGUISED)) + " END AS text FROM (SELECT CAST(c_custkey AS INTEGER) AS k FROM customer) AS keyed"


@query("privacy_disguised", "SELECT k, CASE k % 25 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_DISGUISED)) + f" END AS codes FROM ({_DISGUISED_SQL})")
def privacy_disguised(spark, d):
    rows = _of(spark, d, _DISGUISED_SQL)
    return rows.select("k", F.array_join(privacy.violation_codes(F.col("text"), ips=["1.1.1.1", "8.8.8.8"]), ",").alias("codes"))


def _nested(spark, d):
    """Nested texts made from events: lists in objects, and some texts that are no JSON."""
    events = spark.read.parquet(f"{d}/events.parquet")
    lists = F.regexp_replace("props", r":\s*([^,}]+)", ": [$1]")
    return events.select("event_id", F.concat(F.lit('{"p": '), lists, F.lit(', "q": [true, null, 1.5]}')).alias("text"))


@query("json_leaves", "SELECT event_id, 'p.' || k || '.*' AS path, json_extract_string(props, '$.' || k) AS leaf FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaves(spark, d):
    found = leaves.json_leaves(_nested(spark, d), "event_id", "text")
    return found.select("event_id", F.array_join("path", ".").alias("path"), "leaf")


_MIXED = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN concat('{"a": [', props, ', {"deep": {"x": "', event_type, '", "y": [1, "z"]}}], "b": ', CAST(user_id AS STRING), '}') WHEN 2 THEN concat('{"a": {"k": "v"}, "a.k": 2, "user": {"id": ', CAST(user_id AS STRING), ', "mail": "', event_type, '"}}')
  WHEN 3 THEN substring(props, 2, 100) WHEN 4 THEN concat('[', props, ', [["', event_type, '"]], true]') WHEN 5 THEN '"text"' ELSE NULL END AS text FROM events"""
_PERMITTED = ["k", "a.*.k", "a.*.deep.*", "a.k", "b", "user.id", "*.k"]


@query("json_forbidden_paths", f"""WITH RECURSIVE t AS (SELECT event_id, TRY_CAST(text AS JSON) AS j FROM ({_MIXED})), walk AS (SELECT event_id, CAST([] AS VARCHAR[]) AS path, j FROM t WHERE j IS NOT NULL UNION ALL SELECT event_id, list_append(path, c.key), c.child FROM walk,
  LATERAL (SELECT CASE WHEN json_type(j) = 'ARRAY' THEN '*' ELSE e.key END AS key, e.value AS child FROM json_each(j) AS e) AS c WHERE json_type(j) IN ('ARRAY', 'OBJECT')), leaf AS (SELECT event_id, path, json_extract_string(j, '$') AS leaf FROM walk WHERE json_type(j) IN ('VARCHAR', 'UBIGINT', 'BIGINT'))
  SELECT event_id, array_to_string(path, '/') AS path, leaf FROM leaf WHERE NOT ({" OR ".join("(len(path) = " + str(len(p.split("."))) + "".join(f" AND path[{i + 1}] = '{x}'" for i, x in enumerate(p.split(".")) if x != "*") + ")" for p in _PERMITTED)})""")
def json_forbidden_paths(spark, d):
    texts = spark.sql(_MIXED.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    found = leaves.json_leaves(texts, "event_id", "text")
    return leaves.forbidden(found, [p.split(".") for p in _PERMITTED]).select("event_id", F.array_join("path", "/").alias("path"), "leaf")
