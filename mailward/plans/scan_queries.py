"""Queries of the scan: its gate, its stages and its results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from ..sources import lookup
from ..sources.projection import answers, fresh, plan, wide
from .registry import query
from .twins import SCAN, SCAN_HEAD


def _gates(spark, d):
    return scan.gated(plan(spark, d), answers(spark, d))


def _observed(spark, d):
    return scan.observed(plan(spark, d), answers(spark, d))


@query("mx_gate", f"{SCAN} SELECT domain, st <> 'nxdomain' AS domain_exists, st IN ('ok', 'noanswer') AS goes_on, broken AS malformed, has_mx FROM gate")
def mx_gate(spark, d):
    return _gates(spark, d).select("domain", (F.col("mx_status") != "nxdomain").alias("domain_exists"), "goes_on", "malformed", (~F.col("malformed") & (F.size("hosts") > 0)).alias("has_mx"))


@query("query_plan_group_a", f"{SCAN} SELECT domain, CAST(idx AS INTEGER) AS q_ord, rdtype, name FROM asked WHERE stage = 1")
def query_plan_group_a(spark, d):
    return scan.planned(_gates(spark, d)).filter("stage = 1").select("domain", F.col("idx").alias("q_ord"), "rdtype", "name")


@query("query_plan", f"{SCAN} SELECT domain, CAST(stage AS INTEGER) AS stage, CAST(idx AS INTEGER) AS idx, rdtype, name FROM asked")
def query_plan(spark, d):
    return scan.planned(_gates(spark, d)).select("domain", "stage", "idx", "rdtype", "name")


@query("query_statuses", f"{SCAN} SELECT domain, 'MX ' || domain AS key, st AS status FROM gate WHERE NOT broken UNION SELECT domain, rdtype || ' ' || name, status FROM seen")
def query_statuses(spark, d):
    return wide(spark, d).select("domain", F.explode("query_statuses").alias("key", "status"))


@query("ds_and_ns", f"""{SCAN} SELECT gate.domain, EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = gate.domain AND f.rdtype = 'DS') AS has_ds_record,
  coalesce((SELECT array_to_string(list_sort([lower(rtrim(h, '.')) FOR h IN s.answers]), ',') FROM seen AS s WHERE s.domain = gate.domain AND s.rdtype = 'NS' AND s.status = 'ok'), '') AS ns_hosts FROM gate""")
def ds_and_ns(spark, d):
    return wide(spark, d).select("domain", "has_ds_record", F.array_join("ns_hosts", ",").alias("ns_hosts"))


@query("spf_stage", f"{SCAN} SELECT gate.domain, coalesce(spfs.record, '') AS spf_record, coalesce(all_mechanism, '') AS spf_all_mechanism, coalesce(lookup_count, 0) AS spf_lookup_count, coalesce(near_limit, false) AS spf_near_limit, w.has_legacy_spf_rrtype FROM gate JOIN w USING (domain) LEFT JOIN spfs USING (domain) LEFT JOIN spfp USING (domain)")
def spf_stage(spark, d):
    return wide(spark, d).select("domain", "spf_record", "spf_all_mechanism", "spf_lookup_count", "spf_near_limit", "has_legacy_spf_rrtype")


@query("dmarc_stage", f"{SCAN} SELECT w.domain, has_dmarc, w.dmarc_policy, w.dmarc_rua, w.dmarc_ruf, w.dmarc_pct, w.dmarc_sp, w.dmarc_adkim, w.dmarc_aspf, coalesce(rua_domains, '') AS rua_domains, coalesce(ruf_domains, '') AS ruf_domains FROM w LEFT JOIN dmarcp USING (domain)")
def dmarc_stage(spark, d):
    return wide(spark, d).select("domain", "has_dmarc", "dmarc_policy", "dmarc_rua", "dmarc_ruf", "dmarc_pct", "dmarc_sp", "dmarc_adkim", "dmarc_aspf", *[F.array_join(f"dmarc_{c}", ",").alias(c) for c in ("rua_domains", "ruf_domains")])


@query("dangling_mx", f"{SCAN} SELECT domain, coalesce(string_agg(dead.item, ',' ORDER BY dead.idx), '') AS unresolvable, count(dead.item) > 0 AS mx_unresolvable FROM gate LEFT JOIN dead USING (domain) WHERE has_mx GROUP BY domain")
def dangling_mx(spark, d):
    return _observed(spark, d).filter("NOT malformed AND size(hosts) > 0").select("domain", F.expr(scan.DANGLING).alias("dead")).select("domain", F.array_join("dead", ",").alias("unresolvable"), (F.size("dead") > 0).alias("mx_unresolvable"))


@query("dkim_rollup", f"{SCAN} SELECT gate.domain, coalesce(string_agg(keys.item, ',' ORDER BY keys.idx), '') AS found, count(keys.item) > 0 AS has_dkim, coalesce(bool_or(testing), false) AS testing_mode, coalesce(bool_or(weak), false) AS weak_key FROM gate LEFT JOIN keys USING (domain) WHERE has_mx GROUP BY gate.domain")
def dkim_rollup(spark, d):
    rows = wide(spark, d).filter("has_mx")
    return rows.select("domain", F.array_join("dkim_selectors_found", ",").alias("found"), "has_dkim", F.col("dkim_testing_mode").alias("testing_mode"), F.col("dkim_weak_key").alias("weak_key"))


@query("transport_signals", f"""{SCAN} SELECT gate.domain, coalesce(bimis.record, '') AS bimi_record, coalesce(stss.record, '') AS mta_sts_record, coalesce(rpts.record, '') AS tlsrpt_record,
  coalesce((SELECT array_to_string(f.answers, ',') FROM filled AS f WHERE f.domain = gate.domain AND f.rdtype = 'CAA'), '') AS caa_records FROM gate LEFT JOIN bimis USING (domain) LEFT JOIN stss USING (domain) LEFT JOIN rpts USING (domain) WHERE has_mx""")
def transport_signals(spark, d):
    return wide(spark, d).filter("has_mx").select("domain", "bimi_record", "mta_sts_record", "tlsrpt_record", F.array_join("caa_records", ",").alias("caa_records"))


@query("tlsa_rollup", f"{SCAN} SELECT gate.domain, (SELECT string_agg(host, ',' ORDER BY hi) FROM host WHERE host.domain = gate.domain) AS checked, coalesce((SELECT string_agg(item, ',' ORDER BY idx) FROM filled AS f WHERE f.domain = gate.domain AND f.rdtype = 'TLSA'), '') AS found, EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = gate.domain AND f.rdtype = 'TLSA') AS has_tlsa_record FROM gate WHERE has_mx")
def tlsa_rollup(spark, d):
    return wide(spark, d).filter("has_mx").select("domain", F.array_join("tlsa_hosts_checked", ",").alias("checked"), F.array_join("tlsa_hosts_found", ",").alias("found"), "has_tlsa_record")


@query("scan_error_summary", f"{SCAN} SELECT domain, error FROM w")
def scan_error_summary(spark, d):
    return wide(spark, d).select("domain", "error")


_FLAT = ["domain", "domain_exists", "has_mx", "mx_provider", "has_spf", "spf_all_mechanism", "spf_lookup_count", "spf_near_limit", "has_legacy_spf_rrtype", "has_dkim", "dkim_testing_mode", "dkim_weak_key", "has_dmarc", "dmarc_policy", "dmarc_rua", "dmarc_ruf", "dmarc_pct",
         "dmarc_sp", "dmarc_adkim", "dmarc_aspf", "has_ds_record", "mx_unresolvable", "has_bimi", "has_mta_sts", "has_tlsrpt", "has_caa", "has_tlsa_record", "error"]


@query("scan_results", f"{SCAN} SELECT {', '.join(_FLAT)} FROM w")
def scan_results(spark, d):
    return fresh(spark, d).select(*_FLAT)


# A resolver's answers made from a checksum of the question: a state, or a failure of its own kind.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(rdtype || ' ' || name, '')]), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"


@query("live_lookup", f"""{SCAN}, once AS (SELECT DISTINCT name, rdtype FROM asked), summed AS (SELECT *, {_CRC} AS h FROM once)
  SELECT name, rdtype, CASE h % 8 WHEN 0 THEN 'nxdomain' WHEN 1 THEN 'noanswer' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN h % 8 > 4 THEN CASE WHEN rdtype = 'TXT' THEN 'v=' || h || chr(65533) ELSE h || ' ' || rdtype END ELSE '' END AS answers FROM summed""")
def live_lookup(spark, d):
    asked = scan.planned(_gates(spark, d)).select("name", "rdtype")
    found = lookup.answered(asked, lookup.ChecksumResolver, lookup.Settings(tasks=4, in_flight=32))
    return found.select("name", "rdtype", "status", F.array_join("answers", "|").alias("answers"))


@query("live_scan_errors", f"""{SCAN_HEAD.split(", answers AS")[0]}, q AS (SELECT 'd' || k || '.ch' AS name, 'MX' AS rdtype FROM raw), s AS (SELECT *, {_CRC} AS h FROM q)
  SELECT name AS domain, h % 8 <> 0 AS domain_exists, h % 8 > 4 AND h <= 2147483647 AS has_mx, CASE WHEN h % 8 IN (2, 3, 4) THEN 'mx_query_error' END AS error FROM s""")
def live_scan_errors(spark, d):
    found = scan.scanned_live(plan(spark, d), lambda asked: lookup.answered(asked, lookup.ChecksumResolver, lookup.Settings(tasks=4, in_flight=32)))
    return found.select("domain", "domain_exists", "has_mx", F.when(F.col("error") == "mx_query_error", F.col("error")).alias("error"))
