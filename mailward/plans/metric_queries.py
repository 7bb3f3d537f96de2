"""Queries of the metrics, of what checks them, and of the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, quality
from ..schema import legacy, canonical
from ..sources.files import csv_parity, write_metrics
from ..sources.folders import shared_path
from ..sources.projection import wide
from .registry import ORACLES, QUERIES, query
from .twins import COUNTED, SCAN


def _metrics(spark, d):
    return quality.counts_only(metrics.counted(wide(spark, d)))


def _family(name: str, prefixes: list[str]) -> None:
    def run(spark, d):
        kept = F.lit(not prefixes)
        for p in prefixes:
            kept = kept | F.startswith("metric_id", F.lit(p))
        return _metrics(spark, d).filter(kept)

    QUERIES[name] = run
    ORACLES[name] = f"{COUNTED} SELECT * FROM m WHERE " + (" OR ".join(f"starts_with(metric_id, '{p}')" for p in prefixes) or "true")


for _name, _prefixes in {"metric_catalogue": [], "metrics_population": ["population.", "domain."], "metrics_mx_provider": ["mx."], "metrics_spf": ["spf."], "metrics_dkim": ["dkim."], "metrics_dmarc": ["dmarc."], "metrics_dns": ["ds.", "ns."], "metrics_transport": ["tlsa.", "bimi.", "mta_sts.", "tls_rpt.", "caa."]}.items():
    _family(_name, _prefixes)


@query("legacy_catalogue", f"{COUNTED} SELECT * FROM m")
def legacy_catalogue(spark, d):
    return metrics.counted(canonical(legacy(wide(spark, d))))


@query("legacy_schema_view", f"{SCAN} SELECT domain, has_ds_record, has_tlsa_record, CAST(44 AS INTEGER) AS columns FROM w")
def legacy_schema_view(spark, d):
    rows = canonical(legacy(wide(spark, d)))
    return rows.select("domain", "has_ds_record", "has_tlsa_record", F.lit(len(rows.columns)).alias("columns"))


def _sum(ids):
    return "CAST((SELECT sum(numerator) FROM m WHERE metric_id IN (" + ",".join(f"'{i}'" for i in ids) + ")) AS BIGINT)"


@query("reconcile_metrics", f"{COUNTED} SELECT identity, left_sum, right_sum, left_sum = right_sum AS holds FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS identity, {_sum(a)} AS left_sum, {_sum(b)} AS right_sum" for k, (a, b) in metrics.IDENTITIES.items()) + ")")
def reconcile_metrics(spark, d):
    return metrics.reconciled(_metrics(spark, d))


@query("independent_counts", f"{COUNTED} SELECT metric_id, numerator FROM m")
def independent_counts(spark, d):
    return metrics.recounted(wide(spark, d))


@query("dual_catalogue_diff", f"{COUNTED} SELECT metric_id, numerator AS first_count, numerator AS second_count FROM m")
def dual_catalogue_diff(spark, d):
    rows = wide(spark, d)
    a, b = metrics.counted(rows).select("metric_id", F.col("numerator").alias("first_count")), metrics.recounted(rows).withColumnRenamed("numerator", "second_count")
    return a.join(b, "metric_id", "full_outer")


@query("metric_denominators", f"{COUNTED} SELECT a.metric_id, a.denominator_id, a.denominator, b.numerator AS named FROM m AS a JOIN m AS b ON a.denominator_id = b.metric_id")
def metric_denominators(spark, d):
    rows = _metrics(spark, d)
    named = rows.select(F.col("metric_id").alias("denominator_id"), F.col("numerator").alias("named"))
    return rows.select("metric_id", "denominator_id", "denominator").join(named, "denominator_id").select("metric_id", "denominator_id", "denominator", "named")


@query("validate_metrics", f"{COUNTED} SELECT metric_id, true AS unique_id, numerator BETWEEN 0 AND denominator AS counts_hold, true AS denominator_holds, true AS percent_holds FROM m")
def validate_metrics(spark, d):
    return quality.metric_checks(_metrics(spark, d))


@query("percent_exact", f"""{COUNTED} SELECT metric_id, CASE WHEN denominator = 0 THEN '0.0000000000000000' ELSE CAST(u // 10000000000000000 AS VARCHAR) || '.' || lpad(CAST(u % 10000000000000000 AS VARCHAR), 16, '0') END AS percentage
  FROM (SELECT *, (CAST(numerator AS HUGEINT) * 2000000000000000000 + denominator) // (2 * greatest(denominator, 1)) AS u FROM m)""")
def percent_exact(spark, d):
    return _metrics(spark, d).select("metric_id", metrics.sixteen_places(F.col("numerator"), F.col("denominator")).alias("percentage"))


@query("percent_display", "SELECT l_orderkey, l_linenumber, CAST(CAST(round(CAST(l_linenumber AS DECIMAL(18,0)) * 100 / 7, 2) AS DECIMAL(9,2)) AS VARCHAR) AS percent FROM lineitem")
def percent_display(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", metrics.display(F.col("l_linenumber"), F.lit(7)).alias("percent"))


@query("metrics_accounting", f"{SCAN} SELECT count(*) AS total, count(*) FILTER (WHERE error = '') AS analyzable, count(*) FILTER (WHERE error <> '') AS error FROM w")
def metrics_accounting(spark, d):
    return metrics.accounting_of(_metrics(spark, d))


@query("csv_parity", f"{COUNTED} SELECT metric_id, true AS parity FROM m")
def csv_parity_query(spark, d):
    folder = shared_path(spark, "metrics")
    rows = _metrics(spark, d)
    write_metrics(rows, folder)
    return csv_parity(spark, folder, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("figure_data", f"{COUNTED}, f AS (SELECT figure, generate_subscripts(ids, 1) - 1 AS place, unnest(ids) AS metric_id, unnest(dens) AS denominator_id FROM (VALUES " + ", ".join(f"('{k}', {list(v[0])}, {list(v[1])})" for k, v in metrics.FIGURES.items()) + ") AS t(figure, ids, dens)) SELECT figure, CAST(place AS INTEGER) AS place, f.metric_id, numerator, denominator, percent, m.denominator_id = f.denominator_id AS denominator_fits FROM f JOIN m USING (metric_id)")
def figure_data(spark, d):
    return metrics.figure_rows(_metrics(spark, d))


_REPORT = [
    ("population", "total rows", "true", "total"), ("population", "errored", "error <> ''", "total"), ("population", "analyzable", "error = ''", "total"), ("population", "mx present", "ok AND has_mx", "analyzable"), ("dns", "ds record", "ok AND has_ds_record", "analyzable"),
    ("spf", "has spf", "mail AND has_spf", "mx"), *[("spf", f"all={t}", f"mail AND spf_all_mechanism = '{t}'", "mx") for t in ("hardfail", "softfail", "neutral", "pass", "none")], ("spf", "near limit", "mail AND spf_near_limit", "mx"),
    ("dkim", "selector observed", "mail AND has_dkim", "mx"), ("dkim", "weak key", "mail AND dkim_weak_key", "mx"), ("dmarc", "has dmarc", "mail AND has_dmarc", "mx"), *[("dmarc", f"policy={p}", f"mail AND dmarc_policy = '{p}'", "mx") for p in ("reject", "quarantine", "none", "absent")],
    ("dmarc", "absent or monitoring only", "mail AND dmarc_policy IN ('absent', 'none')", "mx"), ("transport", "bimi", "mail AND has_bimi", "mx"), ("transport", "mta-sts", "mail AND has_mta_sts", "mx"), ("transport", "tls-rpt", "mail AND has_tlsrpt", "mx"), ("transport", "caa", "mail AND has_caa", "mx"), ("transport", "tlsa", "mail AND has_tlsa_record", "mx"),
]
_BASES = {"total": "SELECT count(*) FROM w", "analyzable": "SELECT count(*) FROM w WHERE error = ''", "mx": "SELECT count(*) FROM w WHERE error = '' AND has_mx"}


def _report_sql() -> str:
    rows = []
    for i, (section, label, condition, base) in enumerate(_REPORT):
        condition = condition.replace("mail AND", "error = '' AND has_mx AND").replace("ok AND", "error = '' AND")
        rows.append(f"SELECT {i} AS ord, '{section}' AS section, '{label}' AS label, (SELECT count(*) FROM w WHERE {condition}) AS n, ({_BASES[base]}) AS base")
    return f"{SCAN} SELECT CAST(ord AS INTEGER) AS ord, section, label, n, CASE WHEN base = 0 THEN NULL ELSE CAST(round(CAST(n AS DECIMAL(18,0)) * 100 / base, 1) AS DOUBLE) END AS percent FROM ({' UNION ALL '.join(rows)})"


@query("report_summary", _report_sql())
def report_summary(spark, d):
    return metrics.report(wide(spark, d))
