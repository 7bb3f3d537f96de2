"""SQL twins of the scan and of the metrics, written on their own: they share no expression with the operators."""

from __future__ import annotations

from ..functions import providers
from ..sources.projection import SCAN_HEAD

SPF = r"""SELECT domain, coalesce(nm, 'none') AS all_mechanism, CAST(n AS INTEGER) AS lookup_count, n >= 8 AS near_limit FROM (
 SELECT domain, list_extract(terms, {end}) AS nm, len([1 FOR t IN scanned IF t NOT IN ('-all','~all','?all','+all','all') AND regexp_matches(regexp_replace(t, '^[+~?-]', ''), '^((a|mx|ptr)$|include:|exists:|redirect=|a[:/]|mx[:/]|ptr:)')
   AND NOT ({skip} AND starts_with(regexp_replace(t, '^[+~?-]', ''), 'redirect='))]) AS n FROM (
 SELECT *, {scan} AS scanned FROM (
 SELECT domain, w, [CASE t WHEN '-all' THEN 'hardfail' WHEN '~all' THEN 'softfail' WHEN '?all' THEN 'neutral' ELSE 'pass' END FOR t IN w IF t IN ('-all','~all','?all','+all','all')] AS terms,
   list_min([CAST(i AS BIGINT) FOR i IN range(1, len(w) + 1) IF w[i] IN ('-all','~all','?all','+all','all')]) AS first_end
 FROM (SELECT domain, string_split(lower({column}), ' ') AS w FROM {table} WHERE {column} IS NOT NULL))))"""


def spf(table: str, column: str, first: bool = True) -> str:
    parts = ("1", "len(terms) > 0", "w[1:coalesce(first_end, len(w))]") if first else ("-1", "false", "w")
    return SPF.format(end=parts[0], skip=parts[1], scan=parts[2], column=column, table=table)


TAGS = "[{'k': lower(trim(x[1:instr(x, '=') - 1])), 'v': trim(x[instr(x, '=') + 1:])} FOR x IN string_split({c}, ';') IF contains(x, '=')]"


def tags(column: str) -> str:
    return TAGS.replace("{c}", column)


def tag(key: str) -> str:
    return f"list_extract([e.v FOR e IN t IF e.k = '{key}'], -1)"


def domains(value: str) -> str:
    uris = f"[string_split(trim(u), '!')[1] FOR u IN string_split(coalesce({value}, ''), ',')]"
    return f"""[CASE WHEN starts_with(lower(u), 'mailto:') THEN lower(string_split(u, '@')[-1]) ELSE lower(string_split(string_split(u, '://')[2], '/')[1]) END
      FOR u IN {uris} IF (starts_with(lower(u), 'mailto:') AND contains(u, '@')) OR (NOT starts_with(lower(u), 'mailto:') AND contains(u, '://'))]"""


DMARC = f"""SELECT domain, coalesce(nullif(lower({tag('p')}), ''), 'absent') AS policy, coalesce({tag('rua')}, '') <> '' AS has_rua, coalesce({tag('ruf')}, '') <> '' AS has_ruf,
  CAST(CASE WHEN regexp_matches({tag('pct')}, '^[+-]?[0-9]+$') THEN CAST({tag('pct')} AS BIGINT) ELSE 100 END AS BIGINT) AS pct, coalesce(lower({tag('sp')}), '') AS sp,
  coalesce(lower({tag('adkim')}), 'r') AS adkim, coalesce(lower({tag('aspf')}), 'r') AS aspf,
  array_to_string({domains(tag('rua'))}, ',') AS rua_domains, array_to_string({domains(tag('ruf'))}, ',') AS ruf_domains
  FROM (SELECT domain, {TAGS} AS t FROM {{table}} WHERE {{c}} IS NOT NULL)"""


def dmarc(table: str, column: str) -> str:
    return DMARC.replace("{c}", column).replace("{table}", table)


DIM = "(VALUES " + ",".join(f"({i},'{p}','{s}')" for i, (p, ss) in enumerate(providers.PROVIDERS) for s in ss) + ") AS dim(ord, provider, suffix)"
SELECTORS = "CASE provider WHEN 'microsoft365' THEN ['selector1', 'selector2'] WHEN 'google_workspace' THEN ['google'] ELSE ['default', 'selector1', 'selector2', 'google', 'k1', 's1', 's2', 'mail', 'dkim', 'smtp', 'key1', 'mx'] END"


def _found(test: str, rdtype: str, prefix: str) -> str:
    return f"SELECT domain, list_extract([x FOR x IN answers IF {test}], 1) AS record FROM seen WHERE status = 'ok' AND rdtype = '{rdtype}' AND name = '{prefix}' || domain AND stage IN (1, 4)"


def _version(tag_: str) -> str:
    return f"starts_with(replace(lower(trim(x)), ' ', ''), '{tag_}')"


#: Names of the scan's parts: mxq, host, gate, asked, res, seen, and what the stages make of them.
SCAN = f"""{SCAN_HEAD}, ans AS (SELECT name, rdtype, CASE WHEN status IN ('ok', 'nxdomain', 'noanswer', 'error') THEN status ELSE 'error' END AS status, CASE WHEN answers = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(answers, '|') END AS answers FROM answers),
mxq AS (SELECT raw.domain, coalesce(ans.status, 'error') AS st, coalesce(ans.answers, []) AS got FROM raw LEFT JOIN ans ON ans.name = raw.domain AND ans.rdtype = 'MX'),
mxp AS (SELECT domain, i, TRY_CAST(regexp_extract(a, '^(\\S+)', 1) AS INTEGER) AS pref, lower(rtrim(regexp_extract(a, '^\\S+\\s+(.*)$', 1), '.')) AS host FROM (SELECT domain, generate_subscripts(got, 1) AS i, unnest(got) AS a FROM mxq WHERE st = 'ok')),
host AS (SELECT domain, host, CAST(row_number() OVER (PARTITION BY domain ORDER BY pref, i) - 1 AS INTEGER) AS hi FROM mxp WHERE host <> '' AND domain NOT IN (SELECT domain FROM mxp WHERE pref IS NULL)),
hit AS (SELECT domain, hi, ord, provider FROM host JOIN {DIM} ON host = suffix OR ends_with(host, '.' || suffix) UNION ALL SELECT domain, hi, 99, 'self_hosted' FROM host WHERE host = domain OR ends_with(host, '.' || domain)),
best AS (SELECT domain, arg_min(provider, hi * 100 + ord) AS provider FROM hit GROUP BY domain),
gate AS (SELECT mxq.domain, st, mxq.domain IN (SELECT domain FROM mxp WHERE pref IS NULL) AS broken, mxq.domain IN (SELECT domain FROM host) AS has_mx, CASE WHEN mxq.domain IN (SELECT domain FROM host) THEN coalesce(best.provider, 'other') ELSE '' END AS provider FROM mxq LEFT JOIN best ON best.domain = mxq.domain),
fixedq AS (SELECT * FROM (VALUES (1, 0, 'DS', ''), (1, 1, 'NS', ''), (1, 2, 'TXT', ''), (1, 3, 'SPF', ''), (1, 4, 'TXT', '_dmarc.'), (4, 0, 'TXT', 'default._bimi.'), (4, 1, 'TXT', '_mta-sts.'), (4, 2, 'TXT', '_smtp._tls.'), (4, 3, 'CAA', '')) AS q(stage, idx, rdtype, prefix)),
sel AS (SELECT domain, generate_subscripts({SELECTORS}, 1) - 1 AS idx, unnest({SELECTORS}) AS s FROM gate WHERE has_mx),
asked AS (SELECT domain, stage, idx, rdtype, prefix || domain AS name, prefix AS item FROM gate CROSS JOIN fixedq WHERE NOT broken AND st IN ('ok', 'noanswer') AND (stage = 1 OR has_mx)
  UNION ALL SELECT domain, 2, hi, t, host, host FROM host CROSS JOIN (VALUES ('A'), ('AAAA')) AS v(t) UNION ALL SELECT domain, 3, idx, 'TXT', s || '._domainkey.' || domain, s FROM sel UNION ALL SELECT domain, 5, hi, 'TLSA', '_25._tcp.' || host, host FROM host),
res AS (SELECT asked.*, coalesce(ans.status, 'error') AS status, coalesce(ans.answers, []) AS answers FROM asked LEFT JOIN ans ON ans.name = asked.name AND ans.rdtype = asked.rdtype),
seen AS (SELECT * FROM res WHERE rdtype <> 'AAAA' UNION ALL SELECT b.* FROM res AS b JOIN res AS a ON a.domain = b.domain AND a.idx = b.idx AND a.rdtype = 'A' AND (a.status = 'noanswer' OR (a.status = 'ok' AND len(a.answers) = 0)) WHERE b.rdtype = 'AAAA'),
bads AS (SELECT domain, 0 AS stage, 0 AS idx, 'MX' AS rdtype, domain AS name FROM gate WHERE st = 'error' UNION ALL SELECT domain, stage, idx, rdtype, name FROM seen WHERE status = 'error'),
errs AS (SELECT domain, CASE WHEN count(*) = 1 AND max(stage) = 0 THEN 'mx_query_error' ELSE 'query_errors: ' || string_agg(rdtype || ' ' || name, ', ' ORDER BY stage, idx, rdtype) END AS error FROM bads GROUP BY domain),
dead AS (SELECT domain, idx, item FROM seen WHERE (rdtype = 'A' AND status = 'nxdomain') OR (rdtype = 'AAAA' AND (status IN ('noanswer', 'nxdomain') OR (status = 'ok' AND len(answers) = 0)))),
spfs AS ({_found("starts_with(lower(trim(x)), 'v=spf1')", "TXT", "")}), spfp AS ({spf("spfs", "record")}),
dmarcs AS ({_found(_version("v=dmarc1"), "TXT", "_dmarc.")}), dmarcp AS ({dmarc("dmarcs", "record")}),
keyed AS (SELECT domain, idx, item, list_extract([x FOR x IN answers IF coalesce(list_extract([e.v FOR e IN {tags('x')} IF e.k = 'p'], -1), '') <> ''], 1) AS record FROM seen WHERE stage = 3 AND status = 'ok'),
keys AS (SELECT domain, idx, item, lower(coalesce({tag('t')}, '')) = 'y' AS testing, length({tag('p')}) < 250 AS weak FROM (SELECT domain, idx, item, {tags('record')} AS t FROM keyed WHERE record IS NOT NULL)),
bimis AS ({_found(_version("v=bimi1"), "TXT", "default._bimi.")}), stss AS ({_found(_version("v=stsv1"), "TXT", "_mta-sts.")}), rpts AS ({_found(_version("v=tlsrptv1"), "TXT", "_smtp._tls.")}),
filled AS (SELECT domain, stage, idx, rdtype, item, answers FROM seen WHERE status = 'ok' AND len(answers) > 0),
w AS (SELECT g.domain, g.broken OR g.st <> 'nxdomain' AS domain_exists, g.has_mx, g.provider AS mx_provider, spfp.domain IS NOT NULL AS has_spf, coalesce(spfp.all_mechanism, '') AS spf_all_mechanism, coalesce(spfp.lookup_count, 0) AS spf_lookup_count, coalesce(spfp.near_limit, false) AS spf_near_limit,
  EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = g.domain AND f.rdtype = 'SPF') AS has_legacy_spf_rrtype, EXISTS (SELECT 1 FROM keys AS f WHERE f.domain = g.domain) AS has_dkim, EXISTS (SELECT 1 FROM keys AS f WHERE f.domain = g.domain AND f.testing) AS dkim_testing_mode, EXISTS (SELECT 1 FROM keys AS f WHERE f.domain = g.domain AND f.weak) AS dkim_weak_key,
  dmarcp.domain IS NOT NULL AS has_dmarc, CASE WHEN g.broken OR g.st IN ('nxdomain', 'error') THEN '' ELSE coalesce(dmarcp.policy, 'absent') END AS dmarc_policy, coalesce(dmarcp.has_rua, false) AS dmarc_rua, coalesce(dmarcp.has_ruf, false) AS dmarc_ruf, coalesce(dmarcp.pct, 100) AS dmarc_pct, coalesce(dmarcp.sp, '') AS dmarc_sp, coalesce(dmarcp.adkim, 'r') AS dmarc_adkim, coalesce(dmarcp.aspf, 'r') AS dmarc_aspf,
  EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = g.domain AND f.rdtype = 'DS') AS has_ds_record, EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = g.domain AND f.rdtype = 'NS') AS has_ns, EXISTS (SELECT 1 FROM dead AS f WHERE f.domain = g.domain) AS mx_unresolvable,
  EXISTS (SELECT 1 FROM bimis AS f WHERE f.domain = g.domain AND f.record IS NOT NULL) AS has_bimi, EXISTS (SELECT 1 FROM stss AS f WHERE f.domain = g.domain AND f.record IS NOT NULL) AS has_mta_sts, EXISTS (SELECT 1 FROM rpts AS f WHERE f.domain = g.domain AND f.record IS NOT NULL) AS has_tlsrpt,
  EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = g.domain AND f.rdtype = 'CAA') AS has_caa, EXISTS (SELECT 1 FROM filled AS f WHERE f.domain = g.domain AND f.rdtype = 'TLSA') AS has_tlsa_record,
  CASE WHEN g.broken THEN 'scan_exception: malformed MX answer of ' || g.domain ELSE coalesce(errs.error, '') END AS error
  FROM gate AS g LEFT JOIN spfp ON spfp.domain = g.domain LEFT JOIN dmarcp ON dmarcp.domain = g.domain LEFT JOIN errs ON errs.domain = g.domain)
"""

# Each metric with its denominator and its condition on an analyzable row; written here by hand, as a second source.
METRICS = """
domain.exists | population.analyzable | domain_exists
domain.not_exists | population.analyzable | domain_exists = false
mx.present | population.analyzable | has_mx
mx.absent | population.analyzable | has_mx = false
spf.present | mx.present | has_mx AND has_spf
spf.absent | mx.present | has_mx AND has_spf = false
spf.hardfail | mx.present | has_mx AND spf_all_mechanism = 'hardfail'
spf.softfail | mx.present | has_mx AND spf_all_mechanism = 'softfail'
spf.neutral | mx.present | has_mx AND spf_all_mechanism = 'neutral'
spf.pass | mx.present | has_mx AND spf_all_mechanism = 'pass'
spf.no_terminal_mechanism | mx.present | has_mx AND has_spf AND spf_all_mechanism IN ('none', '')
spf.legacy_rrtype99 | population.analyzable | has_legacy_spf_rrtype
spf.no_mx_present | mx.absent | has_spf AND has_mx = false
dkim.selector_observed | mx.present | has_mx AND has_dkim
dkim.selector_not_observed | mx.present | has_mx AND has_dkim = false
dkim.weak_key_heuristic | dkim.selector_observed | has_mx AND has_dkim AND dkim_weak_key
dkim.testing_mode | dkim.selector_observed | has_mx AND has_dkim AND dkim_testing_mode
dmarc.detected | mx.present | has_mx AND has_dmarc
dmarc.reject | mx.present | has_mx AND has_dmarc AND dmarc_policy = 'reject'
dmarc.quarantine | mx.present | has_mx AND has_dmarc AND dmarc_policy = 'quarantine'
dmarc.none | mx.present | has_mx AND has_dmarc AND dmarc_policy = 'none'
dmarc.genuine_no_record | mx.present | has_mx AND has_dmarc = false
dmarc.missing_policy | mx.present | has_mx AND has_dmarc AND dmarc_policy IN ('', 'absent')
dmarc.unsupported_policy | mx.present | has_mx AND has_dmarc AND dmarc_policy NOT IN ('', 'absent', 'none', 'quarantine', 'reject')
dmarc.no_supported_effective_policy | mx.present | has_mx AND NOT (has_dmarc AND dmarc_policy IN ('none', 'quarantine', 'reject'))
dmarc.no_detected_enforcement | mx.present | has_mx AND NOT (has_dmarc AND dmarc_policy IN ('quarantine', 'reject'))
dmarc.detected_all | population.analyzable | has_dmarc
dmarc.partial_pct | dmarc.detected_all | has_dmarc AND dmarc_pct BETWEEN 0 AND 99
dmarc.invalid_pct | dmarc.detected_all | has_dmarc AND dmarc_pct NOT BETWEEN 0 AND 100
dmarc.strict_alignment | dmarc.detected_all | has_dmarc AND 's' IN (dmarc_adkim, dmarc_aspf)
dmarc.invalid_alignment | dmarc.detected_all | has_dmarc AND NOT (dmarc_adkim IN ('r', 's') AND dmarc_aspf IN ('r', 's'))
dmarc.no_mx_detected | mx.absent | has_dmarc AND has_mx = false
ds.record_present | population.analyzable | has_ds_record
ns.answer_present | population.analyzable | has_ns
tlsa.record_present | mx.present | has_mx AND has_tlsa_record
bimi.record_present | mx.present | has_mx AND has_bimi
mta_sts.txt_present | mx.present | has_mx AND has_mta_sts
tls_rpt.record_present | mx.present | has_mx AND has_tlsrpt
caa.record_present | mx.present | has_mx AND has_caa
mx.unresolvable | mx.present | has_mx AND mx_unresolvable
"""
KNOWN = [p for p, _ in providers.PROVIDERS] + ["self_hosted", "other", "unknown"]
_ROWS = [[x.strip() for x in line.split("|")] for line in METRICS.strip().splitlines()]
_ROWS += [[f"mx.provider.{p}", "mx.present", f"has_mx AND (mx_provider = '{p}'" + (" OR mx_provider = '')" if p == "unknown" else ")")] for p in KNOWN]
_COUNTS = " UNION ALL ".join(
    ["SELECT 'population.total' AS metric_id, 'population.total' AS denominator_id, count(*) AS numerator FROM w", "SELECT 'population.analyzable', 'population.total', count(*) FROM w WHERE error = ''", "SELECT 'population.error', 'population.total', count(*) FROM w WHERE error <> ''"]
    + [f"SELECT '{m}', '{d}', count(*) FROM w WHERE error = '' AND ({c})" for m, d, c in _ROWS]
)
DISPLAY = "CASE WHEN {d} = 0 THEN '0.00' ELSE CAST(CAST(round(CAST({n} AS DECIMAL(18,0)) * 100 / {d}, 2) AS DECIMAL(9,2)) AS VARCHAR) END"
#: SCAN and m(metric_id, denominator_id, numerator, denominator, percent).
COUNTED = f"{SCAN}, base AS ({_COUNTS}), m AS (SELECT a.metric_id, a.numerator, a.denominator_id, b.numerator AS denominator, {DISPLAY.format(n='a.numerator', d='b.numerator')} AS percent FROM base AS a JOIN base AS b ON b.metric_id = a.denominator_id)"
