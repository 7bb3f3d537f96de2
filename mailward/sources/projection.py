"""DNS-shaped rows projected from the customer table, in SQL that more than one engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import ASKED, scanned
from ..operators.tasks import spread
from .folders import committed, shared_path

RAW_SQL = """
SELECT c_custkey AS k, concat('d', CAST(c_custkey AS STRING), '.ch') AS domain,
  CASE WHEN c_custkey % 17 = 0 THEN 'error' WHEN c_custkey % 13 = 0 THEN 'nxdomain' WHEN c_nationkey % 3 = 0 THEN 'noanswer' ELSE 'ok' END AS mx_status,
  CASE c_custkey % 8 WHEN 0 THEN concat('10 d', CAST(c_custkey AS STRING), '-ch.mail.protection.outlook.com.') WHEN 1 THEN '5 alt1.aspmx.l.google.com.|1 ASPMX.L.GOOGLE.COM.'
    WHEN 2 THEN '20 backup.example.net.|10 MX1.hostpoint.ch.' WHEN 3 THEN '0 .' WHEN 4 THEN '10 mail.halcyon.ch.'
    WHEN 5 THEN concat('10 mx.d', CAST(c_custkey AS STRING), '.ch.') ELSE '5 mta-gw.infomaniak.ch.|5 aux.cyon.ch.' END AS mx_raw,
  CASE c_custkey % 11 WHEN 0 THEN 'v=DMARC1; p=reject; rua=mailto:a@Vendor-A.com!10m,mailto:b@example.ch; ruf=https://Rep.example.net/x' WHEN 1 THEN 'v=DMARC1;P=None;pct=+50'
    WHEN 2 THEN 'v=DMARC1; rua=' WHEN 3 THEN 'v=DMARC1; p=bogus; pct=250' WHEN 4 THEN 'V=DMARC1 ; p=quarantine; pct=50; adkim=s; aspf=x'
    WHEN 5 THEN 'v=DMARC1; p=none; p=reject; sp=NONE' WHEN 6 THEN 'v = dmarc1; p=; adkim=; pct=abc' WHEN 7 THEN 'v=DMARC1; p=reject; pct=-5; =x; nokey' END AS dmarc_raw,
  CASE c_custkey % 7 WHEN 0 THEN 'v=spf1 include:_spf.google.com a mx -all' WHEN 1 THEN 'v=spf1 +all -all' WHEN 2 THEN 'v=spf1 redirect=t.example a ?all' WHEN 3 THEN 'v=spf1 a redirect=t.example'
    WHEN 4 THEN 'V=SPF1 +a ~mx:x.ch ?exists:%{i} ptr ip4:1.2.3.4 include:a include:b include:c include:d ~ALL' WHEN 5 THEN 'v=spf1 all a' END AS spf_raw,
  CASE c_custkey % 5 WHEN 0 THEN 'v=DKIM1; k=rsa; p=MIGf; t=Y' WHEN 1 THEN concat('v=DKIM1; p=', repeat('A', 392)) WHEN 2 THEN 'v=DKIM1; k=ed25519; p=11qY; t=s:y' WHEN 3 THEN 'v=DKIM1; p=' END AS dkim_raw,
  CASE c_custkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'noanswer' WHEN 2 THEN 'nxdomain' WHEN 3 THEN 'error' ELSE 'noanswer' END AS a_status,
  CASE c_custkey % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'nxdomain' ELSE 'noanswer' END AS aaaa_status
FROM customer
"""

# Recorded answers of every query that a scan of these domains may ask: name, type, status, answers joined by a bar,
# and which rows have them. Names that only some rows have stay unanswered, which counts as an error.
_HOST = "CASE k % 8 WHEN 0 THEN concat('d', CAST(k AS STRING), '-ch.mail.protection.outlook.com') ELSE concat('mx.d', CAST(k AS STRING), '.ch') END"
_OWN, _ALL = "k % 8 IN (0, 5)", "true"
_ANSWERS = [
    ("domain", "MX", "mx_status", "CASE WHEN mx_status <> 'ok' THEN '' WHEN k % 97 = 5 THEN 'mail.without.preference' WHEN k % 89 = 7 THEN '' WHEN k % 16 = 6 THEN concat(mx_raw, '|7 mta-gw.infomaniak.ch.') ELSE mx_raw END", _ALL),
    ("domain", "DS", "CASE WHEN k % 23 = 0 THEN 'error' WHEN k % 5 IN (1, 2) THEN 'ok' ELSE 'noanswer' END", "CASE WHEN k % 5 = 1 AND k % 23 <> 0 THEN '2371 13 2 AA' ELSE '' END", _ALL),
    ("domain", "NS", "CASE WHEN k % 10 = 9 THEN 'noanswer' ELSE 'ok' END", "CASE WHEN k % 10 = 9 THEN '' ELSE 'NS2.Example.net.|ns1.example.net.' END", _ALL),
    ("domain", "TXT", "CASE WHEN k % 43 = 1 THEN 'noanswer' ELSE 'ok' END", "CASE WHEN k % 43 = 1 THEN '' ELSE concat('site-check=1', CASE WHEN spf_raw IS NULL THEN '' ELSE concat('|', spf_raw, '|v=spf1 -all') END) END", _ALL),
    ("domain", "SPF", "CASE WHEN k % 19 = 0 THEN 'ok' ELSE 'noanswer' END", "CASE WHEN k % 19 = 0 THEN 'v=spf1 -all' ELSE '' END", "k % 41 <> 0"),
    ("concat('_dmarc.', domain)", "TXT", "CASE WHEN k % 37 = 0 THEN 'error' WHEN dmarc_raw IS NULL THEN 'noanswer' ELSE 'ok' END", "CASE WHEN k % 37 = 0 OR dmarc_raw IS NULL THEN '' ELSE concat('other|', dmarc_raw) END", _ALL),
    (_HOST, "A", "a_status", "CASE WHEN a_status = 'ok' AND k % 12 <> 0 THEN '192.0.2.1' ELSE '' END", _OWN),
    (_HOST, "AAAA", "aaaa_status", "CASE WHEN aaaa_status = 'ok' AND k % 18 <> 0 THEN '2001:db8::1' ELSE '' END", _OWN),
    (f"concat('_25._tcp.', {_HOST})", "TLSA", "CASE WHEN k % 61 = 0 THEN 'error' WHEN k % 14 IN (0, 5) THEN 'ok' ELSE 'noanswer' END", "CASE WHEN k % 61 <> 0 AND k % 14 = 5 THEN '3 1 1 AB' ELSE '' END", _OWN),
    ("concat('default._bimi.', domain)", "TXT", "'ok'", "CASE WHEN k % 22 = 0 THEN 'x|V=BIMI1; l=https://b.example/l.svg' ELSE 'v=spf1 -all' END", _ALL),
    ("concat('_mta-sts.', domain)", "TXT", "CASE WHEN k % 47 = 0 THEN 'error' ELSE 'ok' END", "CASE WHEN k % 47 = 0 THEN '' WHEN k % 9 = 0 THEN 'v = STSv1; id=1' ELSE '' END", _ALL),
    ("concat('_smtp._tls.', domain)", "TXT", "CASE WHEN k % 12 = 0 THEN 'ok' ELSE 'nxdomain' END", "CASE WHEN k % 12 = 0 THEN 'v=TLSRPTv1; rua=mailto:t@example.ch' ELSE '' END", _ALL),
    ("domain", "CAA", "CASE WHEN k % 6 = 1 THEN 'ok' ELSE 'noanswer' END", "CASE WHEN k % 6 = 1 THEN '0 issue \"ca.example\"|0 iodef \"mailto:s@example.ch\"' ELSE '' END", _ALL),
] + [
    (f"concat('{name}._domainkey.', domain)", "TXT", f"CASE WHEN (k + {i}) % 211 = 0 THEN 'error' WHEN (k + {i}) % 4 = 0 THEN 'ok' ELSE 'noanswer' END",
     f"CASE WHEN (k + {i}) % 211 <> 0 AND (k + {i}) % 4 = 0 THEN coalesce(concat('v=DKIM1; p=|', dkim_raw), 'unrelated') ELSE '' END", _ALL)
    for i, name in enumerate(("default", "selector1", "selector2", "google", "k1", "s1", "s2", "mail", "dkim", "smtp", "key1", "mx"))
]
# Answers of names that many domains share.
_SHARED = """SELECT * FROM (VALUES ('aspmx.l.google.com', 'A', 'ok', '192.0.2.2'), ('alt1.aspmx.l.google.com', 'A', 'ok', ''), ('alt1.aspmx.l.google.com', 'AAAA', 'ok', '2001:db8::2'), ('mx1.hostpoint.ch', 'A', 'ok', '192.0.2.3'),
  ('backup.example.net', 'A', 'nxdomain', ''), ('mail.halcyon.ch', 'A', 'noanswer', ''), ('mail.halcyon.ch', 'AAAA', 'noanswer', ''), ('mta-gw.infomaniak.ch', 'A', 'ok', '192.0.2.4'), ('aux.cyon.ch', 'A', 'noanswer', ''), ('aux.cyon.ch', 'AAAA', 'nxdomain', ''),
  ('_25._tcp.aspmx.l.google.com', 'TLSA', 'noanswer', ''), ('_25._tcp.alt1.aspmx.l.google.com', 'TLSA', 'noanswer', ''), ('_25._tcp.mx1.hostpoint.ch', 'TLSA', 'ok', '3 1 1 CD'), ('_25._tcp.backup.example.net', 'TLSA', 'nxdomain', ''),
  ('_25._tcp.mail.halcyon.ch', 'TLSA', 'noanswer', ''), ('_25._tcp.mta-gw.infomaniak.ch', 'TLSA', 'ok', ''), ('_25._tcp.aux.cyon.ch', 'TLSA', 'noanswer', '')) AS fixed(name, rdtype, status, answers)"""
ANSWERS_SQL = " UNION ALL ".join([*(f"SELECT {n} AS name, '{t}' AS rdtype, {s} AS status, {a} AS answers FROM raw WHERE {w}" for n, t, s, a, w in _ANSWERS), _SHARED])
#: The statement head that names raw and answers for a query on them.
SCAN_HEAD = f"WITH raw AS ({RAW_SQL}), answers AS ({ANSWERS_SQL})"


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}"), customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), ASKED, "c_custkey"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, RAW_SQL)


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos and domain of each planned domain."""
    return raw(spark, sf_dir).select(F.col("k").alias("pos"), "domain")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, rdtype, status and the list of answers; one scan of the table gives the answers of each row."""
    rows = ", ".join(f"named_struct('name', CASE WHEN {w} THEN {n} END, 'rdtype', '{t}', 'status', {s}, 'answers', {a})" for n, t, s, a, w in _ANSWERS)
    own = raw(spark, sf_dir).select(F.expr(f"inline(array({rows}))")).filter("name IS NOT NULL")
    return own.unionByName(spark.sql(_SHARED)).withColumn("answers", F.when(F.col("answers") == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split("answers", r"\|")))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a scan, computed from the answers."""
    return scanned(plan(spark, sf_dir), answers(spark, sf_dir))


_stored: dict[tuple[str, str], str] = {}


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's stored results, the input of metrics, validation and the report.

    A session scans the tables of a folder once and writes the results into the shared folder; later calls read
    these files, as long as they are there.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _stored and committed(spark, _stored[key]):
        return spark.read.parquet(_stored[key])
    path = shared_path(spark, "results")
    fresh(spark, sf_dir).write.parquet(path)
    _stored[key] = path
    return spark.read.parquet(path)
