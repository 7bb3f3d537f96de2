"""The registered queries and their SQL twins, over projected rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parsers, providers, text
from ..operators import store
from ..sources.projection import RAW_SQL, plan, raw, wide
from . import twins
from .registry import ORACLES, QUERIES, query
from .twins import DIM as _DIM, domains as _domains, tag as _tag

def _raw(sql: str) -> str:
    return f"WITH raw AS ({RAW_SQL}) {sql}"


def _scanned(sql: str) -> str:
    return f"{twins.SCAN} {sql}"


def _joined(c):
    return F.array_join(c, ",")


@query("parse_spf", _raw(twins.spf("raw", "spf_raw")))
def parse_spf(spark, d):
    return raw(spark, d).filter("spf_raw IS NOT NULL").select("domain", parsers.spf(F.col("spf_raw")).alias("s")).select("domain", "s.*")


@query("parse_spf_v1", _raw(twins.spf("raw", "spf_raw", first=False)))
def parse_spf_v1(spark, d):
    return raw(spark, d).filter("spf_raw IS NOT NULL").select("domain", parsers.spf(F.col("spf_raw"), first_wins=False).alias("s")).select("domain", "s.*")


_TAGS = twins.TAGS


@query("parse_dmarc", _raw(twins.dmarc("raw", "dmarc_raw")))
def parse_dmarc(spark, d):
    found = raw(spark, d).filter("dmarc_raw IS NOT NULL").select("domain", parsers.dmarc(F.col("dmarc_raw")).alias("s")).select("domain", "s.*")
    return found.withColumns({c: _joined(F.col(c)) for c in ("rua_domains", "ruf_domains")})


@query("report_domain_topk", _raw(f"""SELECT report_domain, count(*) AS n FROM (SELECT unnest({_domains(_tag('rua'))}) AS report_domain FROM (SELECT {_TAGS.replace('{c}', 'dmarc_raw')} AS t FROM raw WHERE dmarc_raw IS NOT NULL))
  GROUP BY 1 ORDER BY n DESC, report_domain LIMIT 10"""))
def report_domain_topk(spark, d):
    found = raw(spark, d).filter("dmarc_raw IS NOT NULL").select(F.explode(parsers.dmarc(F.col("dmarc_raw"))["rua_domains"]).alias("report_domain"))
    return found.groupBy("report_domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "report_domain").limit(10)


@query("parse_tags", _raw(f"SELECT domain, CAST(pos - 1 AS INTEGER) AS pos, e.k AS k, e.v AS v FROM (SELECT domain, unnest(t) AS e, generate_subscripts(t, 1) AS pos FROM (SELECT domain, {_TAGS.replace('{c}', 'dmarc_raw')} AS t FROM raw WHERE dmarc_raw IS NOT NULL))"))
def parse_tags(spark, d):
    return raw(spark, d).filter("dmarc_raw IS NOT NULL").select("domain", F.posexplode(text.tags(F.col("dmarc_raw"))).alias("pos", "e")).select("domain", "pos", "e.k", "e.v")


def _dkim_sql(testing: str, weak: str) -> str:
    return _raw(f"SELECT domain, {testing} AS testing_mode, length(coalesce({_tag('p')}, '')) BETWEEN 1 AND 249 {weak} AS weak_key FROM (SELECT domain, {_TAGS.replace('{c}', 'dkim_raw')} AS t FROM raw WHERE dkim_raw IS NOT NULL)")


@query("parse_dkim", _dkim_sql(f"lower(coalesce({_tag('t')}, '')) = 'y'", ""))
def parse_dkim(spark, d):
    return raw(spark, d).filter("dkim_raw IS NOT NULL").select("domain", parsers.dkim(F.col("dkim_raw")).alias("s")).select("domain", "s.*")


@query("parse_dkim_candidate", _dkim_sql(f"list_contains(string_split(lower(coalesce({_tag('t')}, '')), ':'), 'y')", f"AND coalesce({_tag('k')}, 'rsa') = 'rsa'"))
def parse_dkim_candidate(spark, d):
    return raw(spark, d).filter("dkim_raw IS NOT NULL").select("domain", parsers.dkim(F.col("dkim_raw"), candidate=True).alias("s")).select("domain", "s.*")


_FLAT = "replace(lower(trim(r)), ' ', '')"


@query("classify_txt", _raw(f"""SELECT domain, r AS record, starts_with(lower(trim(r)), 'v=spf1') AS is_spf, starts_with({_FLAT}, 'v=dmarc1') AS is_dmarc, starts_with({_FLAT}, 'v=bimi1') AS is_bimi, starts_with({_FLAT}, 'v=stsv1') AS is_mta_sts,
  starts_with({_FLAT}, 'v=tlsrptv1') AS is_tlsrpt, coalesce({_tag('p')}, '') <> '' AS is_dkim
  FROM (SELECT domain, r, {_TAGS.replace('{c}', 'r')} AS t FROM (SELECT domain, unnest([spf_raw, dmarc_raw, dkim_raw]) AS r FROM raw) WHERE r IS NOT NULL)"""))
def classify_txt(spark, d):
    r = F.col("record")
    rows = raw(spark, d).select("domain", F.explode(F.array_compact(F.array("spf_raw", "dmarc_raw", "dkim_raw"))).alias("record"))
    return rows.select("domain", "record", parsers.is_spf(r).alias("is_spf"), *[parsers.is_kind(r, k).alias(f"is_{k}") for k in parsers.CLASSES], parsers.is_dkim(r).alias("is_dkim"))


@query("find_first", _raw("SELECT domain, coalesce(CASE WHEN starts_with(lower(spf_raw), 'v=spf1') THEN spf_raw END, '') AS record FROM raw"))
def find_first(spark, d):
    records = F.array_compact(F.array("dkim_raw", "dmarc_raw", "spf_raw"))
    return raw(spark, d).select("domain", F.coalesce(text.first_match(records, parsers.is_spf), F.lit("")).alias("record"))


_MX = "[{'p': CAST(string_split(a, ' ')[1] AS INTEGER), 'i': i, 'h': lower(rtrim(string_split(a, ' ')[2], '.'))} FOR a, i IN string_split(mx_raw, '|')]"


@query("parse_mx", _raw(f"SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY m.p, m.i) - 1 AS INTEGER) AS pos, m.p AS pref, m.h AS host FROM (SELECT domain, unnest({_MX}) AS m FROM raw)"))
def parse_mx(spark, d):
    return raw(spark, d).select("domain", F.posexplode(parsers.mx_answers(F.split("mx_raw", r"\|"))).alias("pos", "m")).select("domain", "pos", "m.pref", "m.host")


_HOSTS = f"[m.h FOR m IN list_sort({_MX}) IF m.h <> '']"


@query("mx_hosts_sorted", _raw(f"SELECT domain, array_to_string({_HOSTS}, ',') AS hosts FROM raw"))
def mx_hosts_sorted(spark, d):
    return raw(spark, d).select("domain", _joined(parsers.mx_hosts(F.split("mx_raw", r"\|"))).alias("hosts"))


_PROVIDER_SQL = f"""hosts AS (SELECT domain, unnest(h) AS host, generate_subscripts(h, 1) AS i FROM (SELECT domain, {_HOSTS} AS h FROM raw)),
 hits AS (SELECT domain, i, ord, provider FROM hosts JOIN {_DIM} ON host = suffix OR ends_with(host, '.' || suffix)
   UNION ALL SELECT domain, i, 99, 'self_hosted' FROM hosts WHERE host = domain OR ends_with(host, '.' || domain)),
 best AS (SELECT domain, arg_min(provider, i * 100 + ord) AS provider FROM hits GROUP BY domain),
 named AS (SELECT raw.domain, mx_status, coalesce(provider, 'other') AS provider FROM raw LEFT JOIN best ON raw.domain = best.domain)"""


def _with_provider(sql: str) -> str:
    return f"WITH raw AS ({RAW_SQL}), {_PROVIDER_SQL} {sql}"


def _named(spark, d):
    return raw(spark, d).select("domain", "mx_status", providers.provider(parsers.mx_hosts(F.split("mx_raw", r"\|")), F.col("domain")).alias("provider"))


@query("mx_provider", _with_provider("SELECT domain, provider FROM named"))
def mx_provider(spark, d):
    return _named(spark, d).select("domain", "provider")


@query("provider_distribution", _scanned("SELECT coalesce(nullif(mx_provider, ''), '(unknown)') AS provider, count(*) AS n, CAST(100.0 * count(*) / sum(count(*)) OVER () AS DOUBLE) AS share FROM w WHERE error = '' AND has_mx GROUP BY 1"))
def provider_distribution(spark, d):
    counts = wide(spark, d).filter("error = '' AND has_mx").groupBy(F.coalesce(F.nullif("mx_provider", F.lit("")), F.lit("(unknown)")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))
    # The window is over one row a provider, of a closed set.
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "provider")


_SELECTORS = twins.SELECTORS


@query("dkim_selector_plan", _with_provider(f"SELECT domain, CAST(pos - 1 AS INTEGER) AS pos, s || '._domainkey.' || domain AS name FROM (SELECT domain, unnest({_SELECTORS}) AS s, generate_subscripts({_SELECTORS}, 1) AS pos FROM named)"))
def dkim_selector_plan(spark, d):
    return _named(spark, d).select("domain", F.posexplode(providers.selectors(F.col("provider"))).alias("pos", "s")).select("domain", "pos", F.concat("s", F.lit("._domainkey."), "domain").alias("name"))


_PLAN = "SELECT c_custkey AS pos, concat('d', CAST(c_custkey AS STRING), '.ch') AS domain FROM customer"


def _plan(spark, d):
    return plan(spark, d)


_BAD = "SELECT domain FROM gate WHERE broken UNION SELECT domain FROM bads"


@query("resume_anti_join", _scanned(f"SELECT p.* FROM ({_PLAN}) AS p WHERE domain IN ({_BAD})"))
def resume_anti_join(spark, d):
    return store.to_resume(_plan(spark, d), wide(spark, d)).select("pos", "domain")


@query("retry_subset", _scanned(f"SELECT p.* FROM ({_PLAN}) AS p WHERE domain IN ({_BAD})"))
def retry_subset(spark, d):
    return store.to_retry(_plan(spark, d), wide(spark, d)).select("pos", "domain")


@query("plan_limit", f"SELECT * FROM ({_PLAN}) ORDER BY pos LIMIT 100")
def plan_limit(spark, d):
    return _plan(spark, d).orderBy("pos").limit(100)


@query("db_accounting", _scanned(f"SELECT count(*) AS total, count(*) FILTER (WHERE domain NOT IN ({_BAD})) AS analyzable, count(*) FILTER (WHERE domain IN ({_BAD})) AS errors FROM w"))
def db_accounting(spark, d):
    return store.accounting(wide(spark, d))


@query("universe_set_diff", _scanned(f"SELECT 'missing' AS side, domain FROM (SELECT domain FROM ({_PLAN}) EXCEPT ALL SELECT domain FROM w WHERE error = '')"))
def universe_set_diff(spark, d):
    return store.same_universe(_plan(spark, d), wide(spark, d).filter("error = ''"))


@query("duplicate_domains", "SELECT p_brand AS domain, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_domains(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("domain")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("normalize_domains", "SELECT c_custkey AS pos, rtrim(trim(c), '.') AS domain FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' a' || c_custkey || '.ch.. ' ELSE 'B' || c_custkey || '.ch' END AS c FROM customer) WHERE rtrim(trim(c), '.') <> ''")
def normalize_domains(spark, d):
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" a"), key, F.lit(".ch.. "))).otherwise(F.concat(F.lit("B"), key, F.lit(".ch")))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("pos"), F.rtrim(text.trimmed(line), F.lit(".")).alias("domain")).filter("domain <> ''")


@query("upsert_latest_wins", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def upsert_latest_wins(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value", "ts")
    return store.latest(events, "user_id", ["ts", "event_id"]).drop("ts")
