"""From planned domains and recorded or live DNS answers to one result row a domain.

Two joins with the answers: the first asks for MX, which decides what else is asked; the second asks for
all the rest at once. What the first one found travels with a domain's queries in one row of its own, so the
gate is computed once. A group has one row for each query of a domain, so it stays small.
AAAA is joined for every mail host and counts only where A fell through. Both sides of a join and the groups are
dealt to as many tasks as the planned domains ask for (parts), and neither side is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers, providers
from ..functions.text import first_match
from ..schema import ALL, COLUMNS, default
from .tasks import tasks_for

# The states of a lookup, and the names asked for beside the domain itself.
STATUSES = ("ok", "nxdomain", "noanswer", "error")
GROUP_A = (("DS", ""), ("NS", ""), ("TXT", ""), ("SPF", ""), ("TXT", "_dmarc."))
GROUP_C = (("TXT", "default._bimi."), ("TXT", "_mta-sts."), ("TXT", "_smtp._tls."), ("CAA", ""))
TLSA_PREFIX = "_25._tcp."
EMPTY = "CAST(array() AS array<string>)"
#: Questions that a domain asks at most, about.
ASKED = 30

_QUERY = "struct<stage:int,idx:int,rdtype:string,name:string,item:string>"


def _asked(stage: int, idx: Column, rdtype: str, name: Column, item: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), idx.cast("int").alias("idx"), F.lit(rdtype).alias("rdtype"), name.alias("name"), item.alias("item"))


def group_a(domain: Column) -> Column:
    return F.array(*[_asked(1, F.lit(i), t, F.concat(F.lit(p), domain), F.lit(p)) for i, (t, p) in enumerate(GROUP_A)])


def mail_queries(domain: Column, hosts: Column, selectors: Column) -> Column:
    """Address, DKIM, transport and TLSA queries of a domain with mail hosts."""
    def addresses(rdtype):
        return F.transform(hosts, lambda h, i: _asked(2, i, rdtype, h, h))

    keys = F.transform(selectors, lambda s, i: _asked(3, i, "TXT", F.concat(s, F.lit("._domainkey."), domain), s))
    signals = F.array(*[_asked(4, F.lit(i), t, F.concat(F.lit(p), domain), F.lit(p)) for i, (t, p) in enumerate(GROUP_C)])
    tlsa = F.transform(hosts, lambda h, i: _asked(5, i, "TLSA", F.concat(F.lit(TLSA_PREFIX), h), h))
    return F.concat(addresses("A"), addresses("AAAA"), keys, signals, tlsa)


def unique_answers(answers: DataFrame) -> DataFrame:
    """One response for each name and type: a missing or malformed one is an error, and so are several that differ."""
    sound = F.coalesce(F.col("status").isin(*STATUSES) & F.col("answers").isNotNull(), F.lit(False))
    response = F.when(sound, F.struct("status", "answers")).otherwise(F.struct(F.lit("error").alias("status"), F.expr(EMPTY).alias("answers")))
    known = answers.select("name", "rdtype", response.alias("r")).groupBy("name", "rdtype").agg(F.min("r").alias("r"), F.max("r").alias("other"))
    agreed = F.col("r") == F.col("other")
    return known.select("name", "rdtype", F.when(agreed, F.col("r.status")).otherwise("error").alias("status"), F.when(agreed, F.col("r.answers")).otherwise(F.expr(EMPTY)).alias("answers"))


def parts_of(plan: DataFrame) -> int:
    """Tasks for the questions of the planned domains."""
    return tasks_for(plan.sparkSession, plan.count() * ASKED)


def looked_up(asked: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """asked(name, rdtype, ...) with status and answers; a missing response is an error."""
    keys = ["name", "rdtype"]
    found = asked.repartition(parts, *keys).join(unique_answers(answers.repartition(parts, *keys)).hint("merge"), keys, "left")
    return found.withColumns({"status": F.coalesce("status", F.lit("error")), "answers": F.coalesce("answers", F.expr(EMPTY))})


def gated(plan: DataFrame, answers: DataFrame, parts: int | None = None) -> DataFrame:
    """domain, mx_status, malformed, goes_on, hosts, provider after the MX lookup of each domain of plan, once."""
    parts = parts or parts_of(plan)
    asked = plan.select("domain").distinct().select("domain", F.col("domain").alias("name"), F.lit("MX").alias("rdtype"))
    found = looked_up(asked, answers.filter("rdtype = 'MX'"), parts)
    parsed = F.when(F.col("status") == "ok", parsers.mx_answers("answers")).otherwise(parsers.mx_answers(F.expr(EMPTY)))
    read = found.select("domain", F.col("status").alias("mx_status"), parsed.alias("mx"))
    stops = F.col("mx_status").isin("nxdomain", "error")
    read = read.select("domain", "mx_status", F.exists("mx", lambda m: m["pref"].isNull()).alias("malformed"), F.transform(F.filter("mx", lambda m: m["host"] != ""), lambda m: m["host"]).alias("hosts"), (~stops).alias("goes_on"))
    named = F.when(F.size("hosts") > 0, providers.provider(F.col("hosts"), F.col("domain"))).otherwise("")
    return read.select("domain", "mx_status", "malformed", "goes_on", "hosts", named.alias("provider"))


_NONE = f"CAST(array() AS array<{_QUERY}>)"


def _queries() -> Column:
    """What is asked of a row of gated(); nothing where the gate stops."""
    d, hosts = F.col("domain"), F.col("hosts")
    mail = F.when(F.size(hosts) > 0, mail_queries(d, hosts, providers.selectors(F.col("provider")))).otherwise(F.expr(_NONE))
    return F.when(F.col("goes_on") & ~F.col("malformed"), F.concat(group_a(d), mail)).otherwise(F.expr(_NONE))


def planned(gates: DataFrame) -> DataFrame:
    """domain, stage, idx, rdtype, name, item of each query after the gate."""
    return gates.select("domain", F.inline(_queries()))


_GATE = ("mx_status", "malformed", "goes_on", "hosts", "provider")


def observed(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """gated() with got, the ordered responses array<struct<stage,idx,rdtype,name,item,status,answers>>, empty where the gate stops.

    got leaves out the AAAA of hosts whose A had settled the matter.
    """
    parts = parts_of(plan)
    gates = gated(plan, answers, parts)
    own = _asked(0, F.lit(0), "MX", F.col("domain"), F.lit(""))
    rows = gates.select("domain", F.struct(*_GATE).alias("gate"), F.inline(F.concat(F.array(own), _queries())))
    rows = looked_up(rows.withColumn("gate", F.when(F.col("stage") == 0, F.col("gate"))), answers, parts)
    fields = F.struct("stage", "idx", "rdtype", "name", "item", "status", "answers", "gate")
    whole = rows.repartition(parts, "domain").groupBy("domain").agg(F.array_sort(F.collect_list(fields)).alias("all_got"))
    split = whole.select("domain", F.expr("get(all_got, 0).gate AS gate"), F.expr("slice(all_got, 2, size(all_got)) AS all_got"))
    # Hosts whose A is neither an address nor a final answer are those whose AAAA counts.
    open_hosts = "transform(filter(all_got, q -> q.rdtype = 'A' AND (q.status = 'noanswer' OR (q.status = 'ok' AND size(q.answers) = 0))), q -> q.idx)"
    kept = "filter(all_got, q -> q.rdtype <> 'AAAA' OR array_contains(open_hosts, q.idx))"
    return split.withColumn("open_hosts", F.expr(open_hosts)).select("domain", "gate.*", F.expr(kept).alias("got"))


#: The responses that a domain has one of, by stage and place.
ONES = "map_from_entries(transform(filter(got, q -> q.stage IN (1, 4)), q -> struct(q.stage * 10 + q.idx AS key, IF(q.status = 'ok', q.answers, array()) AS value)))"


def _answers(stage: int, idx: int) -> Column:
    """The answers of one query, from the column ones; empty unless its status is ok."""
    return F.expr(f"coalesce(ones[{stage * 10 + idx}], {EMPTY})")


def _first(stage: int, idx: int, kind: str) -> Column:
    return first_match(_answers(stage, idx), lambda r: parsers.is_kind(r, kind))


def _once(value: Column, build) -> Column:
    """build(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: build(x)), F.lit(0))


#: Hosts without an address, in order: nxdomain on A, or nothing on both; an error decides nothing.
DANGLING = """transform(filter(got, q -> (q.rdtype = 'A' AND q.status = 'nxdomain') OR (q.rdtype = 'AAAA' AND q.status <> 'error' AND NOT (q.status = 'ok' AND size(q.answers) > 0))), q -> q.item)"""
#: Keys of the failed queries in the order asked, repeats kept.
FAILED = f"""concat(IF(mx_status = 'error', array(concat('MX ', domain)), {EMPTY}), transform(filter(got, q -> q.status = 'error'), q -> concat(q.rdtype, ' ', q.name)))"""


def signed() -> Column:
    """array<struct<item,info>> of the selectors that answer with a key, in the order asked."""
    asked = F.expr("filter(got, q -> q.stage = 3 AND q.status = 'ok')")
    keys = F.transform(asked, lambda q: F.struct(q["item"].alias("item"), first_match(q["answers"], parsers.is_dkim).alias("record")))
    return F.transform(F.filter(keys, lambda k: k["record"].isNotNull()), lambda k: F.struct(k["item"].alias("item"), parsers.dkim(k["record"]).alias("info")))


def error_text(domain: Column, keys: Column) -> Column:
    alone = (F.size(keys) == 1) & (F.get(keys, F.lit(0)) == F.concat(F.lit("MX "), domain))
    return F.when(F.size(keys) == 0, "").when(alone, "mx_query_error").otherwise(F.concat(F.lit("query_errors: "), F.array_join(keys, ", ")))


def scanned(plan: DataFrame, answers: DataFrame, scanned_at: str = "2026-01-01 00:00:00") -> DataFrame:
    """One result of 45 columns for each domain of plan(domain), once, from answers(name, rdtype, status, answers).

    Several answers to one question count once if they are equal and as an error if they differ.

    A malformed MX answer gives an error row with defaults, as any failure of a domain's own does.
    """
    rows = observed(plan, answers).withColumn("ones", F.expr(ONES)).withColumns({
        "spf": first_match(_answers(1, 2), parsers.is_spf),
        "dmarc": _first(1, 4, "dmarc"),
        **{k: _first(4, i, k) for i, k in enumerate(("bimi", "mta_sts", "tlsrpt"))},
        "caa": _answers(4, 3), "keys": signed(), "dead": F.expr(DANGLING), "fails": F.expr(FAILED), "hosts_tls": F.expr("filter(got, q -> q.stage = 5)"),
    })
    rows = rows.withColumn("spf_parts", F.when(F.col("spf").isNotNull(), _once(F.col("spf"), parsers.spf))).withColumn("dmarc_parts", F.when(F.col("dmarc").isNotNull(), _once(F.col("dmarc"), parsers.dmarc)))
    mail, sound = F.size("hosts") > 0, ~F.col("malformed")
    statuses = "map_from_entries(array_distinct(concat(array(struct(concat('MX ', domain) AS key, mx_status AS value)), transform(got, q -> struct(concat(q.rdtype, ' ', q.name) AS key, q.status AS value)))))"
    tlsa = "transform(filter(hosts_tls, q -> q.status = 'ok' AND size(q.answers) > 0), q -> q.item)"
    values = {
        "domain_exists": F.col("mx_status") != "nxdomain", "has_mx": mail, "mx_hosts": F.col("hosts"), "mx_provider": F.col("provider"),
        "has_spf": F.col("spf").isNotNull(), "spf_record": F.col("spf"), "spf_all_mechanism": F.col("spf_parts.all_mechanism"), "spf_lookup_count": F.col("spf_parts.lookup_count"), "spf_near_limit": F.col("spf_parts.near_limit"),
        "has_legacy_spf_rrtype": F.size(_answers(1, 3)) > 0,
        "dkim_selectors_checked": F.when(mail, providers.selectors(F.col("provider"))), "dkim_selectors_found": F.expr("transform(keys, k -> k.item)"), "has_dkim": F.size("keys") > 0,
        "dkim_testing_mode": F.expr("exists(keys, k -> k.info.testing_mode)"), "dkim_weak_key": F.expr("exists(keys, k -> k.info.weak_key)"),
        "has_dmarc": F.col("dmarc").isNotNull(), "dmarc_record": F.col("dmarc"), "dmarc_policy": F.coalesce("dmarc_parts.policy", F.when(F.col("goes_on"), "absent")),
        "dmarc_rua": F.col("dmarc_parts.has_rua"), "dmarc_ruf": F.col("dmarc_parts.has_ruf"), **{f"dmarc_{c}": F.col(f"dmarc_parts.{c}") for c in ("pct", "sp", "adkim", "aspf", "rua_domains", "ruf_domains")},
        "has_ds_record": F.size(_answers(1, 0)) > 0, "ns_hosts": F.array_sort(F.transform(_answers(1, 1), lambda h: F.lower(F.rtrim(h, F.lit("."))))),
        "mx_hosts_unresolvable": F.col("dead"), "mx_unresolvable": F.size("dead") > 0,
        **{f"has_{k}": F.col(k).isNotNull() for k in ("bimi", "mta_sts", "tlsrpt")}, **{f"{k}_record": F.col(k) for k in ("bimi", "mta_sts", "tlsrpt")},
        "has_caa": F.size("caa") > 0, "caa_records": F.col("caa"),
        "has_tlsa_record": F.expr(f"size({tlsa}) > 0"), "tlsa_hosts_checked": F.expr("transform(hosts_tls, q -> q.item)"), "tlsa_hosts_found": F.expr(tlsa),
        "query_statuses": F.expr(statuses), "error": error_text(F.col("domain"), F.col("fails")),
    }
    broken = {"error": F.concat(F.lit("scan_exception: malformed MX answer of "), "domain")}

    def column(name: str) -> Column:
        if name == "domain":
            return F.col(name)
        if name == "scanned_at":
            return F.lit(scanned_at).cast("timestamp").alias(name)
        return F.coalesce(F.when(sound, values[name]), broken.get(name, F.expr(default(name)))).cast(COLUMNS[name]).alias(name)

    return rows.select(*[column(c) for c in ALL])


def scanned_live(plan: DataFrame, ask, scanned_at: str = "2026-01-01 00:00:00") -> DataFrame:
    """scanned() with answers from ask(asked DataFrame of name and rdtype), in three rounds: MX, all the rest but AAAA, AAAA where A fell through."""
    mail = ask(plan.select(F.col("domain").alias("name"), F.lit("MX").alias("rdtype")))
    queries = planned(gated(plan, mail))
    rest = ask(queries.filter("rdtype <> 'AAAA'").select("name", "rdtype"))
    fell = unique_answers(rest).filter("rdtype = 'A' AND (status = 'noanswer' OR (status = 'ok' AND size(answers) = 0))")
    last = ask(fell.select("name", F.lit("AAAA").alias("rdtype")))
    return scanned(plan, mail.unionByName(rest).unionByName(last), scanned_at)
