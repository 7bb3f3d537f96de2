"""Parsers of mail-security records as native expressions, one struct for each record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, tag, tags, tokens, trimmed

# Fixed values.
ALL_TERMS = {"-all": "hardfail", "~all": "softfail", "?all": "neutral", "+all": "pass", "all": "pass"}
LOOKUP_TERMS = r"^(?:(?:a|mx|ptr)$|include:|exists:|redirect=|a[:/]|mx[:/]|ptr:)"
NEAR_LIMIT = 8
WEAK_KEY_CHARS = 250
CLASSES = {"dmarc": "v=dmarc1", "bimi": "v=bimi1", "mta_sts": "v=stsv1", "tlsrpt": "v=tlsrptv1"}


def is_spf(c: Column) -> Column:
    return F.startswith(F.lower(trimmed(c)), F.lit("v=spf1"))


def is_kind(c: Column, kind: str) -> Column:
    return F.startswith(compact(c), F.lit(CLASSES[kind]))


def is_dkim(c: Column) -> Column:
    return F.coalesce(tag(tags(c), "p"), F.lit("")) != ""


def _term_name(term: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in ALL_TERMS.items():
        out = F.when(term == k, v).otherwise(out)
    return out


def spf(record: Column, first_wins: bool = True) -> Column:
    """all_mechanism, lookup_count, near_limit. first_wins: the current rule; else the historical one."""
    words = F.transform(tokens(record), lambda t: F.lower(t))
    terms = F.filter(F.transform(words, _term_name), lambda t: t.isNotNull())
    ends = F.filter(F.transform(words, lambda t, i: F.when(_term_name(t).isNotNull(), i)), lambda i: i.isNotNull())
    scanned = F.slice(words, 1, F.coalesce(F.array_min(ends), F.size(words))) if first_wins else words
    costs = F.transform(F.filter(scanned, lambda t: _term_name(t).isNull()), lambda t: F.regexp_replace(t, r"^[+\-~?]", ""))
    redirected = F.size(ends) > 0 if first_wins else F.lit(False)
    count = F.size(F.filter(costs, lambda t: F.rlike(t, F.lit(LOOKUP_TERMS)) & ~(F.startswith(t, F.lit("redirect=")) & redirected)))
    return F.struct(
        F.coalesce(F.try_element_at(terms, F.lit(1 if first_wins else -1)), F.lit("none")).alias("all_mechanism"),
        count.alias("lookup_count"),
        (count >= NEAR_LIMIT).alias("near_limit"),
    )


def report_domains(value: Column) -> Column:
    """Domains of a list of report addresses, in order, repeats kept."""
    uris = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda u: F.substring_index(trimmed(u), "!", 1))

    def domain(u):
        mail = F.lower(F.substring(u, 1, 7)) == "mailto:"
        address = F.substring(u, 8, 2**31 - 1)
        host = F.substring_index(F.split(u, "://", 2)[1], "/", 1)
        return F.when(mail, F.when(F.contains(address, F.lit("@")), F.lower(F.substring_index(address, "@", -1)))).when(F.contains(u, F.lit("://")), F.nullif(F.lower(host), F.lit("")))

    return F.array_compact(F.transform(uris, domain))


def dmarc(record: Column) -> Column:
    """policy, has_rua, has_ruf, pct, sp, adkim, aspf, rua_domains, ruf_domains. A pct beyond a long counts as 100."""
    def fields(t):
        def text(key, default=""):
            return F.lower(F.coalesce(tag(t, key), F.lit(default)))

        pct = tag(t, "pct")
        return F.struct(
            F.coalesce(F.nullif(text("p"), F.lit("")), F.lit("absent")).alias("policy"),
            (F.coalesce(tag(t, "rua"), F.lit("")) != "").alias("has_rua"),
            (F.coalesce(tag(t, "ruf"), F.lit("")) != "").alias("has_ruf"),
            F.coalesce(F.when(F.rlike(pct, F.lit(r"^[+-]?[0-9]+(_[0-9]+)*$")), F.replace(pct, F.lit("_"), F.lit("")).try_cast("long")), F.lit(100)).cast("long").alias("pct"),
            text("sp").alias("sp"),
            text("adkim", "r").alias("adkim"),
            text("aspf", "r").alias("aspf"),
            report_domains(tag(t, "rua")).alias("rua_domains"),
            report_domains(tag(t, "ruf")).alias("ruf_domains"),
        )

    # The tags are a lambda's variable, so they are split once for all fields.
    return F.get(F.transform(F.array(tags(record)), fields), F.lit(0))


def dkim(record: Column, candidate: bool = False) -> Column:
    """testing_mode and weak_key. candidate: short keys count for RSA only, and flags are a list."""
    t = tags(record)
    key = F.coalesce(tag(t, "p"), F.lit(""))
    flags = F.lower(F.coalesce(tag(t, "t"), F.lit("")))
    weak = F.length(key).between(1, WEAK_KEY_CHARS - 1)
    if candidate:
        weak = weak & (F.lower(F.coalesce(tag(t, "k"), F.lit("rsa"))) == "rsa")
        testing = F.array_contains(F.split(flags, r"\s*:\s*"), "y")
    else:
        testing = flags == "y"
    return F.struct(testing.alias("testing_mode"), weak.alias("weak_key"))


def mx_answers(answers: Column) -> Column:
    """array<struct<pref,idx,host>> in stable order of preference; null pref marks a malformed answer."""
    def one(a, i):
        parts = F.split(trimmed(a), r"(?U)\s+", 2)
        return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("pref"), i.alias("idx"), F.lower(F.rtrim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("."))).alias("host"))

    return F.array_sort(F.transform(answers, one))


def mx_hosts(answers: Column) -> Column:
    """Hosts in priority order without the null host."""
    return F.transform(F.filter(mx_answers(answers), lambda m: m["host"] != ""), lambda m: m["host"])
