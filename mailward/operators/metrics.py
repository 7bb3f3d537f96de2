"""The catalogue of counted metrics: one aggregate over the results, then one row a metric."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.providers import PROVIDERS

PROVIDER_NAMES = [p for p, _ in PROVIDERS] + ["self_hosted", "other", "unknown"]
SPF_TERMS = ["hardfail", "softfail", "neutral", "pass"]

_POLICY = "coalesce(nullif(dmarc_policy, ''), 'absent')"


def catalogue() -> list[tuple[str, str, str]]:
    """(metric, predicate, denominator), denominators first. All but the population rows hold for analyzable rows."""
    mx, of_mx, of_all = "has_mx AND ", "mx.present", "population.analyzable"
    found = [("domain.exists", "domain_exists", of_all), ("domain.not_exists", "NOT domain_exists", of_all), ("mx.present", "has_mx", of_all), ("mx.absent", "NOT has_mx", of_all)]
    found += [(f"mx.provider.{p}", f"{mx}coalesce(nullif(mx_provider, ''), 'unknown') = '{p}'", of_mx) for p in PROVIDER_NAMES]
    found += [("spf.present", f"{mx}has_spf", of_mx), ("spf.absent", f"{mx}NOT has_spf", of_mx)]
    found += [(f"spf.{t}", f"{mx}has_spf AND spf_all_mechanism = '{t}'", of_mx) for t in SPF_TERMS]
    found += [
        ("spf.no_terminal_mechanism", f"{mx}has_spf AND coalesce(nullif(spf_all_mechanism, ''), 'none') = 'none'", of_mx),
        ("spf.legacy_rrtype99", "has_legacy_spf_rrtype", of_all),
        ("spf.no_mx_present", "NOT has_mx AND has_spf", "mx.absent"),
        ("dkim.selector_observed", f"{mx}has_dkim", of_mx),
        ("dkim.selector_not_observed", f"{mx}NOT has_dkim", of_mx),
        ("dkim.weak_key_heuristic", f"{mx}has_dkim AND dkim_weak_key", "dkim.selector_observed"),
        ("dkim.testing_mode", f"{mx}has_dkim AND dkim_testing_mode", "dkim.selector_observed"),
        ("dmarc.detected", f"{mx}has_dmarc", of_mx),
    ]
    found += [(f"dmarc.{p}", f"{mx}has_dmarc AND dmarc_policy = '{p}'", of_mx) for p in ("reject", "quarantine", "none")]
    found += [
        ("dmarc.genuine_no_record", f"{mx}NOT has_dmarc", of_mx),
        ("dmarc.missing_policy", f"{mx}has_dmarc AND {_POLICY} = 'absent'", of_mx),
        ("dmarc.unsupported_policy", f"{mx}has_dmarc AND {_POLICY} NOT IN ('reject', 'quarantine', 'none', 'absent')", of_mx),
        ("dmarc.no_supported_effective_policy", f"{mx}(NOT has_dmarc OR {_POLICY} NOT IN ('reject', 'quarantine', 'none'))", of_mx),
        ("dmarc.no_detected_enforcement", f"{mx}(NOT has_dmarc OR {_POLICY} NOT IN ('reject', 'quarantine'))", of_mx),
        ("dmarc.detected_all", "has_dmarc", of_all),
        ("dmarc.partial_pct", "has_dmarc AND dmarc_pct >= 0 AND dmarc_pct < 100", "dmarc.detected_all"),
        ("dmarc.invalid_pct", "has_dmarc AND (dmarc_pct < 0 OR dmarc_pct > 100)", "dmarc.detected_all"),
        ("dmarc.strict_alignment", "has_dmarc AND (dmarc_adkim = 's' OR dmarc_aspf = 's')", "dmarc.detected_all"),
        ("dmarc.invalid_alignment", "has_dmarc AND (dmarc_adkim NOT IN ('r', 's') OR dmarc_aspf NOT IN ('r', 's'))", "dmarc.detected_all"),
        ("dmarc.no_mx_detected", "NOT has_mx AND has_dmarc", "mx.absent"),
        ("ds.record_present", "has_ds_record", of_all),
        ("ns.answer_present", "size(ns_hosts) > 0", of_all),
        ("tlsa.record_present", f"{mx}has_tlsa_record", of_mx),
        ("bimi.record_present", f"{mx}has_bimi", of_mx),
        ("mta_sts.txt_present", f"{mx}has_mta_sts", of_mx),
        ("tls_rpt.record_present", f"{mx}has_tlsrpt", of_mx),
        ("caa.record_present", f"{mx}has_caa", of_mx),
        ("mx.unresolvable", f"{mx}mx_unresolvable", of_mx),
    ]
    population = [("population.total", "true", "population.total"), ("population.analyzable", "error = ''", "population.total"), ("population.error", "error <> ''", "population.total")]
    return population + [(m, f"error = '' AND ({p})", d) for m, p, d in found]


def _divided(x: Column, y: Column) -> Column:
    """Whole part of x / y for decimals without fraction, exact."""
    return ((x - x % y) / y).cast("decimal(38,0)")


def display(numerator: Column, denominator: Column) -> Column:
    """Percentage with two places, half up, exact in whole numbers; 0.00 for an empty denominator."""
    n, d = (c.cast("decimal(19,0)") for c in (numerator, F.greatest(denominator, F.lit(1))))
    hundredths = F.when(denominator == 0, F.lit(0)).otherwise(_divided((n * 20000 + d).cast("decimal(26,0)"), (d * 2).cast("decimal(26,0)"))).cast("long")
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def sixteen_places(numerator: Column, denominator: Column) -> Column:
    """Percentage with sixteen decimal places, half up, as text."""
    n, d = (c.cast("decimal(10,0)") for c in (numerator, F.greatest(denominator, F.lit(1))))
    units = F.when(denominator == 0, F.lit(0)).otherwise(_divided((n * F.lit(2 * 10**18).cast("decimal(19,0)") + d).cast("decimal(30,0)"), (d * 2).cast("decimal(30,0)"))).cast("decimal(19,0)")
    return F.concat(F.substring(F.lpad(units.cast("string"), 20, "0"), 1, 4).cast("int").cast("string"), F.lit("."), F.substring(F.lpad(units.cast("string"), 20, "0"), 5, 16))


def exact_percentage(numerator: int, denominator: int) -> str:
    """To 50 significant digits, on the driver: there are as many values as metrics."""
    if numerator < 0 or denominator < 0 or numerator > denominator:
        raise ValueError("a numerator lies between zero and its denominator")
    if not denominator:
        return "0"
    ctx = Context(prec=50)
    return format(ctx.divide(ctx.multiply(Decimal(numerator), Decimal(100)), Decimal(denominator)), "f")


def rounded(percentage: str, places: int) -> str:
    """An exact percentage at a fixed number of places, half up."""
    if places < 0:
        raise ValueError("places must not be negative")
    return format(Decimal(percentage).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP), f".{places}f")


def localised(number: str) -> str:
    return number.replace(".", ",")


def counted(results: DataFrame) -> DataFrame:
    """metric_id, numerator, denominator_id, denominator, percent for the whole catalogue; one scan, one exchange."""
    specs = catalogue()
    totals = results.agg(*[F.count_if(F.expr(p)).alias(m.replace(".", "_")) for m, p, _ in specs])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric_id"), F.col(m.replace(".", "_")).alias("numerator"), F.lit(d).alias("denominator_id"), F.col(d.replace(".", "_")).alias("denominator"))
        for m, _, d in specs
    ])
    return totals.select(F.inline(rows)).withColumn("percent", display(F.col("numerator"), F.col("denominator")))


def recounted(results: DataFrame) -> DataFrame:
    """metric_id, numerator by another path, without the catalogue's predicates: rows name their metrics from their values, and names are counted."""
    def named(prefix, value, known, other=None):
        return F.when(value.isin(known), F.concat(F.lit(prefix), value)).otherwise(F.lit(other))

    mx, ok = F.col("has_mx"), F.col("error") == ""
    policy = F.when(F.col("dmarc_policy").isin("", "absent"), "missing_policy").when(F.col("dmarc_policy").isin("reject", "quarantine", "none"), F.col("dmarc_policy")).otherwise("unsupported_policy")
    held = F.when(~F.col("has_dmarc"), "genuine_no_record").otherwise(policy)
    term = F.when(F.col("spf_all_mechanism").isin("", "none"), "no_terminal_mechanism").otherwise(F.col("spf_all_mechanism"))
    pct = F.col("dmarc_pct")
    strict = F.array_contains(F.array("dmarc_adkim", "dmarc_aspf"), "s")
    odd = F.size(F.array_except(F.array("dmarc_adkim", "dmarc_aspf"), F.array(F.lit("r"), F.lit("s")))) > 0
    of_mail = [
        F.lit("mx.present"), F.concat(F.lit("mx.provider."), F.when(F.col("mx_provider") == "", "unknown").otherwise(F.col("mx_provider"))), F.when(F.col("mx_unresolvable"), "mx.unresolvable"),
        F.when(F.col("has_spf"), "spf.present").otherwise("spf.absent"), F.when(F.col("has_spf"), named("spf.", term, [*SPF_TERMS, "no_terminal_mechanism"])),
        F.when(F.col("has_dkim"), "dkim.selector_observed").otherwise("dkim.selector_not_observed"), F.when(F.col("has_dkim") & F.col("dkim_weak_key"), "dkim.weak_key_heuristic"), F.when(F.col("has_dkim") & F.col("dkim_testing_mode"), "dkim.testing_mode"),
        F.concat(F.lit("dmarc."), held), F.when(held != "genuine_no_record", "dmarc.detected"),
        F.when(held.isin("genuine_no_record", "missing_policy", "unsupported_policy"), "dmarc.no_supported_effective_policy"), F.when(~held.isin("reject", "quarantine"), "dmarc.no_detected_enforcement"),
        *[F.when(F.col(c), m) for c, m in (("has_tlsa_record", "tlsa.record_present"), ("has_bimi", "bimi.record_present"), ("has_mta_sts", "mta_sts.txt_present"), ("has_tlsrpt", "tls_rpt.record_present"), ("has_caa", "caa.record_present"))],
    ]
    without = [F.lit("mx.absent"), F.when(F.col("has_spf"), "spf.no_mx_present"), F.when(F.col("has_dmarc"), "dmarc.no_mx_detected")]
    of_all = [
        F.when(F.col("domain_exists"), "domain.exists").otherwise("domain.not_exists"), F.when(F.col("has_legacy_spf_rrtype"), "spf.legacy_rrtype99"), F.when(F.col("has_ds_record"), "ds.record_present"), F.when(F.array_size("ns_hosts") != 0, "ns.answer_present"),
        *[F.when(F.col("has_dmarc") & test, m) for test, m in ((F.lit(True), "dmarc.detected_all"), (pct.between(0, 99), "dmarc.partial_pct"), (~pct.between(0, 100), "dmarc.invalid_pct"), (strict, "dmarc.strict_alignment"), (odd, "dmarc.invalid_alignment"))],
    ]
    none = F.expr("CAST(array() AS array<string>)")
    mine = F.when(ok, F.concat(F.array(F.lit("population.analyzable"), *of_all), F.when(mx, F.array(*of_mail)).otherwise(F.array(*without)))).otherwise(F.array(F.lit("population.error")))
    seen = results.select(F.explode(F.concat(F.array(F.lit("population.total")), F.array_compact(F.coalesce(mine, none)))).alias("metric_id")).groupBy("metric_id").agg(F.count(F.lit(1)).alias("numerator"))
    every = results.sparkSession.createDataFrame([(m,) for m, _, _ in catalogue()], "metric_id string")
    return every.join(seen, "metric_id", "full_outer").select("metric_id", F.coalesce("numerator", F.lit(0)).alias("numerator"))


# Each side lists the metrics whose sums must agree.
IDENTITIES = {
    "population": (["population.total"], ["population.analyzable", "population.error"]),
    "mx": (["population.analyzable"], ["mx.present", "mx.absent"]),
    "domain": (["population.analyzable"], ["domain.exists", "domain.not_exists"]),
    "provider": (["mx.present"], [f"mx.provider.{p}" for p in PROVIDER_NAMES]),
    "spf_presence": (["mx.present"], ["spf.present", "spf.absent"]),
    "spf_terminal": (["spf.present"], [*[f"spf.{t}" for t in SPF_TERMS], "spf.no_terminal_mechanism"]),
    "dkim": (["mx.present"], ["dkim.selector_observed", "dkim.selector_not_observed"]),
    "dmarc_policy": (["dmarc.detected"], ["dmarc.reject", "dmarc.quarantine", "dmarc.none", "dmarc.missing_policy", "dmarc.unsupported_policy"]),
    "dmarc_detection": (["mx.present"], ["dmarc.detected", "dmarc.genuine_no_record"]),
    "no_supported": (["dmarc.no_supported_effective_policy"], ["dmarc.genuine_no_record", "dmarc.missing_policy", "dmarc.unsupported_policy"]),
    "no_enforcement": (["dmarc.no_detected_enforcement"], ["dmarc.no_supported_effective_policy", "dmarc.none"]),
}


def reconciled(metrics: DataFrame) -> DataFrame:
    """identity, left_sum, right_sum, holds for each identity."""
    def total(ids):
        return F.coalesce(F.sum(F.when(F.col("metric_id").isin(ids), F.col("numerator"))), F.lit(0))

    sums = metrics.agg(*[total(side).alias(f"{k}_{i}") for k, pair in IDENTITIES.items() for i, side in enumerate(pair)])
    rows = [F.struct(F.lit(k).alias("identity"), F.col(f"{k}_0").alias("left_sum"), F.col(f"{k}_1").alias("right_sum")) for k in IDENTITIES]
    return sums.select(F.inline(F.array(*rows))).withColumn("holds", F.col("left_sum") == F.col("right_sum"))


def accounting_of(metrics: DataFrame) -> DataFrame:
    """total, analyzable and error of the population metrics, in one row."""
    def one(name):
        return F.max(F.when(F.col("metric_id") == f"population.{name}", F.col("numerator"))).alias(name)

    return metrics.agg(*[one(n) for n in ("total", "analyzable", "error")])


# Figures, their metrics in order and the denominators that these must have.
FIGURES = {
    "mail-authentication-overview": (["mx.present", "spf.present", "dkim.selector_observed", "dmarc.detected"], ["population.analyzable", "mx.present", "mx.present", "mx.present"]),
    "dmarc-policy-observations": (["dmarc.reject", "dmarc.quarantine", "dmarc.none", "dmarc.no_supported_effective_policy"], ["mx.present"] * 4),
    "dns-transport-signals": (["tlsa.record_present", "bimi.record_present", "mta_sts.txt_present", "tls_rpt.record_present"], ["mx.present"] * 4),
    "mx-provider-fingerprints": ([f"mx.provider.{p}" for p in ("hostpoint", "infomaniak", "microsoft365", "google_workspace", "self_hosted", "other", "unknown")], ["mx.present"] * 7),
    "social-report-card": (["mx.present", "spf.present", "dkim.selector_observed", "dmarc.detected"], ["population.analyzable", "mx.present", "mx.present", "mx.present"]),
}
LOCALES = ("de", "fr", "it")


def figure_rows(metrics: DataFrame) -> DataFrame:
    """figure, place, metric_id, numerator, denominator, percent and whether the denominator is the figure's, in the order of places."""
    specs = [(k, i, m, d) for k, (ids, dens) in FIGURES.items() for i, (m, d) in enumerate(zip(ids, dens, strict=True))]
    wanted = metrics.sparkSession.createDataFrame(specs, "figure string, place int, metric_id string, wanted string")
    return wanted.join(metrics, "metric_id").select("figure", "place", "metric_id", "numerator", "denominator", "percent", (F.col("denominator_id") == F.col("wanted")).alias("denominator_fits")).orderBy("figure", "place")


def labels(spark, given: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """locale, metric_id, label; without given labels, each metric is called by its id's last part."""
    rows = [(x, m, (given or {}).get(x, {}).get(m, m.rsplit(".", 1)[1].replace("_", " ")) if given is None else given.get(x, {}).get(m)) for x in LOCALES for m, _, _ in catalogue()]
    return spark.createDataFrame([r for r in rows if r[2] is not None], "locale string, metric_id string, label string")


def missing_labels(spark, labelled: DataFrame) -> DataFrame:
    """locale and metric_id of the catalogue that have no label."""
    every = spark.createDataFrame([(x, m) for x in LOCALES for m, _, _ in catalogue()], "locale string, metric_id string")
    return every.join(labelled, ["locale", "metric_id"], "left_anti")


def _report_lines() -> list[tuple[str, str, Column, str]]:
    ok, mx = F.col("error") == "", (F.col("error") == "") & F.col("has_mx")

    def held(value, column):
        return mx & (F.col(column) == value)

    lines = [("population", "total rows", F.lit(True), "total"), ("population", "errored", ~ok, "total"), ("population", "analyzable", ok, "total"), ("population", "mx present", mx, "analyzable"), ("dns", "ds record", ok & F.col("has_ds_record"), "analyzable"), ("spf", "has spf", mx & F.col("has_spf"), "mx")]
    lines += [("spf", f"all={t}", held(t, "spf_all_mechanism"), "mx") for t in (*SPF_TERMS, "none")]
    lines += [("spf", "near limit", mx & F.col("spf_near_limit"), "mx"), ("dkim", "selector observed", mx & F.col("has_dkim"), "mx"), ("dkim", "weak key", mx & F.col("dkim_weak_key"), "mx"), ("dmarc", "has dmarc", mx & F.col("has_dmarc"), "mx")]
    lines += [("dmarc", f"policy={p}", held(p, "dmarc_policy"), "mx") for p in ("reject", "quarantine", "none", "absent")]
    lines += [("dmarc", "absent or monitoring only", held("absent", "dmarc_policy") | held("none", "dmarc_policy"), "mx")]
    return lines + [("transport", label, mx & F.col(c), "mx") for label, c in (("bimi", "has_bimi"), ("mta-sts", "has_mta_sts"), ("tls-rpt", "has_tlsrpt"), ("caa", "has_caa"), ("tlsa", "has_tlsa_record"))]


def report(results: DataFrame) -> DataFrame:
    """ord, section, label, n and percent (one place) of the descriptive report; null where nothing is to be shared out."""
    lines = _report_lines()
    bases = {"total": F.count(F.lit(1)), "analyzable": F.count_if(F.col("error") == ""), "mx": F.count_if((F.col("error") == "") & F.col("has_mx"))}
    sums = results.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, _, c, _) in enumerate(lines)], *[v.alias(k) for k, v in bases.items()])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("section"), F.lit(t).alias("label"), F.col(f"n{i}").alias("n"), F.col(b).alias("base")) for i, (s, t, _, b) in enumerate(lines)])
    share = F.round(F.col("n").cast("decimal(18,0)") * 100 / F.nullif(F.col("base"), F.lit(0)).cast("decimal(18,0)"), 1).cast("double")
    return sums.select(F.inline(rows)).select("ord", "section", "label", "n", share.alias("percent"))
