import pytest
from pyspark.sql import functions as F

from mailward.operators import scan

A, Q = "a.ch", ("DS", "NS", "TXT", "SPF")


def answer_rows(domain, mx, more):
    """Recorded answers of one domain: noanswer for whatever a scan asks, unless given."""
    rows = {(domain, "MX"): mx} | {(domain, t): ("noanswer", []) for t in (*Q, "CAA")} | {(f"{p}{domain}", "TXT"): ("noanswer", []) for p in ("_dmarc.", "default._bimi.", "_mta-sts.", "_smtp._tls.")}
    rows |= {(f"{s}._domainkey.{domain}", "TXT"): ("noanswer", []) for s in ("default", "selector1", "selector2", "google", "k1", "s1", "s2", "mail", "dkim", "smtp", "key1", "mx")}
    for a in mx[1]:
        host = a.split()[-1].rstrip(".").lower()
        rows |= {(host, "A"): ("ok", ["192.0.2.1"]), (host, "AAAA"): ("noanswer", []), (f"_25._tcp.{host}", "TLSA"): ("noanswer", [])}
    return rows | more


def run(spark, cases):
    """Results by domain of {domain: (mx, more answers)}."""
    rows = [(n, t, *r) for d, (mx, more) in cases.items() for (n, t), r in answer_rows(d, mx, more).items() if r is not None]
    answers = spark.createDataFrame(rows, "name string, rdtype string, status string, answers array<string>").dropDuplicates(["name", "rdtype"])
    plan = spark.createDataFrame([(d,) for d in cases], "domain string")
    return {r.domain: r for r in scan.scanned(plan, answers).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    mail = ("ok", ["10 mx1.own.example."])
    return run(spark, {
        "gone.ch": (("nxdomain", []), {}),
        "failed.ch": (("error", []), {}),
        "nomail.ch": (("noanswer", []), {("nomail.ch", "TXT"): ("ok", ["x", "v=spf1 -all", "v=spf1 +all"]), ("nomail.ch", "SPF"): ("ok", ["v=spf1 -all"])}),
        "null.ch": (("ok", ["0 ."]), {}),
        "order.ch": (("ok", ["20 b.order.ch.", "10 Z.order.ch.", "10 a.order.ch."]), {("b.order.ch", "A"): ("nxdomain", []), ("z.order.ch", "A"): ("noanswer", []), ("z.order.ch", "AAAA"): ("ok", ["2001:db8::1"]), ("a.order.ch", "A"): ("ok", []), ("a.order.ch", "AAAA"): ("noanswer", [])}),
        "erra.ch": (("ok", ["10 h.erra.ch."]), {("h.erra.ch", "A"): ("error", [])}),
        "erraaaa.ch": (("ok", ["10 h.erraaaa.ch."]), {("h.erraaaa.ch", "A"): ("noanswer", []), ("h.erraaaa.ch", "AAAA"): ("error", [])}),
        "odd.ch": (mail, {("odd.ch", "DS"): ("strange", ["1"]), ("odd.ch", "NS"): None, ("odd.ch", "CAA"): ("ok", None)}),
        "broken.ch": (("ok", ["mail.broken.ch."]), {}),
        "twice.ch": (("ok", ["5 h.twice.ch.", "9 h.twice.ch."]), {("_25._tcp.h.twice.ch", "TLSA"): ("error", [])}),
        "full.ch": (("ok", ["1 aspmx.l.google.com."]), {
            ("full.ch", "DS"): ("ok", ["1 2 3"]), ("full.ch", "NS"): ("ok", ["NS2.full.ch.", "ns1.full.ch."]), ("_dmarc.full.ch", "TXT"): ("ok", ["other", "v=DMARC1; p=reject; pct=50; rua=mailto:a@x.ch"]),
            ("google._domainkey.full.ch", "TXT"): ("ok", ["v=DKIM1; p=", "v=DKIM1; p=AAAA; t=Y"]), ("default._bimi.full.ch", "TXT"): ("ok", ["v=BIMI1; l=x"]), ("_mta-sts.full.ch", "TXT"): ("ok", ["v=STSv1; id=1"]),
            ("_smtp._tls.full.ch", "TXT"): ("ok", ["v=TLSRPTv1; rua=mailto:t@x.ch"]), ("full.ch", "CAA"): ("ok", ["0 issue x"]), ("_25._tcp.aspmx.l.google.com", "TLSA"): ("ok", ["3 1 1 AB"]),
        }),
    })


def test_gate(rows):
    assert (rows["gone.ch"].domain_exists, rows["gone.ch"].error, rows["gone.ch"].dmarc_policy, rows["gone.ch"].query_statuses) == (False, "", "", {"MX gone.ch": "nxdomain"})
    assert (rows["failed.ch"].domain_exists, rows["failed.ch"].error) == (True, "mx_query_error")
    assert (rows["nomail.ch"].has_mx, rows["nomail.ch"].spf_all_mechanism, rows["nomail.ch"].has_legacy_spf_rrtype, rows["nomail.ch"].dmarc_policy, rows["nomail.ch"].dkim_selectors_checked) == (False, "hardfail", True, "absent", [])
    assert (rows["null.ch"].has_mx, rows["null.ch"].mx_provider) == (False, "")


def test_hosts_and_addresses(rows):
    r = rows["order.ch"]
    assert (r.mx_hosts, r.mx_provider) == (["z.order.ch", "a.order.ch", "b.order.ch"], "self_hosted")
    assert r.mx_hosts_unresolvable == ["a.order.ch", "b.order.ch"] and "AAAA b.order.ch" not in r.query_statuses
    assert rows["erra.ch"].mx_hosts_unresolvable == [] and rows["erra.ch"].error == "query_errors: A h.erra.ch" and "AAAA h.erra.ch" not in rows["erra.ch"].query_statuses
    assert rows["erraaaa.ch"].mx_hosts_unresolvable == [] and rows["erraaaa.ch"].error == "query_errors: AAAA h.erraaaa.ch"


def test_errors(rows):
    assert rows["odd.ch"].error == "query_errors: DS odd.ch, NS odd.ch, CAA odd.ch"
    assert rows["broken.ch"].error.startswith("scan_exception: ") and rows["broken.ch"].query_statuses == {} and rows["broken.ch"].domain_exists and not rows["broken.ch"].has_mx
    assert rows["twice.ch"].error == "query_errors: TLSA _25._tcp.h.twice.ch, TLSA _25._tcp.h.twice.ch"


def test_everything_present(rows):
    r = rows["full.ch"]
    assert (r.mx_provider, r.dkim_selectors_checked, r.dkim_selectors_found, r.dkim_testing_mode, r.dkim_weak_key) == ("google_workspace", ["google"], ["google"], True, True)
    assert (r.dmarc_policy, r.dmarc_pct, r.dmarc_rua_domains, r.has_ds_record, r.ns_hosts) == ("reject", 50, ["x.ch"], True, ["ns1.full.ch", "ns2.full.ch"])
    assert (r.has_bimi, r.has_mta_sts, r.has_tlsrpt, r.has_caa, r.has_tlsa_record, r.tlsa_hosts_found, r.error) == (True, True, True, True, True, ["aspmx.l.google.com"], "")


def test_no_domains(spark):
    answers = spark.createDataFrame([], "name string, rdtype string, status string, answers array<string>")
    assert scan.scanned(spark.createDataFrame([], "domain string"), answers).count() == 0
    assert [r.error for r in scan.scanned(spark.range(1).select(F.lit(A).alias("domain")), answers).collect()] == ["mx_query_error"]
