import pytest
from pyspark.sql import functions as F

from mailward.functions import parsers, providers
from mailward import schema
from mailward.operators import metrics, store


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("record,mechanism,count", [
    ("v=spf1 +all -all", "pass", 0), ("v=spf1 -all +all", "hardfail", 0), ("v=spf1 a ~all mx", "softfail", 1), ("v=spf1 redirect=t a -all", "hardfail", 1),
    ("v=spf1 a redirect=t", "none", 2), ("v=spf1 ip4:1.2.3.4 ip6:::1 ?all", "neutral", 0), ("v=spf1 a:x mx:y a/24 -all", "hardfail", 3), ("", "none", 0),
])
def test_spf(spark, record, mechanism, count):
    r = one(spark, record, parsers.spf)
    assert (r.all_mechanism, r.lookup_count, r.near_limit) == (mechanism, count, count >= 8)


def test_dmarc(spark):
    r = one(spark, "v=DMARC1; P=Quarantine; RUA=mailto:one@Reports.Example!10m,mailto:two@example.org; pct=x; p=None", parsers.dmarc)
    assert (r.policy, r.pct, r.has_rua, r.adkim) == ("none", 100, True, "r")
    assert r.rua_domains == ["reports.example", "example.org"]
    assert one(spark, "v=DMARC1; adkim=; pct=5_0", parsers.dmarc)[3] == 50


def test_mx_is_stable_and_drops_the_null_host(spark):
    rows = spark.createDataFrame([(["20 b.", "10 X.ch.", "10 a.ch.", "0 ."],)], "a array<string>")
    assert rows.select(parsers.mx_hosts(F.col("a")).alias("h")).first().h == ["x.ch", "a.ch", "b"]


@pytest.mark.parametrize("hosts,name", [(["mail.halcyon.ch"], "other"), (["mx1.cyon.ch"], "cyon"), (["mx.d.ch", "mx1.cyon.ch"], "self_hosted"), (["x.y", "ASPMX.L.GOOGLE.COM."], "google_workspace"), ([], "other")])
def test_providers(spark, hosts, name):
    rows = spark.createDataFrame([(hosts, "d.ch")], "h array<string>, d string")
    assert rows.select(providers.provider(F.col("h"), F.col("d")).alias("p")).first().p == name


def test_upsert_and_schema(spark):
    base, delta = spark.createDataFrame([("a", 1), ("b", 1)], "domain string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "domain string, v int")
    assert sorted(map(tuple, store.upsert(base, delta).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    with pytest.raises(ValueError):
        schema.canonical(base)


def test_percentages():
    assert metrics.exact_percentage(5, 7).startswith("71.428571") and metrics.exact_percentage(0, 0) == "0"
    assert len(metrics.catalogue()) == 68
