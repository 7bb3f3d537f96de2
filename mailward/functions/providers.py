"""Mail providers: a small dimension, looked up by every dot-bounded suffix of a host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider and host suffixes, in order of precedence.
PROVIDERS = [
    ("microsoft365", ["mail.protection.outlook.com"]),
    ("google_workspace", ["aspmx.l.google.com", "aspmx2.googlemail.com", "aspmx3.googlemail.com", "aspmx4.googlemail.com", "aspmx5.googlemail.com",
                          "alt1.aspmx.l.google.com", "alt2.aspmx.l.google.com", "alt3.aspmx.l.google.com", "alt4.aspmx.l.google.com", "smtp.google.com"]),
    ("hostpoint", ["hostpoint.ch"]),
    ("infomaniak", ["infomaniak.ch", "infomaniak.com"]),
    ("cyon", ["cyon.ch", "cyon.net"]),
    ("swisscom", ["swisscom.ch", "bluewin.ch"]),
    ("init7", ["init7.net"]),
    ("greench", ["green.ch"]),
    ("vtx", ["vtxmail.ch", "vtxnet.ch", "vtx.ch"]),
    ("metanet", ["metanet.ch"]),
    ("protonmail", ["protonmail.ch", "proton.me"]),
    ("mailbox_org", ["mailbox.org"]),
    ("gmx", ["gmx.net", "gmx.ch"]),
    ("ovh", ["mx.ovh.net", "mx.ovh.com", "mx.ovh.ca"]),
    ("mimecast", ["mimecast.com"]),
    ("proofpoint", ["pphosted.com"]),
    ("barracuda", ["barracudanetworks.com"]),
    ("swizzonic", ["swizzonic.ch", "swizzonic.email"]),
    ("netzone", ["netzone.ch"]),
    ("iway", ["iway.ch"]),
    ("hosttech", ["hosttech.ch", "hosttech.eu"]),
    ("tophost", ["tophost.ch"]),
]
# Selectors asked for, by provider and for all others.
SELECTORS = {"microsoft365": ["selector1", "selector2"], "google_workspace": ["google"]}
COMMON_SELECTORS = ["default", "selector1", "selector2", "google", "k1", "s1", "s2", "mail", "dkim", "smtp", "key1", "mx"]


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def provider(hosts: Column, domain: Column) -> Column:
    """The provider of the first host that belongs to one, or to the domain itself; else ``other``."""
    known = F.create_map(*[F.lit(x) for i, (name, suffixes) in enumerate(PROVIDERS) for s in suffixes for x in (s, f"{i:02d}{name}")])
    own = F.rtrim(F.lower(domain), F.lit("."))

    def of(host):
        hit = F.array_min(F.array_compact(F.transform(_suffixes(host), lambda s: F.try_element_at(known, s))))
        mine = (host == own) | F.endswith(host, F.concat(F.lit("."), own))
        return F.coalesce(F.substring(hit, 3, 99), F.when(mine, F.lit("self_hosted")))

    return F.coalesce(F.try_element_at(F.array_compact(F.transform(F.transform(hosts, lambda h: F.rtrim(F.lower(h), F.lit("."))), of)), F.lit(1)), F.lit("other"))


def selectors(name: Column) -> Column:
    out = F.array(*[F.lit(s) for s in COMMON_SELECTORS])
    for k, v in SELECTORS.items():
        out = F.when(name == k, F.array(*[F.lit(s) for s in v])).otherwise(out)
    return out
