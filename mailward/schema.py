"""The two accepted layouts of stored results, and how typed rows become stored ones and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a stored result, in order, with their Spark types.
COLUMNS = {
    "domain": "string", "domain_exists": "boolean", "has_mx": "boolean", "mx_hosts": "array<string>", "mx_provider": "string",
    "has_spf": "boolean", "spf_record": "string", "spf_all_mechanism": "string", "spf_lookup_count": "int", "spf_near_limit": "boolean", "has_legacy_spf_rrtype": "boolean",
    "dkim_selectors_checked": "array<string>", "dkim_selectors_found": "array<string>", "has_dkim": "boolean", "dkim_testing_mode": "boolean", "dkim_weak_key": "boolean",
    "has_dmarc": "boolean", "dmarc_record": "string", "dmarc_policy": "string", "dmarc_rua": "boolean", "dmarc_ruf": "boolean",
    "dmarc_pct": "bigint", "dmarc_sp": "string", "dmarc_adkim": "string", "dmarc_aspf": "string", "dmarc_rua_domains": "array<string>", "dmarc_ruf_domains": "array<string>",
    "has_ds_record": "boolean", "ns_hosts": "array<string>", "mx_hosts_unresolvable": "array<string>", "mx_unresolvable": "boolean",
    "has_bimi": "boolean", "bimi_record": "string", "has_mta_sts": "boolean", "mta_sts_record": "string", "has_tlsrpt": "boolean", "tlsrpt_record": "string",
    "has_caa": "boolean", "caa_records": "array<string>", "has_tlsa_record": "boolean", "tlsa_hosts_checked": "array<string>", "tlsa_hosts_found": "array<string>",
    "query_statuses": "map<string,string>", "error": "string", "scanned_at": "timestamp",
}
# Canonical names and those of the older layout, which also lacks query_statuses.
LEGACY = {"has_ds_record": "dnssec_signed", "has_tlsa_record": "has_tlsa"}
# What a column holds where no stage has set it.
DEFAULTS = {"domain_exists": "true", "dmarc_pct": "100", "dmarc_adkim": "'r'", "dmarc_aspf": "'r'"}

FLAGS = [c for c, t in COLUMNS.items() if t == "boolean"]
NESTED = [c for c, t in COLUMNS.items() if t.startswith(("array", "map"))]
TEXTS = [c for c, t in COLUMNS.items() if t == "string"]
ALL = list(COLUMNS)
OLD = [LEGACY.get(c, c) for c in ALL if c != "query_statuses"]


def default(column: str) -> str:
    """SQL of a column's default."""
    kind = COLUMNS[column]
    if kind.startswith("array"):
        return f"CAST(array() AS {kind})"
    if kind.startswith("map"):
        return f"CAST(map() AS {kind})"
    return f"CAST({DEFAULTS.get(column, {'boolean': 'false', 'string': chr(39) * 2, 'int': '0', 'bigint': '0'}.get(kind, 'null'))} AS {kind})"


def difference(columns: list[str]) -> tuple[list[str], list[str]]:
    """Missing and extra columns against the canonical layout."""
    return sorted(set(ALL) - set(columns)), sorted(set(columns) - set(ALL))


def layout(columns: list[str]) -> dict[str, str]:
    """{stored name: canonical name} of the columns to rename; refuses any but the two layouts."""
    if len(set(columns)) == len(columns):
        if set(columns) == set(ALL):
            return {}
        if set(columns) == set(OLD):
            return {old: new for new, old in LEGACY.items()}
    missing, extra = difference(columns)
    raise ValueError(f"unknown schema: missing {', '.join(missing) or 'none'}; extra {', '.join(extra) or 'none'}")


def canonical(results: DataFrame) -> DataFrame:
    """Either layout under the canonical names; a column that the older one lacks stays missing."""
    renamed = results.withColumnsRenamed(layout(results.columns))
    return renamed.select(*[c for c in ALL if c in renamed.columns])


def legacy(results: DataFrame) -> DataFrame:
    return results.select(*[F.col(c).alias(LEGACY.get(c, c)) for c in ALL if c != "query_statuses"])


def stored(results: DataFrame) -> DataFrame:
    """Typed rows as the flat layer that files hold: flags as 0 and 1, lists and maps as JSON text."""
    def flat(c):
        if c in FLAGS:
            return F.col(c).cast("int").alias(c)
        if c in NESTED:
            return F.to_json(c).alias(c)
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "scanned_at" else F.col(c)

    return results.select(*[flat(c) for c in results.columns])


def typed(rows: DataFrame) -> DataFrame:
    """The inverse of stored(), for rows that validation has passed."""
    names = layout(rows.columns)

    def full(c):
        name = names.get(c, c)
        if name in FLAGS:
            return (F.col(c) == 1).alias(name)
        if name in NESTED:
            return F.from_json(c, COLUMNS[name]).alias(name)
        return F.to_timestamp(c, "yyyy-MM-dd HH:mm:ss").alias(name) if name == "scanned_at" else F.col(c).cast(COLUMNS[name]).alias(name)

    return rows.select(*[full(c) for c in rows.columns])
