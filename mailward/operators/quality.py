"""Checks that refuse results: on stored rows as text, and on metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parsed_json
from ..schema import FLAGS, NESTED, TEXTS, layout
from .lineage import counts_only  # noqa: F401 - one of the checks
from .metrics import PROVIDER_NAMES, SPF_TERMS
from .scan import STATUSES


def _whole(c: str, signed: bool = True) -> Column:
    return F.coalesce(F.rlike(F.col(c).cast("string"), F.lit(r"^-?[0-9]+$" if signed else r"^[0-9]+$")), F.lit(False))


def _list_of_text(c: str) -> Column:
    """Whether a text is a JSON list of texts alone; texts may hold commas, brackets and the word null."""
    return F.coalesce(F.schema_of_variant(parsed_json(F.col(c))).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) & F.coalesce(F.forall(parsed_json(F.col(c)).cast("array<string>"), lambda x: x.isNotNull()), F.lit(False))


def _object(c: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(parsed_json(F.col(c))), F.lit("OBJECT")), F.lit(False))


def rules(names: dict[str, str], stored: list[str]) -> dict[str, Column]:
    """{rule: whether a row breaks it} for stored columns; names are those that the older layout renames."""
    def own(canonical: str) -> str:
        return next((old for old, new in names.items() if new == canonical), canonical)

    def any_of(tests) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    lists = [c for c in NESTED if c != "query_statuses"]
    texts = [c for c in [*TEXTS, "scanned_at"] if c in stored]
    found = {
        "flags": any_of(~F.coalesce(F.col(own(c)).cast("string").isin("0", "1"), F.lit(False)) for c in FLAGS),
        "lookups": ~_whole("spf_lookup_count", signed=False),
        "pct": ~_whole("dmarc_pct"),
        "lists": any_of(~_list_of_text(c) for c in lists),
        "texts": any_of(F.col(c).isNull() for c in texts if c != "error") | (F.col("domain") == "") | (F.col("scanned_at") == ""),
        "error_null": F.col("error").isNull(),
        "provider": F.col("mx_provider").isNull() | ((F.col("has_mx").cast("string") == "1") & ~F.col("mx_provider").isin(PROVIDER_NAMES)) | ((F.col("has_mx").cast("string") == "0") & (F.col("mx_provider") != "")),
        "spf_terminal": F.col("spf_all_mechanism").isNull() | ((F.col("has_spf").cast("string") == "1") & ~F.col("spf_all_mechanism").isin([*SPF_TERMS, "none"])) | ((F.col("has_spf").cast("string") == "0") & (F.col("spf_all_mechanism") != "")),
        "dmarc_null": F.col("dmarc_policy").isNull() | F.col("dmarc_sp").isNull(),
    }
    if "query_statuses" in stored:
        values = F.coalesce(F.map_values(F.from_json("query_statuses", "map<string,string>")), F.expr("CAST(array() AS array<string>)"))
        failed = F.exists(values, lambda v: v == "error")
        crashed = F.startswith("error", F.lit("scan_exception: ")) & (F.col("query_statuses") == "{}")
        found |= {
            "statuses": ~_object("query_statuses"),
            "status_values": ~F.forall(values, lambda v: F.coalesce(v.isin(*STATUSES), F.lit(False))),
            "error_status": F.coalesce(((F.col("error") == "") & failed) | ((F.col("error") != "") & ~failed & ~crashed), F.lit(False)),
        }
    return {k: F.coalesce(v, F.lit(True)) for k, v in found.items()}


def violations(rows: DataFrame) -> DataFrame:
    """rule and violations: one scan and one aggregate for all rules; refuses an unknown layout."""
    tests = rules(layout(rows.columns), rows.columns)
    sums = rows.agg(*[F.count_if(v).alias(k) for k, v in tests.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in tests])))


def refused(rows: DataFrame) -> DataFrame:
    """The rows themselves, if no rule is broken."""
    broken = violations(rows).filter("violations > 0").collect()  # one row a rule
    if broken:
        raise ValueError("refused: " + ", ".join(f"{r.rule} ({r.violations})" for r in broken))
    return rows


def broken_rows(rows: DataFrame) -> DataFrame:
    """domain and rule of each broken rule."""
    tests = rules(layout(rows.columns), rows.columns)
    named = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]))
    return rows.select("domain", F.explode(named).alias("rule"))


def metric_checks(metrics: DataFrame) -> DataFrame:
    """Per metric: unique id, counts in range, denominator equal to the metric it names, exact percentage and its rounding."""
    from .metrics import display

    base = metrics.groupBy("metric_id").agg(F.count(F.lit(1)).alias("times"), F.max("numerator").alias("named"))
    # As many rows as metrics, whatever the planner takes them for: none of this goes through the driver.
    joined = metrics.join(base.select(F.col("metric_id").alias("denominator_id"), "named").hint("merge"), "denominator_id", "left").join(base.select("metric_id", "times").hint("merge"), "metric_id")
    return joined.select(
        "metric_id",
        (F.col("times") == 1).alias("unique_id"),
        ((F.col("numerator") >= 0) & (F.col("denominator") >= 0) & (F.col("numerator") <= F.col("denominator"))).alias("counts_hold"),
        F.coalesce(F.col("named") == F.col("denominator"), F.lit(False)).alias("denominator_holds"),
        (F.col("percent") == display(F.col("numerator"), F.col("denominator"))).alias("percent_holds"),
    )


def accepted(metrics: DataFrame) -> list:
    """The metrics as rows on the driver (a closed catalogue), if every check and every identity holds."""
    from .metrics import reconciled

    bad = metric_checks(metrics).filter("NOT (unique_id AND counts_hold AND denominator_holds AND percent_holds)").collect()
    bad += reconciled(metrics).filter("NOT holds").collect()
    if bad:
        raise ValueError(f"metrics refused: {[r[0] for r in bad]}")
    return metrics.orderBy("metric_id").collect()
