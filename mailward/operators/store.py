"""Operators on stored results: upsert, resume, retry, accounting, schema adaption."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import running


def inconclusive() -> Column:
    """Whether a row has an error, or keeps an error status without one; rows without statuses have only the former."""
    return F.expr("error <> '' OR coalesce(exists(map_values(query_statuses), v -> v = 'error'), false)")


def _inconclusive(results: DataFrame) -> Column:
    return inconclusive() if "query_statuses" in results.columns else F.expr("error <> ''")


def upsert(base: DataFrame, delta: DataFrame, key: str = "domain") -> DataFrame:
    """Rows of base that delta does not replace, and delta; one row a key in delta."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a pre-aggregated maximum, so a hot key stays cheap."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def done(results: DataFrame) -> DataFrame:
    return results.filter(~_inconclusive(results)).select("domain")


def to_resume(plan: DataFrame, results: DataFrame) -> DataFrame:
    return plan.join(done(results), "domain", "left_anti")


def to_retry(plan: DataFrame, results: DataFrame) -> DataFrame:
    return plan.join(results.filter(_inconclusive(results)).select("domain"), "domain", "left_semi")


def accounting(results: DataFrame) -> DataFrame:
    bad = _inconclusive(results)
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("analyzable"), F.count_if(bad).alias("errors"))


def same_universe(plan: DataFrame, results: DataFrame) -> DataFrame:
    """side and domain of what only one of them has, repeats counted."""
    a, b = plan.select("domain"), results.select("domain")
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "domain").unionByName(b.exceptAll(a).select(F.lit("extra").alias("side"), "domain"))


def unique_plan(plan: DataFrame) -> DataFrame:
    """plan(pos, domain), if it has rows and no domain twice."""
    n, distinct = plan.agg(F.count(F.lit(1)), F.count_distinct("domain")).first()
    if not n or n != distinct:
        raise ValueError("a plan has at least one domain and none twice")
    return plan


def shuffled(plan: DataFrame, seed: int = 42, limit: int | None = None) -> DataFrame:
    """The plan in a seeded permutation, then limited. The permutation is a sequential shuffle of positions, made
    once on the driver (8 bytes a domain) and joined back by position."""
    spark, n = plan.sparkSession, plan.count()
    order = list(range(1, n + 1))
    random.Random(seed).shuffle(order)
    places = spark.createDataFrame(pd.DataFrame({"pos": order, "place": range(1, n + 1)}), "pos long, place long")
    kept = places if limit is None else places.filter(F.col("place") <= limit)
    return plan.join(kept, "pos").select(F.col("place").alias("pos"), "domain")


def seeded_plan(plan: DataFrame, seed: int = 42, limit: int | None = None) -> DataFrame:
    """The plan in an order that the seed alone decides, then limited: by a digest of seed, position and domain.

    Places are counted in ranges of digests, so no task and no driver holds all of them.
    """
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "pos", "domain"), 256)
    ordered = running(plan.select("pos", "domain", key.alias("key"), F.lit(0).alias("whole")), "whole", ["key"], sums={"before": F.lit(1)})
    placed = ordered.select((F.col("before") + 1).cast("long").alias("pos"), "domain")
    return placed if limit is None else placed.filter(F.col("pos") <= limit)


def retry_inspected(plan: DataFrame, results: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """What of a plan is to be tried again, and the accounting of the stored results; refused unless both have the same domains."""
    if (odd := same_universe(plan, results).groupBy("side").count().collect()):
        raise ValueError(f"plan and results differ: { {r.side: r['count'] for r in odd} }")
    return to_retry(plan, results), accounting(results).first().asDict()


def same_plan(plan: DataFrame, expected: DataFrame) -> bool:
    """Whether both have the same domain at each position."""
    both = plan.select("pos", "domain").join(expected.select("pos", F.col("domain").alias("other")), "pos", "full_outer")
    return both.filter("NOT domain <=> other").limit(1).count() == 0


# Each rule of a run's accounting, as a condition on run_mode, planned, excluded, attempted, written and the counts before and after.
RUN_RULES = {
    "mode_known": "run_mode IN ('fresh', 'resume')",
    "pre_partition": "pre_total = pre_ok + pre_error",
    "post_partition": "post_total = post_ok + post_error",
    "written_equals_attempted": "written = attempted",
    "excluded_plus_attempted": "excluded + attempted = planned",
    "post_total_range": "post_total BETWEEN pre_total AND pre_total + attempted",
    "nothing_attempted_nothing_changed": "attempted > 0 OR (post_total = pre_total AND post_ok = pre_ok AND post_error = pre_error)",
    "fresh_starts_empty": "run_mode <> 'fresh' OR (pre_total = 0 AND pre_ok = 0 AND pre_error = 0)",
    "fresh_excludes_none": "run_mode <> 'fresh' OR (excluded = 0 AND attempted = planned)",
    "fresh_keeps_all": "run_mode <> 'fresh' OR post_total = attempted",
    "retry_plans_all": "run_mode <> 'resume' OR planned = pre_total",
    "retry_attempts_errors": "run_mode <> 'resume' OR attempted = pre_error",
    "retry_excludes_analyzable": "run_mode <> 'resume' OR excluded = pre_ok",
    "retry_keeps_total": "run_mode <> 'resume' OR post_total = pre_total",
    "retry_lowers_errors": "run_mode <> 'resume' OR post_error <= pre_error",
}


def broken_rules(runs: DataFrame) -> DataFrame:
    """run_id and the broken rules of each run, in order, comma-joined."""
    named = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(k)) for k, p in RUN_RULES.items()]))
    return runs.select("run_id", F.array_join(named, ",").alias("broken"))


def eligible(runs: DataFrame) -> DataFrame:
    """run_id and release_eligible: no limit, clean sources, the whole source planned and held, on top of the run's own rules."""
    whole = F.expr("limit_rows IS NULL AND NOT dirty AND source_count > 0 AND planned = source_count AND post_total = source_count")
    by_mode = F.when(F.col("run_mode") == "fresh", F.expr("attempted = source_count")).otherwise(F.expr("pre_total = source_count"))
    return runs.join(broken_rules(runs), "run_id").select("run_id", (whole & by_mode & (F.col("broken") == "")).alias("release_eligible"))


def chain_links(runs: DataFrame) -> DataFrame:
    """run_id and what holds between each run and the one whose manifest digest it names.

    Runs have chain, run_id, manifest_sha, previous_sha, started, finished and counts; a digest that two runs share is no link.
    """
    once = runs.groupBy("chain", F.col("manifest_sha").alias("previous_sha")).agg(F.count(F.lit(1)).alias("times"), F.max_by(F.struct("finished", "post_total", "post_ok", "post_error"), "run_id").alias("p"))
    both = runs.join(once, ["chain", "previous_sha"], "left")
    root = F.col("previous_sha").isNull()
    return both.select(
        "run_id", root.alias("is_root"), (root | (F.coalesce("times", F.lit(0)) == 1)).alias("linked"),
        (root | F.coalesce(F.col("started") >= F.col("p.finished"), F.lit(False))).alias("in_order"),
        (root | F.coalesce((F.col("pre_total") == F.col("p.post_total")) & (F.col("pre_ok") == F.col("p.post_ok")) & (F.col("pre_error") == F.col("p.post_error")), F.lit(False))).alias("counts_link"),
    )
