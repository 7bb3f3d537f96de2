"""Chains of runs that name each other by manifest digest: where each one ends, and what must hold along it.

The walk doubles pointers: a round joins every open run with the run that it has reached, so paths of any
length are followed in a logarithmic number of rounds, each of which writes what it moved to durable files. Runs
that have reached their end move no more and are not written again. What is still open after as many steps as there are runs leads into a cycle, and the
places reached then are exactly the cycles' runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_path
from .sequences import running


def _kept(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def chain_walk(runs: DataFrame) -> DataFrame:
    """run_id, kind, root, depth, in_cycle, children of each run of runs(run_id, manifest_sha, previous_sha).

    kind is what a run's links lead to: root (a run that names none), lost (one that names a digest which no run
    or more than one has) or cycle. root is the run_id of that last run and depth the links to it; in a cycle root
    is the smallest run_id of the cycle, depth null, and in_cycle tells its own runs from those that lead there.
    children counts the runs that name a run; more than one is a fork. A run without a digest has no children.
    Several runs of one digest are ends for those that name it, and walk on their own. run_id must be unique.
    """
    known = runs.filter("manifest_sha IS NOT NULL").groupBy("manifest_sha").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("parent")).filter("n = 1").select("manifest_sha", "parent")
    linked = runs.select("run_id", "previous_sha").join(known.withColumnRenamed("manifest_sha", "previous_sha"), "previous_sha", "left")
    linked = _kept(linked.select("run_id", "parent", (F.col("parent").isNull() & F.col("previous_sha").isNotNull()).alias("lost")), "links")
    children = linked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("run_id")).agg(F.count(F.lit(1)).alias("children"))
    ended = F.col("parent").isNull()
    # place: the run reached after so many steps; low: the smallest run on the way there, its end left out.
    state = _kept(linked.select("run_id", F.coalesce("parent", "run_id").alias("place"), F.when(ended, 0).otherwise(1).cast("long").alias("steps"), F.col("run_id").alias("low"), ended.alias("done"), F.when(ended, F.col("lost")).alias("lost")), "walk")
    total, rounds = state.count(), 0
    reached = state
    while (open_ := reached.filter("NOT done")).limit(1).count() and (1 << rounds) <= total:
        step = state.select(F.col("run_id").alias("place"), F.col("place").alias("next"), F.col("steps").alias("more"), F.col("low").alias("next_low"), F.col("done").alias("next_done"), F.col("lost").alias("next_lost"))
        moved = open_.drop("done", "lost").join(step, "place")
        reached = _kept(moved.select("run_id", F.col("next").alias("place"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "next_low").alias("low"), F.col("next_done").alias("done"), F.col("next_lost").alias("lost")), "walk")
        state = state.filter("done").unionByName(reached)  # each row stays in the file of the round that ended it
        rounds += 1
    rows = state
    cycles = reached.filter("NOT done").select(F.col("place").alias("run_id")).distinct().withColumn("in_cycle", F.lit(True))
    # A run that leads into a cycle takes the smallest run of it from the place that it has reached, which is on it.
    lows = rows.filter("NOT done").select(F.col("run_id").alias("place"), F.col("low").alias("cycle_low"))
    found = rows.join(cycles, "run_id", "left").join(lows, "place", "left").join(children, "run_id", "left")
    return found.select(
        "run_id",
        F.when(~F.col("done"), "cycle").when(F.col("lost"), "lost").otherwise("root").alias("kind"),
        F.when(F.col("done"), F.col("place")).otherwise(F.col("cycle_low")).alias("root"),
        F.when(F.col("done"), F.col("steps")).alias("depth"),
        F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        F.coalesce("children", F.lit(0)).cast("long").alias("children"),
    )


# What must hold of a run and of those before it in its chain, as conditions; null counts as broken.
SEQUENCE_RULES = {
    "sequence_contiguous": "sequence = coalesce(sequence_before, 0) + 1",
    "interval_not_empty": "finished > started",
    "after_previous": "first OR started >= finished_before",
    "after_all_earlier": "first OR started >= latest_before",
    "core_changes_once": "first OR core = core_before OR (runs_before = 1 AND changes_before = 0)",
    "source_unchanged": "first OR (source_sha = source_before AND source_count = source_count_before)",
    "accounting_links": "first OR (pre_total = total_before AND pre_error = error_before)",
    "errors_never_rise": "first OR post_error <= pre_error",
    "order_agrees": "first OR sequence_before < sequence",
}


def with_predecessors(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """runs(chain, run_id, sequence, started, finished, core, source_sha, source_count, pre_*, post_*) with values of the earlier runs of their chain."""
    order = ["started", "run_id"]
    before = running(runs, "chain", order, ranges=ranges, seconds={
        "finished_before": F.col("finished"), "core_before": F.col("core"), "source_before": F.col("source_sha"), "source_count_before": F.col("source_count"),
        "total_before": F.col("post_total"), "error_before": F.col("post_error"), "sequence_before": F.col("sequence"),
    }, largest={"latest_before": F.col("finished")}, sums={"runs_before": F.lit(1)})
    changed = (F.col("runs_before") > 0) & ~F.col("core").eqNullSafe(F.col("core_before"))
    marked = before.withColumn("_changed", changed.cast("int"))
    again = running(marked, "chain", order, ranges=ranges, sums={"changes_before": F.col("_changed")})
    return again.withColumn("first", F.col("runs_before") == 0).drop("_changed")


def sequence_violations(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """run_id and the broken sequence rules of each run, in order, comma-joined; see with_predecessors() for the columns."""
    named = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(k)) for k, p in SEQUENCE_RULES.items()]))
    return with_predecessors(runs, ranges).select("run_id", F.array_join(named, ",").alias("broken"))


# What must hold of a run against what is pinned for its chain, as conditions; null counts as broken.
PIN_RULES = {
    "chain_pinned": "pin_source IS NOT NULL",
    "source_pinned": "source_sha = pin_source AND source_count = pin_count",
    "root_pinned": "NOT first OR (run_mode = 'fresh' AND core = pin_root_core AND attempted = pin_count AND pre_total = 0 AND pre_error = 0 AND post_total = pin_count)",
    "retry_pinned": "first OR (run_mode = 'resume' AND core = pin_core AND pre_total = pin_count AND post_total = pin_count AND attempted = pre_error)",
    "final_accounts": "NOT last OR (post_total = pin_count AND post_error = pin_errors)",
}


def pinned_violations(runs: DataFrame, pins: DataFrame, ranges: int | None = None) -> DataFrame:
    """chain, run_id and the broken rules of each run against pins, in order, comma-joined; a pinned chain without runs gives one row, broken: chain_missing.

    runs has run_mode and attempted beside the columns of with_predecessors(); pins(chain, pin_source, pin_count, pin_root_core,
    pin_core, pin_errors) holds a chain once. The last run of a chain is the one whose accounts are published.
    """
    order = F.struct("started", "run_id")
    before = running(runs, "chain", ["started", "run_id"], ranges=ranges, sums={"runs_before": F.lit(1)})
    ends = runs.groupBy("chain").agg(F.max(order).alias("_end"))
    placed = before.join(ends, "chain").select("*", (F.col("runs_before") == 0).alias("first"), (order == F.col("_end")).alias("last"))
    named = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(k)) for k, p in PIN_RULES.items()]))
    found = placed.join(pins, "chain", "left").select("chain", "run_id", F.array_join(named, ",").alias("broken"))
    return found.unionByName(pins.join(ends, "chain", "left_anti").select("chain", F.lit(None).cast("long").alias("run_id"), F.lit("chain_missing").alias("broken")))


def utc_text(at: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with microseconds and a final Z; the session's zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def intervals(runs: DataFrame) -> DataFrame:
    """chain, runs, started, finished and the longest gap between a run and all earlier ones of each chain, in the unit of started."""
    before = running(runs, "chain", ["started", "run_id"], largest={"latest_before": F.col("finished")})
    return before.groupBy("chain").agg(F.count(F.lit(1)).alias("runs"), F.min("started").alias("started"), F.max("finished").alias("finished"), F.coalesce(F.max(F.greatest(F.col("started") - F.col("latest_before"), F.lit(0))), F.lit(0)).alias("longest_gap"))
