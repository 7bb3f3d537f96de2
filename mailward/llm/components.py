"""Connected components of a table of links: one task while they are few, alternating star contractions beyond."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, written

#: Links that one task joins by itself: 16 bytes each, so 4 MB.
AT_ONCE = 1 << 18


def _forest(batches):
    """(node, label) of the links in all batches together, by union and find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "label"])


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label) of every node of links(a, b); the label is the component's smallest node.

    Up to at_once links one task joins them. Beyond, the links of each partition shrink to a forest; then each
    round first hangs every larger neighbour on the smallest node of a neighbourhood, and every smaller one
    after it. Minima are pre-aggregated before they move; the number of rounds grows with the logarithm of the
    longest path.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    if links.count() <= at_once:
        return edges.coalesce(1).mapInArrow(_forest, "node long, label long")
    edges = written(edges.mapInArrow(_forest, "node long, label long").select(F.col("node").alias("u"), F.col("label").alias("v")).filter("u > v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components known(node, label) after more links(a, b): only the labels that links meet are joined anew."""
    side = maybe_broadcast(known, known.count(), 32)
    ends = links.join(side.toDF("a", "x"), "a", "left").join(side.toDF("b", "y"), "b", "left")
    ends = written(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), "label_links", links.count())
    found = written(components(ends), "labels")
    moved = maybe_broadcast(found.toDF("label", "top"), found.count(), 32)
    old = known.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    # A node that no component held until now is its own label.
    return old.unionByName(found.join(side.select("node"), "node", "left_anti"))
