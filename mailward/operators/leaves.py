"""Leaves of nested JSON by path, and which of them no allowed path covers; native throughout.

A text is parsed into VARIANT once; each round explodes what is still an object or a list by one level and keeps
the rounds' rows in durable files, so nesting of any depth is a loop over ever fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parsed_json
from ..sources.folders import shared_path

_ANY = "*"


def _kept(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path array<string> and leaf of each string or whole number in the JSON texts of rows; list places become *.

    Truth values, nulls and numbers with a fraction are no leaves; a number written with a zero fraction counts as
    whole. A text that is no JSON, or repeats a key of an object, has no leaves; nor has a null one. A key may contain dots.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), parsed_json(F.col(text)).alias("v")).filter("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    inner = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    leaf = F.when((kind == "STRING") | (kind == "BIGINT") | F.rlike(kind, F.lit(r"^DECIMAL\(\d+, ?0\)$")), F.try_variant_get("v", "$", "string"))
    found = None
    while True:
        level = _kept(level.select("key", "path", inner.alias("inner"), F.when(~inner, leaf).alias("leaf"), F.when(inner, F.col("v")).alias("v")), "leaves")
        here = level.filter("leaf IS NOT NULL").select("key", "path", "leaf")
        found = here if found is None else found.unionByName(here)
        open_ = level.filter("inner").select("key", "path", "v")
        if not open_.limit(1).count():
            return found.withColumnRenamed("key", key)
        level = spark.sql(f"SELECT t.key AS key, concat(t.path, array(coalesce(e.key, '{_ANY}'))) AS path, e.value AS v FROM {{t}} AS t, LATERAL variant_explode(t.v) AS e", t=open_)


def forbidden(found: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """Rows of found (path array<string>, ...) whose path no pattern covers; a * of a pattern covers any one part.

    The patterns are a trie; the distinct paths walk down it together, one hash join a level, by their next part and
    by *. Only reached nodes go on, so the cost goes with the paths, not with their product with the patterns.
    """
    spark = found.sparkSession
    nodes, edges, ends = {(): 0}, [], set()
    for pattern in patterns:
        for depth in range(len(pattern)):
            here, child = tuple(pattern[:depth]), tuple(pattern[: depth + 1])
            if child not in nodes:
                nodes[child] = len(nodes)
                edges.append((nodes[here], pattern[depth], nodes[child]))
        ends.add(nodes[tuple(pattern)])
    paths = _kept(found.select("path").distinct(), "paths")
    trie = F.broadcast(spark.createDataFrame(edges, "node int, part string, next int"))  # as long as the patterns, which the caller states
    reached, covered = paths.select("path", F.lit(0).alias("node")), paths.select("path").limit(0) if 0 not in ends else paths.filter("size(path) = 0")
    for depth in range(max((len(p) for p in patterns), default=0)):
        asked = reached.filter(F.size("path") > depth).select("path", "node", F.explode(F.array_distinct(F.array(F.get("path", F.lit(depth)), F.lit(_ANY)))).alias("part"))
        reached = asked.join(trie, ["node", "part"]).select("path", F.col("next").alias("node")).distinct()
        covered = covered.unionByName(reached.filter((F.size("path") == depth + 1) & F.col("node").isin(sorted(ends))).select("path"))
    return found.join(covered.distinct(), "path", "left_anti").select(*found.columns)
