"""Running values over ordered groups of any size, in two steps: inside ranges of a group, then over the ranges.

A plain window gives each group to one task. Here rows are ranged by (group, order), so a group that holds a
third of all rows is spread over as many ranges as it fills; running values are taken inside each range, and one
row for each range of a group carries them on. Ranges are written once: they come from sampling, and must not
change between the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import shared_path


def ranged(rows: DataFrame, group: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with _range, the number of the range of (group, order) that a row lies in, from durable files."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "ranged")
    rows.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def running(rows: DataFrame, group: str, order: list[str], seconds: dict[str, Column] = {}, largest: dict[str, Column] = {}, sums: dict[str, Column] = {}, ranges: int | None = None) -> DataFrame:  # noqa: B006
    """rows with values of the rows before each in its group, none of its own.

    seconds: the value of the row just before. largest: the largest value of all before. sums: the sum of all
    before (0 for the first). Nulls are no values of largest and sums. Rows that tie in order stand in any order.
    """
    laid = ranged(rows, group, order, ranges)
    before = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(group, "_range").orderBy(*order)
    own = laid.select("*", *[F.lag(F.struct(v.alias("v"))).over(last).alias(f"_i_{k}") for k, v in seconds.items()], *[F.max(v).over(before).alias(f"_i_{k}") for k, v in largest.items()], *[F.sum(v).over(before).alias(f"_i_{k}") for k, v in sums.items()])
    edges = laid.groupBy(group, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max_by(F.struct(v.alias("v")), F.struct(*order)).alias(f"_e_{k}") for k, v in seconds.items()],
        *[F.max(v).alias(f"_e_{k}") for k, v in largest.items()], *[F.sum(v).alias(f"_e_{k}") for k, v in sums.items()])
    over = Window.partitionBy(group).orderBy("_range")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(group, "_range", *[F.lag(f"_e_{k}").over(over).alias(f"_c_{k}") for k in seconds], *[F.max(f"_e_{k}").over(earlier).alias(f"_c_{k}") for k in largest], *[F.sum(f"_e_{k}").over(earlier).alias(f"_c_{k}") for k in sums])
    named = carried.withColumnsRenamed({group: "_g", "_range": "_r"})
    joined = own.join(named, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.coalesce(f"_i_{k}", f"_c_{k}")["v"].alias(k) for k in seconds],
        *[F.greatest(f"_i_{k}", f"_c_{k}").alias(k) for k in largest],
        *[(F.coalesce(f"_i_{k}", F.lit(0)) + F.coalesce(f"_c_{k}", F.lit(0))).alias(k) for k in sums],
    )
