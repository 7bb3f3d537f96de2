"""How many tasks a step gets: by the rows that it makes, not by the bytes of what it reads.

A row of a small table may stand for dozens of rows made from it, of which neither the size of its file nor
the planner's estimates know. Steps on such rows are dealt by these functions, so a task's rows stay bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def spread(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as each times their number asks for."""
    return rows.repartition(tasks_for(rows.sparkSession, rows.count() * each), *keys)
