"""Seeded plans, retries over stored files."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from mailward import schema
from mailward.operators import metrics, quality, store
from mailward.sources import files

from .test_release import ROWS


def test_seeded_plan(spark):
    plan = spark.range(1, 201).select(F.col("id").alias("pos"), F.concat(F.lit("d"), "id").alias("domain"))
    first = [r.domain for r in store.seeded_plan(plan).orderBy("pos").collect()]
    assert sorted(first) == sorted(r.domain for r in plan.collect()) and first != [f"d{i}" for i in range(1, 201)]
    assert [tuple(r) for r in store.seeded_plan(plan.repartition(7), limit=10).orderBy("pos").collect()] == list(enumerate(first[:10], 1))
    assert [r.domain for r in store.seeded_plan(plan, seed=1).orderBy("pos").collect()] != first
    assert store.seeded_plan(plan.limit(0)).count() == 0 and store.seeded_plan(plan, limit=0).count() == 0


def test_retry_over_a_stored_file(spark, tmp_path):
    path = str(tmp_path / "r.db")
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {files.TABLE} ({', '.join(schema.ALL)})")
        db.executemany(f"INSERT INTO {files.TABLE} VALUES ({', '.join('?' * 45)})", ROWS)
    quality.refused(files.sqlite_results(spark, path))
    rows = files.typed_sqlite(spark, path)
    plan = spark.createDataFrame([(i, f"c{i}") for i in range(1, 9)], "pos long, domain string")
    again, counts = store.retry_inspected(plan, rows)
    assert [tuple(r) for r in again.select("pos", "domain").collect()] == [(8, "c8")] and counts == {"total": 8, "analyzable": 7, "errors": 1}
    assert {(r.section, r.label): r.n for r in metrics.report(rows).collect()}["population", "mx present"] == 5
    assert metrics.counted(rows).filter("metric_id = 'dmarc.strict_alignment'").first().numerator == 2
    for other in (plan.limit(7), plan.unionByName(plan.limit(1)), plan.withColumn("domain", F.upper("domain"))):
        with pytest.raises(ValueError, match="differ"):
            store.retry_inspected(other, rows)
