"""Steps on rows made from small tables: dealt by the rows they make, and never through the driver by a wrong estimate."""

from pyspark.sql import functions as F

from mailward.operators import quality, tasks


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tasks_for(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks.tasks_for(spark, 0) == cores
    assert tasks.tasks_for(spark, tasks.ROWS_PER_TASK * 1000 + 1) == 1001
    assert tasks.spread(spark.range(10), tasks.ROWS_PER_TASK, "id").rdd.getNumPartitions() == max(cores, 10)


def test_metric_checks_without_broadcast(spark, tmp_path):
    spark.range(40).write.parquet(f"file://{tmp_path}/sets")
    rows = spark.read.parquet(f"file://{tmp_path}/sets").select(F.expr("inline(transform(sequence(1, 50), i -> struct(concat('m', i, '#', id) AS metric_id, 1L AS numerator, concat('m1#', id) AS denominator_id, 1L AS denominator, '100.00' AS percent)))"))
    checks = quality.metric_checks(rows)
    assert "BroadcastExchange" not in plan_of(checks)
    assert checks.filter("unique_id AND counts_hold AND denominator_holds AND percent_holds").count() == checks.count() == 2000


def test_scan_without_broadcast(spark, tmp_path):
    """A few planned domains whose answers are made from as few rows: their number is no estimate's."""
    from mailward.operators import scan

    spark.range(40).write.parquet(f"file://{tmp_path}/domains")
    plan = spark.read.parquet(f"file://{tmp_path}/domains").select(F.concat(F.lit("d"), "id", F.lit(".ch")).alias("domain"))
    answers = plan.select(F.expr("inline(transform(array('MX', 'DS', 'NS'), t -> struct(domain AS name, t AS rdtype, 'noanswer' AS status, CAST(array() AS array<string>) AS answers)))"))
    got = scan.observed(plan, answers)
    assert "BroadcastExchange" not in plan_of(got)
    assert got.count() == 40
    assert scan.observed(plan, answers).rdd.getNumPartitions() == scan.parts_of(plan)


def test_metric_files(spark, tmp_path):
    from mailward.sources.files import csv_parity, write_metrics

    rows = spark.range(200_000).select(F.concat(F.lit("m"), "id").alias("metric_id"), (F.col("id") % 7).alias("numerator"))
    for name, one in (("one", True), ("many", False)):
        write_metrics(rows, f"file://{tmp_path}/{name}", one_file=one)
    files = {name: len(list((tmp_path / name / "csv").glob("part-*"))) for name in ("one", "many")}
    assert files["one"] == 1 < files["many"]
    found = csv_parity(spark, f"file://{tmp_path}/one", "metric_id string, numerator long", csv_folder=f"file://{tmp_path}/many")
    assert found.count() == found.filter("parity").count() == 200_000
