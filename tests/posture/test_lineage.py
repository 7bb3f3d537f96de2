"""What may leave a query, and what a write counts in flight."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailward import schema
from mailward.operators import metrics
from mailward.operators.lineage import Origin, counts_only, origins
from mailward.operators.progress import Progress, accounted_write, observed_stream
from mailward.streaming import sliced


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    defaults = {c: F.expr(schema.default(c)) for c in schema.ALL if c != "domain"}
    made = spark.range(12).select(F.concat(F.lit("d"), "id").alias("domain"), *[x.alias(c) for c, x in defaults.items()])
    path = str(tmp_path_factory.mktemp("rows") / "r")
    made.withColumn("error", F.when(F.col("domain") == "d3", "mx_query_error").otherwise("")).withColumn("has_mx", F.col("domain") < "d2").write.parquet(path)
    return spark.read.parquet(path)


def test_counts_may_leave(rows):
    assert counts_only(metrics.counted(rows)).count() == 68
    n = F.count(F.lit(1)).alias("n")
    for frame in (rows.agg(n), rows.agg(F.count_distinct("domain").alias("n")), rows.filter("has_mx").agg(n).selectExpr("n + 1 AS n", "'x' AS label"), rows.groupBy("mx_provider").agg(n).agg(F.sum("n").alias("n"), F.max("n").alias("m")), rows.agg(n).unionByName(rows.agg(n)), rows.agg(n).orderBy("n").limit(1), rows.agg(n).crossJoin(rows.agg(F.count_if("has_mx").alias("m")))):
        assert counts_only(frame) is frame


@pytest.mark.parametrize("build", [
    lambda r: r.select("domain"), lambda r: r.agg(F.max("domain").alias("x")), lambda r: r.agg(F.collect_list("domain").alias("n")), lambda r: r.agg(F.count(F.lit(1)).alias("n"), F.first("error").alias("e")), lambda r: r.groupBy("domain").count(), lambda r: r.agg(F.sum("dmarc_pct").alias("n")),
    lambda r: r.agg(F.max_by("domain", "dmarc_pct").alias("n")), lambda r: r.agg(F.count(F.lit(1)).alias("n")).unionAll(r.agg(F.sum("dmarc_pct"))), lambda r: r.select(F.explode("mx_hosts").alias("n")), lambda r: r.select(F.row_number().over(Window.orderBy("domain")).alias("n"), F.length("domain").alias("m")), lambda r: r.select(F.input_file_name().alias("n")), lambda r: r.select(F.lit(1).alias("domain"), F.col("domain").alias("n")).select("n"),
])
def test_all_else_is_refused(rows, build):
    with pytest.raises(ValueError, match="no counts"):
        counts_only(build(rows))


def test_origins_by_column(rows):
    frame = rows.groupBy("mx_provider").agg(F.count(F.lit(1)).alias("n"), F.lit(3).alias("three"))
    assert origins(frame) == [("mx_provider", Origin.RAW), ("n", Origin.COUNT), ("three", Origin.CONSTANT)]
    with pytest.raises(ValueError, match="followed through"):
        counts_only(rows.select("domain").mapInArrow(lambda b: b, "domain string"))


def test_one_pass_writes_and_counts(rows, tmp_path):
    assert accounted_write(rows, f"{tmp_path}/a") == {"total": 12, "analyzable": 11, "errors": 1, "with_mail": rows.filter("has_mx").count()}
    assert accounted_write(rows.limit(0), f"{tmp_path}/b") == {"total": 0, "analyzable": 0, "errors": 0, "with_mail": 0}


def test_progress_of_a_stream(spark, rows, tmp_path):
    for i in (0, 1):
        sliced(rows, "domain", 2).filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = observed_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").start()
        query.processAllAvailable()
        query.stop()
        for _ in range(100):
            if progress.totals()["total"] == 12:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert progress.totals() == {"total": 12, "analyzable": 11, "errors": 1, "with_mail": rows.filter("has_mx").count()}
    assert [json.loads(x)["batch"] for x in progress.lines()] == [0, 1] and spark.read.parquet(f"{tmp_path}/out").count() == 12
