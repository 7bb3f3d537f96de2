"""Continuous merge of result batches into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import latest, upsert


def merge_stream(batches: DataFrame, read, write, key: str, order: list[str], checkpoint: str):
    """Start a stream that upserts each micro-batch: read() gives the stored rows, write(df, id) replaces them."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        write(upsert(read(), latest(batch, key, order), key), batch_id)

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def sliced(rows: DataFrame, key: str, slices: int) -> DataFrame:
    return rows.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)))


def merge_slices(batches: DataFrame, path: str, schema: str, key: str, order: list[str], checkpoint: str, slices: int = 64):
    """Start a stream that upserts into Parquet below path, cut into slices by a hash of the key.

    A micro-batch reads and replaces only the slices that its keys fall into, so its cost goes with the batch
    as long as batches touch few of many slices. Replaying a batch after a failure gives the same rows; rows that
    are older than the stored ones, by the columns of order, do not replace them.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = sliced(latest(batch, key, order), key, slices)
        touched = [r.slice for r in fresh.select("slice").distinct().collect()]  # at most so many as there are slices
        if not touched:
            return
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        held = spark.read.schema(f"{schema}, slice long").parquet(path).filter(F.col("slice").isin(touched)) if files.exists(root) else fresh.limit(0)
        merged = sliced(latest(held.drop("slice").unionByName(fresh.drop("slice")), key, order), key, slices)
        aside = f"{path.rstrip('/')}-batch-{batch_id}"
        merged.write.mode("overwrite").parquet(aside)  # what is replaced must not be read meanwhile
        spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
