"""Text, SQLite, JSON and CSV sources and sinks of the measurement."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import trimmed
from ..operators.tasks import tasks_for
from ..schema import ALL, COLUMNS, layout, typed

TABLE = "dmarc_scan_results"  # fixed value: the stored table's name


def normalized(line):
    """Without outer white space and final dots; blank lines become empty."""
    return F.rtrim(trimmed(line), F.lit("."))


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 1) and domain of each line that is not blank, in the order of the files' lines.

    Lines are numbered inside each split by the order of reading; one small table of split sizes gives offsets,
    so no task sees all lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    kept = lines.withColumn("domain", normalized(F.col("value"))).filter("domain <> ''").select("file", "start", "at", "domain")
    # Reading order numbers lines inside a split; ids of a split ascend but have gaps where blanks were.
    from pyspark.sql.window import Window

    sizes = kept.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a split
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("file", "start").orderBy("at")))
    return ranked.join(F.broadcast(before.select("file", "start", "before")), ["file", "start"]).select((F.col("before") + F.col("rank")).alias("pos"), "domain")


def ordered_digest(plan: DataFrame) -> tuple[str, int]:
    """SHA-256 and count of the domains in order, each with a line feed; streamed, never held at once."""
    digest, n = hashlib.sha256(), 0
    for row in plan.orderBy("pos").select("domain").toLocalIterator(prefetchPartitions=True):
        digest.update(row.domain.encode() + b"\n")
        n += 1
    return digest.hexdigest(), n


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.table, self.parts = options["path"], options.get("table", TABLE), int(options.get("partitions", "8"))
        self.columns = [f.name for f in schema.fields]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"{Path(self.path).resolve().as_uri()}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'CAST("{c}" AS TEXT)' for c in self.columns)
        with self._open() as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """A table of a closed SQLite file as text columns, read in ranges of rowids; the file must be visible to executors.

    spark.dataSource.register(SqliteSource); spark.read.format("sqlite_table").option("path", ...).load()
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with sqlite3.connect(f"{Path(self.options['path']).resolve().as_uri()}?mode=ro&immutable=1", uri=True) as db:
            columns = [row[1] for row in db.execute(f"PRAGMA table_info(\"{self.options.get('table', TABLE)}\")")]
        if not columns:
            raise ValueError("the file has no such table")
        return StructType([StructField(c, StringType()) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def sqlite_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results of either layout as text, for validation before any cast."""
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite_table").option("path", path).load()
    layout(rows.columns)
    return rows


def typed_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Stored results of a SQLite file under the canonical names and types, for accounting, retries and the report; validate them first."""
    rows = sqlite_results(spark, path)
    flags = [c for c in rows.columns if COLUMNS.get(layout(rows.columns).get(c, c)) == "boolean"]
    return typed(rows.withColumns({c: F.col(c).cast("int") for c in flags}))


def guarded_write(rows: DataFrame, path: str) -> None:
    """Replace stored Parquet results; refuses rows or an existing target of another layout. The commit is the writer's own."""
    spark = rows.sparkSession
    if set(rows.columns) != set(ALL):
        layout(rows.columns)
        raise ValueError("only the canonical layout is written")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) and set(spark.read.parquet(path).columns) != set(ALL):
        raise ValueError("the target holds results of another layout")
    rows.select(*ALL).write.mode("overwrite").parquet(path)


def strict_json(data: bytes):
    """JSON without repeated keys, NaN or Infinity."""
    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def constant(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(data.decode("utf-8"), object_pairs_hook=pairs, parse_constant=constant)


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def write_metrics(metrics: DataFrame, folder: str, one_file: bool = True) -> None:
    """metrics as JSON lines and as CSV, ordered by id: one file each for a closed catalogue, or as many as its rows ask for, in ranges of the order."""
    fields = ["metric_id", *sorted(set(metrics.columns) - {"metric_id"})]
    rows = metrics.select(*fields)
    ordered = rows.orderBy("metric_id").coalesce(1) if one_file else rows.repartitionByRange(tasks_for(rows.sparkSession, rows.count()), "metric_id").sortWithinPartitions("metric_id")
    ordered.write.json(f"{folder}/json")
    ordered.write.option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(f"{folder}/csv")


def csv_parity(spark: SparkSession, folder: str, schema: str, csv_folder: str | None = None) -> DataFrame:
    """metric_id and parity of each metric that either file has: all fields equal as text. The CSV file may lie elsewhere."""
    one = spark.read.schema(schema).json(f"{folder}/json")
    two = spark.read.option("header", True).csv(f"{csv_folder or folder}/csv")
    if set(one.columns) != set(two.columns):
        raise ValueError("the files have different fields")
    rest = [c for c in one.columns if c != "metric_id"]
    sides = [t.select("metric_id", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest]).alias(n)) for t, n in ((one, "a"), (two, "b"))]
    return sides[0].join(sides[1], "metric_id", "full_outer").select("metric_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("parity"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Path and SHA-256 of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))
