"""What the corpus operators share: the tables, the shared folder and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows times their width stay below this many bytes.
BROADCAST_BYTES = 32 << 20

#: The six ASCII white-space characters of the contracts, as one character class.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by its path; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where it is unset (local tests) a temporary folder of our own becomes the checkpoint folder.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='mailward-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def few(df: DataFrame, rows: int, each: int = 1 << 14) -> DataFrame:
    """df in no more partitions than its rows fill, each with about so many; rows is a count or an upper bound."""
    return df.coalesce(max(1, -(-rows // each)))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends at durable files. rows: a bound, where known."""
    spark = df.sparkSession
    if rows is not None:
        df = few(df, rows)
    path = f"{shared_dir(spark)}/mailward/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = f"{shared_dir(spark)}/mailward/"
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(own).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m"):
    """Arrow batches of few rows and bytes for what is written inside: whole texts travel in them, two a row at times."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint when its counted size is small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def released() -> None:
    """Give memory that a worker has freed back to the system: workers outlive tasks, and others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def pieces(batches, rows: int = 512):
    """Arrow batches cut into few rows each, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    released()


def without_spaces(text: Column) -> Column:
    """The text without any of the six ASCII white-space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fresh(name: str, columns) -> str:
    """name, or name with underscores behind it, such that no column is called so in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
