"""Sets of files: what a folder holds, its digests, checksum lists against it, and scans pinned to it.

Tasks list directories level by level, and hash files by reading a stream in pieces of CHUNK bytes, so a file of
any size takes the same memory. The folder must be readable by tasks through its URI.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared_path

CHUNK = 1 << 22
#: Files of a directory that are listed at once.
PIECE = 2000
CHECKSUMS = "checksums.sha256"
#: Rows of a side that are broadcast: a file's row takes some 300 bytes.
FEW_FILES = 100_000
# Suffixes of files that are never published, of scratch files, and media types by suffix.
PRIVATE_SUFFIXES = (".db", ".sqlite", ".sqlite3", ".wal", ".journal")
SCRATCH_SUFFIXES = ("~", ".bak", ".tmp", ".swp")
MEDIA_TYPES = {".json": "application/json", ".csv": "text/csv", ".md": "text/markdown", ".cff": "text/yaml", ".svg": "image/svg+xml", ".png": "image/png", ".sha256": "text/plain", ".txt": "text/plain", ".html": "text/html", ".xml": "text/xml", ".pdf": "application/pdf", ".gz": "application/gzip"}


def _located(uri: str):
    """(file system, path) of a URI whose characters are not escaped, as Spark names files."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe="/:@"))


def opened(uri: str):
    """A stream of a file's bytes."""
    store, path = _located(uri)
    return store.open_input_stream(path)


_LISTING = "path string, name string, length long, modified timestamp, kind string"


def _entries(store, path: str, may_lack: bool):
    """Facts of what a directory holds, in pieces of PIECE; a local one is read as a stream, so any number of files takes the same memory."""
    from pyarrow import fs

    if not isinstance(store, fs.LocalFileSystem):
        found = store.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=may_lack))
        for i in range(0, len(found), PIECE):
            yield found[i : i + PIECE]
        return
    if may_lack and not os.path.exists(path):
        return
    with os.scandir(path) as entries:
        while piece := [e.path for e in islice(entries, PIECE)]:
            yield store.get_file_info(piece)


def _children(batches):
    """What each directory of (path, name) batches holds, itself."""
    from pyarrow import fs

    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "directory"}
    for batch in batches:
        for uri, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, path = _located(uri)
            local = isinstance(store, fs.LocalFileSystem)
            for piece in _entries(store, path, not name):
                rows = []
                for info in piece:
                    kind = "link" if local and os.path.islink(info.path) else kinds.get(info.type, "other")
                    rows.append((f"{uri}/{info.base_name}", f"{name}/{info.base_name}" if name else info.base_name, info.size if kind == "file" else None, info.mtime_ns // 10**6 * 1000 if info.mtime_ns is not None else None, kind))
                types = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "name", "length", "modified", "kind"])


def listed(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """path (a URI), name (relative to the folder), length, modified (to the millisecond) and kind of all that is below a folder.

    kind is file, link or other. Hidden and empty files are listed too, links are not followed. Each round lists one
    level of directories in parallel and keeps what it finds; only the number of directories comes to the driver.
    """
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = re.sub("^file:/+", "file:/", folder.rstrip("/"))
    level, found = spark.createDataFrame([(root, "")], "path string, name string"), None
    while True:
        path = shared_path(spark, "listing")
        level.repartition(n, "path").mapInArrow(_children, _LISTING).write.parquet(path)
        here = spark.read.schema(_LISTING).parquet(path)
        rest = here.filter("kind <> 'directory'")
        found = rest if found is None else found.unionByName(rest)
        level = here.filter("kind = 'directory'").select("path", "name")
        if not level.limit(1).count():
            return found


def hashed(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """files (path, ...) with sha256 and bytes, read as streams; null where a file is gone or cannot be read."""
    n = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                try:
                    with opened(path) as stream:
                        while piece := stream.read(CHUNK):
                            digest.update(piece)
                            size += len(piece)
                    rows.append((digest.hexdigest(), size))
                except OSError:
                    rows.append((None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d for d, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int64())], names=[*batch.schema.names, "sha256", "bytes"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*files.schema.fields, StructField("sha256", StringType()), StructField("bytes", LongType())])
    return files.repartition(n, "path").mapInArrow(run, schema)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write each row of rows(name, content binary) as a file below a folder; returns name and bytes of those written.

    A file is written by the task that has its row, so a repeated task writes the same bytes again. Null content is empty.
    """
    root = re.sub("^file:/+", "file:/", folder.rstrip("/"))

    def run(batches):
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                store, path = _located(f"{root}/{name}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    path = shared_path(rows.sparkSession, "written")
    rows.select("name", "content").mapInArrow(run, "name string, bytes long").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def hygiene(files: DataFrame) -> DataFrame:
    """name and rule of each file that a public folder may not hold: links and devices, hidden, scratch, private or unsafe names."""
    name = F.col("name")
    last = F.element_at(F.split(name, "/"), -1)

    def ends(suffixes):
        out = F.lit(False)
        for s in suffixes:
            out = out | F.endswith(F.lower(last), F.lit(s))
        return out

    tests = {
        "link": F.col("kind") != "file" if "kind" in files.columns else F.lit(False),
        "hidden": F.rlike(name, F.lit(r"(^|/)\.[^/]")) & ~F.rlike(name, F.lit(r"(^|/)\.\.(/|$)")), "scratch": ends(SCRATCH_SUFFIXES), "private": ends(PRIVATE_SUFFIXES),
        "unsafe": F.rlike(name, F.lit(r"^/|(^|/)\.\.(/|$)|\\|[\x00-\x1f]|  ")),
    }
    return files.select("name", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("rule"))


def media_type(name):
    """Media type of a file by its suffix, text for a file called LICENSE; octet-stream for others."""
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    licence = F.when(F.element_at(F.split(name, "/"), -1) == "LICENSE", "text/plain")
    return F.coalesce(licence, F.element_at(types, F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))), F.lit("application/octet-stream"))


def checksum_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 and sound of each line of a checksum list; an unsound line keeps its text as its name."""
    lines = spark.read.text(path).select("value")
    digest, name = F.regexp_extract("value", r"^([0-9a-f]{64})  ", 1), F.substring("value", 67, 2**31 - 1)
    sound = F.rlike("value", F.lit(r"^[0-9a-f]{64}  \S")) & ~F.contains(name, F.lit("  "))
    return lines.select(F.when(sound, name).otherwise(F.col("value")).alias("name"), F.when(sound, digest).alias("sha256"), sound.alias("sound"))


def compared(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """name, state, wanted and actual digest of each file that a checksum list (name, sha256, sound) or a folder (name, sha256) has.

    ok, altered, missing (listed only), extra (there only), repeated (listed more than once), malformed (no checksum
    line) or unreadable (there, without a digest). The list itself is no file of its own.
    """
    lines = wanted.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.min("sha256").alias("wanted"), F.bool_and("sound").alias("sound"))
    both = lines.join(actual.filter(F.col("name") != CHECKSUMS).select("name", F.col("sha256").alias("actual"), F.lit(True).alias("there")), "name", "full_outer")
    state = F.when(~F.col("sound"), "malformed").when(F.col("times") > 1, "repeated").when(F.col("times").isNull(), "extra").when(F.col("there").isNull(), "missing").when(F.col("actual").isNull(), "unreadable").when(F.col("wanted") == F.col("actual"), "ok").otherwise("altered")
    return both.select("name", state.alias("state"), "wanted", "actual")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """compared() of a folder and the checksum list in it."""
    return compared(checksum_rows(spark, f"{folder.rstrip('/')}/{CHECKSUMS}"), hashed(listed(spark, folder)))


def checksum_lines(files: DataFrame) -> DataFrame:
    """value: the lines of a checksum list of files (name, sha256), by name, the list itself left out."""
    return files.filter(F.col("name") != CHECKSUMS).orderBy("name").select(F.concat("sha256", F.lit("  "), "name").alias("value"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """name, sha256, bytes and media_type of every file of a folder, the list and the release record left out."""
    files = hashed(listed(spark, folder)).filter(~F.col("name").isin(CHECKSUMS, "release.json"))
    return files.select("name", "sha256", "bytes", media_type(F.col("name")).alias("media_type"))


class SnapshotChanged(RuntimeError):
    """Files under a pinned scan are not those that were pinned."""


@dataclass(frozen=True)
class Snapshot:
    """A folder's files at one time, kept as a table: path, name, length, modified, sha256, bytes."""

    folder: str
    table: DataFrame
    files: int
    digest: str

    def changes(self) -> DataFrame:
        """name and change (altered, missing, extra) of each file that differs now."""
        spark = self.table.sparkSession
        now = hashed(listed(spark, self.folder)).select("name", F.col("sha256").alias("now"), F.lit(True).alias("there"))
        both = self.table.select("name", F.col("sha256").alias("then"), F.lit(True).alias("known")).join(now, "name", "full_outer")
        change = F.when(F.col("known").isNull(), "extra").when(F.col("there").isNull(), "missing").when(~F.col("then").eqNullSafe(F.col("now")), "altered")
        return both.select("name", change.alias("change")).filter("change IS NOT NULL")

    def unchanged(self) -> Snapshot:
        """This snapshot, if all files are as they were; raises SnapshotChanged with a count of each change."""
        counts = {r["change"]: r["count"] for r in self.changes().groupBy("change").count().collect()}
        if counts:
            raise SnapshotChanged(f"{self.folder}: {counts}")
        return self

    def enforced(self, rows: DataFrame) -> DataFrame:
        """rows of a scan of the folder, each checked to come from a pinned file of its length and time; the scan fails otherwise."""
        known = self.table.select(F.col("path").alias("_p"), F.struct("length", "modified").alias("_pin"))
        columns = [F.col(f"`{c}`") for c in rows.columns]
        held = rows.select(*columns, F.struct(F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified")).alias("_own"), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_at"))
        joined = held.join(F.broadcast(known) if self.files <= FEW_FILES else known, F.col("_at") == F.col("_p"), "left")
        problem = F.when(F.col("_pin").isNull() | (F.col("_pin") != F.col("_own")), F.raise_error(F.concat(F.lit("not a pinned file: "), "_at")).cast("boolean")).otherwise(F.lit(True))
        return joined.filter(problem).select(*columns)


def snapshot(spark: SparkSession, folder: str) -> Snapshot:
    """Pin the files of a folder: list and hash them, and keep the list. The digest covers names, lengths and contents."""
    path = shared_path(spark, "snapshot")
    hashed(listed(spark, folder)).write.parquet(path)
    table = spark.read.parquet(path)
    each = F.sha2(F.concat_ws("|", "name", "bytes", "sha256"), 256)
    # One sum over all files, whatever their order: 60 bits of each file's digest, added up, and how many there are.
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return Snapshot(folder, table, n, hashlib.sha256(f"{n}|{total or 0}".encode()).hexdigest())


def with_stable_input(spark: SparkSession, folder: str, read: Callable[[SparkSession, str], DataFrame], job: Callable[[DataFrame], object]):
    """The job's result on a scan that is pinned to the folder's files as they are before, and compared with them afterwards."""
    before = snapshot(spark, folder)
    result = job(before.enforced(read(spark, folder)))
    before.unchanged()
    return result
