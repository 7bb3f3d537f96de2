"""Batches of results that are committed once: prepared, staged aside, checked again, and named by one atomic entry.

A folder holds ``data/<batch>-<attempt>`` and a log ``log/<number>.json``. A batch is prepared from the log as it
stands: the results so far, the plan's digest and what is left to do. Its rows are staged under a name of this
attempt. To commit, the staged files are read back and counted, the log's head must be the one that the batch was
prepared on, and the entry is created under the next number without overwriting: of two writers one wins, the
other finds its number taken. Only entries make rows visible, so a batch that is killed anywhere and repeated
leaves one result; an attempt without an entry is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALL, COLUMNS
from ..sources.folders import hadoop_path
from .progress import accounted_write
from .store import accounting, to_resume, unique_plan


class CommitRefused(RuntimeError):
    """A batch that no longer fits what it was prepared for."""


def plan_digest(plan: DataFrame) -> str:
    """Digest of which domain stands at which position, from one aggregate: positions and domains are hashed by row and the hashes added."""
    each = F.sha2(F.concat_ws("|", "pos", "domain"), 256)
    words = [F.sum(F.conv(F.substring(each, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    row = plan.agg(F.count(F.lit(1)).alias("n"), *words).first()
    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest()


@dataclass(frozen=True)
class Prepared:
    """What a batch was prepared on."""

    batch: str
    head: int
    head_digest: str
    plan: str
    attempted: int


class Results:
    """The committed results of a folder (a URI), one row a domain, the latest batch first."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _entry(self, number: int) -> str:
        return f"{self.folder}/log/{number:08d}.json"

    def entries(self) -> list[dict]:
        """The log, one small entry a batch; refuses a log with gaps, or whose entries do not name their predecessor."""
        store, target = hadoop_path(self.spark, f"{self.folder}/log")
        if not store.exists(target):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(target) if not s.getPath().getName().startswith((".", "_")))
        if names != [f"{i:08d}.json" for i in range(len(names))]:
            raise CommitRefused(f"the log of {self.folder} has gaps")
        found, before = [], ""
        for i in range(len(names)):
            _, path = hadoop_path(self.spark, self._entry(i))
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(store.open(path), "UTF-8")
            entry = json.loads(text)
            if entry["previous"] != before:
                raise CommitRefused(f"entry {i} does not follow the one before")
            before = hashlib.sha256(text.encode()).hexdigest()
            found.append(entry | {"digest": before})
        return found

    def rows(self) -> DataFrame:
        """The latest row of each domain over all committed batches."""
        entries = self.entries()
        schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
        if not entries:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/data/{e['data']}").withColumn("_batch", F.lit(i)) for i, e in enumerate(entries)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(entries) == 1:
            return rows.drop("_batch")
        newest = rows.groupBy("domain").agg(F.max("_batch").alias("_batch"))
        return rows.join(newest, ["domain", "_batch"], "left_semi").drop("_batch").select(*ALL)

    def prepare(self, batch: str, plan: DataFrame) -> tuple[Prepared, DataFrame] | None:
        """The batch as it stands and the domains it has to attempt; None if it is committed already. The plan must be unique."""
        entries = self.entries()
        if any(e["batch"] == batch for e in entries):
            return None
        unique_plan(plan)
        left = to_resume(plan, self.rows())
        return Prepared(batch, len(entries), entries[-1]["digest"] if entries else "", plan_digest(plan), left.count()), left

    def stage(self, prepared: Prepared, rows: DataFrame) -> str:
        """Write a batch's rows aside; returns the attempt's name."""
        name = f"{prepared.batch}-{uuid.uuid4().hex}"
        accounted_write(rows.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()]), f"{self.folder}/data/{name}")
        return name

    def commit(self, prepared: Prepared, staged: str, plan: DataFrame) -> dict:
        """Check again and enter the batch; refused if rows are not those attempted, the plan is another one, or the log has moved on."""
        entries = self.entries()
        if (done := next((e for e in entries if e["batch"] == prepared.batch), None)) is not None:
            return done
        if len(entries) != prepared.head or (entries and entries[-1]["digest"] != prepared.head_digest):
            raise CommitRefused("other batches were committed since this one was prepared")
        if plan_digest(plan) != prepared.plan:
            raise CommitRefused("the plan is not the one that was prepared")
        rows = self.spark.read.parquet(f"{self.folder}/data/{staged}")
        n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct("domain")).first()
        strangers = rows.join(to_resume(plan, self.rows()), "domain", "left_anti").count()
        if not n == distinct == prepared.attempted or strangers:
            raise CommitRefused(f"{n} rows of {distinct} domains, {strangers} of them not attempted, where {prepared.attempted} were")
        counts = accounting(rows).first().asDict()
        entry = {"attempted": n, "batch": prepared.batch, "data": staged, "plan": prepared.plan, "previous": prepared.head_digest, **counts}
        self._create(self._entry(prepared.head), json.dumps(entry, sort_keys=True) + "\n")
        return entry

    def _create(self, path: str, text: str) -> None:
        """Create a file whole or not at all, never over another one."""
        store, target = hadoop_path(self.spark, path)
        _, aside = hadoop_path(self.spark, f"{self.folder}/log/.{uuid.uuid4().hex}")
        out = store.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        # A rename would replace the target on some storage: a lock file that only one writer can create comes first.
        _, lock = hadoop_path(self.spark, f"{path.rsplit('/', 1)[0]}/_{path.rsplit('/', 1)[1]}.lock")
        if store.exists(target) or not store.createNewFile(lock):
            store.delete(aside, False)
            raise CommitRefused(f"{path} is taken")
        if not store.rename(aside, target):
            store.delete(lock, False)
            raise OSError(f"cannot enter {path}")

    def run(self, batch: str, plan: DataFrame, scan) -> dict | None:
        """Prepare, scan what is left, stage and commit; does nothing for a batch that is committed. scan gives rows of the 45 columns."""
        if (ready := self.prepare(batch, plan)) is None:
            return None
        prepared, left = ready
        return self.commit(prepared, self.stage(prepared, scan(left)), plan)
