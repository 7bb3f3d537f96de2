"""Accounting in flight: the pass that writes results also counts them, and the files are held against the counts."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .store import inconclusive

NAME = "accounting"


def _counts():
    bad = inconclusive()
    return [F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("analyzable"), F.count_if(bad).alias("errors"), F.count_if("has_mx").alias("with_mail")]


def accounted_write(rows: DataFrame, path: str) -> dict[str, int]:
    """Write results as Parquet and count them in the same pass; refused if the files hold another number of rows."""
    seen = Observation(NAME)
    rows.observe(seen, *_counts()).write.parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    held = rows.sparkSession.read.parquet(path).count()  # from the files' footers
    if held != counts["total"] or counts["analyzable"] + counts["errors"] != counts["total"]:
        raise ValueError(f"{held} rows written, counted {counts}")
    return counts


def observed_stream(rows: DataFrame) -> DataFrame:
    """A stream of results whose batches report their accounting to listeners."""
    return rows.observe(NAME, *_counts())


class Progress(StreamingQueryListener):
    """Accounting of each batch of the streams of observed_stream(), as lines of JSON and as totals so far.

    spark.streams.addListener(progress); a batch that is repeated after a failure counts once, by its number.
    """

    def __init__(self):
        self._lock, self._batches = threading.Lock(), {}

    def onQueryStarted(self, event):  # noqa: N802 - names of the listener's interface
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            with self._lock:
                self._batches[str(event.progress.id), event.progress.batchId] = {"batch": event.progress.batchId, "at": event.progress.timestamp, **{k: int(v) for k, v in row.asDict().items()}}

    def lines(self) -> list[str]:
        """One JSON object a batch, in order."""
        with self._lock:
            return [json.dumps(v, sort_keys=True) for _, v in sorted(self._batches.items())]

    def totals(self) -> dict[str, int]:
        with self._lock:
            return {k: sum(b[k] for b in self._batches.values()) for k in ("total", "analyzable", "errors", "with_mail")}
