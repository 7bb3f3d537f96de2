"""Live lookups: each distinct question is asked once, with bounded calls in flight and failures kept apart.

A resolver is any callable (name, rdtype) -> (status, answers); the source takes a factory of resolvers, which
every worker thread calls for itself, so a resolver need not be safe to share. Questions are made distinct
before they are dealt, so a name that a tenth of all domains share is asked once, and dealt by hash, so no task
holds one domain's or one host's questions only. ``tasks`` partitions run at most at once and each has
``in_flight // tasks`` threads: this bounds the calls in flight whatever the cluster's size. Answers are written
into the shared folder before anyone reads them: a lost executor repeats the questions of its unfinished tasks,
never those of finished ones.

Defined results. A question that raises, or whose response is no pair of a known status and a list of texts, is
an error without answers; others are not affected. Only "ok" keeps answers. Questions with a null name or type
are left out. An empty table asks nothing.
"""

from __future__ import annotations

import platform
import threading
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.scan import STATUSES
from .folders import shared_path

Response = tuple[str, list[str]]
Resolver = Callable[[str, str], Response]
SCHEMA = "name string, rdtype string, status string, answers array<string>"
_ARROW = pa.schema([("name", pa.string()), ("rdtype", pa.string()), ("status", pa.string()), ("answers", pa.list_(pa.string()))])


@dataclass(frozen=True)
class Settings:
    """How questions are asked. Five public servers and their times."""

    nameservers: tuple[str, ...] = ("1.1.1.1", "8.8.8.8", "9.9.9.9", "1.0.0.1", "8.8.4.4")
    rotate: bool = True
    timeout_seconds: float = 4.0
    lifetime_seconds: float = 6.0
    in_flight: int = 300
    tasks: int = 10

    def __post_init__(self):
        if not self.nameservers or self.in_flight < 1 or self.tasks < 1 or not 0 < self.timeout_seconds <= self.lifetime_seconds:
            raise ValueError("at least one server, one task and one call in flight, and a lifetime not below the timeout")

    @property
    def threads(self) -> int:
        """Threads of a task: all tasks together keep within in_flight, as long as it is at least tasks."""
        return max(1, self.in_flight // self.tasks)

    def configuration(self, library: str = "") -> dict:
        """What a run manifest records of the resolver."""
        return {"nameservers": list(self.nameservers), "rotate": self.rotate, "timeout_seconds": self.timeout_seconds, "lifetime_seconds": self.lifetime_seconds, "cache_policy": "disabled", "dnspython_version": library or platform.python_version()}


def joined_text(segments) -> str:
    """The text of a TXT record's segments; bytes that are no UTF-8 become replacement characters."""
    return b"".join(segments).decode("utf-8", "replace")


def sound(response) -> Response:
    """A response as it is kept: anything malformed is an error."""
    if not isinstance(response, tuple) or len(response) != 2 or response[0] not in STATUSES or not isinstance(response[1], list) or not all(isinstance(a, str) for a in response[1]):
        return "error", []
    return (response[0], list(response[1])) if response[0] == "ok" else (response[0], [])


class PublicResolver:
    """The dnspython library against public servers; needs the library and a network where tasks run."""

    def __init__(self, settings: Settings = Settings()):
        import dns.resolver

        self.library, self.own = dns.resolver, dns.resolver.Resolver(configure=False)
        self.own.nameservers, self.own.rotate, self.own.cache = list(settings.nameservers), settings.rotate, None
        self.own.timeout, self.own.lifetime = settings.timeout_seconds, settings.lifetime_seconds

    def __call__(self, name: str, rdtype: str) -> Response:
        try:
            found = self.own.resolve(name, rdtype, raise_on_no_answer=True)
        except self.library.NXDOMAIN:
            return "nxdomain", []
        except self.library.NoAnswer:
            return "noanswer", []
        return "ok", [joined_text(r.strings) if rdtype == "TXT" else str(r) for r in found]


class ChecksumResolver:
    """Answers made from a checksum of the question, failures of each kind among them: for rehearsals without a network."""

    def __call__(self, name: str, rdtype: str) -> Response:
        h = zlib.crc32(f"{rdtype} {name}".encode())
        kind = h % 8
        if kind == 2:
            raise TimeoutError(name)
        if kind in (3, 4):
            return ("lost", []) if kind == 3 else ("ok", None)
        if kind < 2:
            return ("nxdomain", "noanswer")[kind], []
        return "ok", [joined_text([b"v=", str(h).encode(), b"\xff"]) if rdtype == "TXT" else f"{h} {rdtype}"]


def ask(questions: Iterator[tuple[str, str]], factory: Callable[[], Resolver], threads: int) -> Iterator[tuple[str, str, str, list[str]]]:
    """(name, rdtype, status, answers) of each question, in order, with at most so many calls at once."""
    own = threading.local()

    def one(question):
        try:
            if not hasattr(own, "resolver"):
                own.resolver = factory()
            return (*question, *sound(own.resolver(*question)))
        except Exception:  # noqa: BLE001 - whatever a resolver raises concerns this question alone
            return (*question, "error", [])

    with ThreadPoolExecutor(threads) as pool:
        while part := list(islice(questions, 64 * threads)):
            # A call to a thread costs more than a quick answer: each gets a few questions, as long as all have work.
            few = max(1, min(8, len(part) // (4 * threads)))
            for found in pool.map(lambda some: [one(q) for q in some], [part[i : i + few] for i in range(0, len(part), few)]):
                yield from found


def answered(asked: DataFrame, factory: Callable[[], Resolver], settings: Settings = Settings()) -> DataFrame:
    """name, rdtype, status and answers of each distinct question of asked(name, rdtype), from durable files."""
    threads = settings.threads
    once = asked.select("name", "rdtype").na.drop().distinct().repartition(settings.tasks, "name", "rdtype")

    def run(batches):
        questions = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        found = ask(questions, factory, threads)
        while part := list(islice(found, 2048)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _ARROW, strict=True)], schema=_ARROW)

    path = shared_path(asked.sparkSession, "answers")
    once.mapInArrow(run, SCHEMA).write.parquet(path)
    return asked.sparkSession.read.schema(SCHEMA).parquet(path)
