"""Lookups through resolvers that fail, count and block."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from mailward.operators import scan
from mailward.sources import lookup

from .test_scan import answer_rows


class Recorded:
    """Recorded answers; every call leaves a file, so that calls of all workers can be counted."""

    def __init__(self, rows, folder):
        self.rows, self.folder = rows, folder

    def __call__(self, name, rdtype):
        with open(f"{self.folder}/{rdtype}-{name}-{time.monotonic_ns()}-{threading.get_ident()}", "w"):
            pass
        if (name, rdtype) not in self.rows:
            raise TimeoutError(name)
        return self.rows[name, rdtype]


CASES = {
    "a.ch": (("ok", ["10 mx.shared.example."]), {("a.ch", "TXT"): ("ok", ["v=spf1 -all"])}), "b.ch": (("ok", ["10 mx.shared.example.", "20 b.own.example."]), {("b.own.example", "A"): ("noanswer", []), ("b.own.example", "AAAA"): ("ok", ["2001:db8::1"])}),
    "c.ch": (("nxdomain", []), {}), "d.ch": (("error", []), {}), "e.ch": (("noanswer", []), {("e.ch", "DS"): ("strange", ["1"]), ("e.ch", "NS"): ("ok", "text")}),
}


def test_live_equals_recorded_and_asks_once(spark, tmp_path):
    rows = {k: v for d, (mx, more) in CASES.items() for k, v in answer_rows(d, mx, more).items()}
    plan = spark.createDataFrame([(d,) for d in CASES], "domain string")
    settings = lookup.Settings(tasks=3, in_flight=12)
    folder = str(tmp_path)
    live = scan.scanned_live(plan, lambda asked: lookup.answered(asked, lambda: Recorded(rows, folder), settings))
    answers = spark.createDataFrame([(n, t, s, a if isinstance(a, list) else None) for (n, t), (s, a) in rows.items()], lookup.SCHEMA)
    assert sorted(map(repr, live.collect())) == sorted(map(repr, scan.scanned(plan, answers).collect()))
    calls = [p.name.rsplit("-", 2)[0] for p in tmp_path.iterdir()]
    assert len(calls) == len(set(calls)) and "A-mx.shared.example" in calls and "AAAA-b.own.example" in calls
    # An address settles a host, and a gate that stops asks nothing more.
    assert "AAAA-mx.shared.example" not in calls and not [c for c in calls if c.endswith(("c.ch", "d.ch")) and not c.startswith("MX-")]


def test_hot_name_is_asked_once(spark, tmp_path):
    folder = str(tmp_path)
    asked = spark.range(20_000).select(F.lit("hot.example").alias("name"), F.when(F.col("id") % 2 == 0, "A").otherwise("TXT").alias("rdtype")).unionByName(spark.createDataFrame([(None, "A"), ("x", None)], "name string, rdtype string"))
    got = lookup.answered(asked, lambda: Recorded({("hot.example", "A"): ("ok", ["192.0.2.1"])}, folder))
    assert sorted(map(tuple, got.collect())) == [("hot.example", "A", "ok", ["192.0.2.1"]), ("hot.example", "TXT", "error", [])]
    assert got.count() == 2 and len(list(tmp_path.iterdir())) == 2


def test_calls_in_flight_and_own_resolvers():
    lock, state, made = threading.Lock(), {"now": 0, "most": 0}, []

    def factory():
        made.append(threading.get_ident())

        def resolve(name, rdtype):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.002)
            with lock:
                state["now"] -= 1
            if name.endswith("3"):
                raise OSError(name)
            return "ok", [name]

        return resolve

    questions = [(f"n{i}", "A") for i in range(300)]
    got = list(lookup.ask(iter(questions), factory, 5))
    assert [g[:2] for g in got] == questions and all(g[2:] == (("error", []) if g[0].endswith("3") else ("ok", [g[0]])) for g in got)
    assert 1 < state["most"] <= 5 and len(made) == len(set(made)) <= 5


def test_a_factory_that_fails_is_an_error():
    def broken():
        raise ImportError("no library")

    assert list(lookup.ask(iter([("a", "MX")]), broken, 2)) == [("a", "MX", "error", [])]


@pytest.mark.parametrize("response", [None, "ok", ("ok",), ("lost", []), ("ok", None), ("ok", "text"), ("ok", [1]), ["ok", []]])
def test_malformed_responses(response):
    assert lookup.sound(response) == ("error", [])


def test_sound_responses_texts_and_settings():
    assert lookup.sound(("nxdomain", ["left over"])) == ("nxdomain", []) and lookup.sound(("ok", [])) == ("ok", [])
    assert lookup.joined_text([b"v=spf1 ", b"\xc3", b"\xa9 \xff"]) == "v=spf1 é �"
    assert lookup.Settings(in_flight=300, tasks=7).threads * 7 <= 300 and lookup.Settings(in_flight=2, tasks=7).threads == 1
    assert set(lookup.Settings().configuration("2.6.1")) == {"nameservers", "rotate", "timeout_seconds", "lifetime_seconds", "cache_policy", "dnspython_version"}
    with pytest.raises(ValueError):
        lookup.Settings(in_flight=0)
    with pytest.raises(ValueError):
        lookup.Settings(timeout_seconds=7.0)


def test_repeated_answers_and_domains(spark):
    plan = spark.createDataFrame([("a.ch",), ("a.ch",), ("b.ch",)], "domain string")
    rows = [(n, t, *r) for d in ("a.ch", "b.ch") for (n, t), r in answer_rows(d, ("noanswer", []), {}).items()]
    rows += [("a.ch", "DS", "noanswer", []), ("b.ch", "DS", "ok", ["1"]), ("b.ch", "NS", "noanswer", None)]
    got = {r.domain: r for r in scan.scanned(plan, spark.createDataFrame(rows, lookup.SCHEMA)).collect()}
    assert len(got) == 2 and got["a.ch"].error == "" and got["b.ch"].error == "query_errors: DS b.ch, NS b.ch" and scan.scanned(plan, spark.createDataFrame(rows, lookup.SCHEMA)).count() == 2


def test_threads_get_several_questions(monkeypatch):
    """Many quick questions cost fewer calls to threads than there are questions; few ones still reach every thread."""
    from concurrent.futures import ThreadPoolExecutor

    calls = []

    class Counted(ThreadPoolExecutor):
        def submit(self, *a, **k):
            calls.append(a)
            return super().submit(*a, **k)

    monkeypatch.setattr(lookup, "ThreadPoolExecutor", Counted)
    questions = [(f"d{i}.ch", "TXT") for i in range(4096)]
    assert [r[:2] for r in lookup.ask(iter(questions), lookup.ChecksumResolver, 8)] == questions
    assert len(calls) <= 1024
    calls.clear()
    assert len(list(lookup.ask(iter(questions[:8]), lookup.ChecksumResolver, 8))) == 8 == len(calls)
