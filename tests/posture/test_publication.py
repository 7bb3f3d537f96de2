"""Locale files, lines of figures, ordered distinct values and frozen counts."""

import json

from pyspark.sql import functions as F

from mailward.operators import publication


def test_locale_files(spark, tmp_path):
    sound = {"locale": "de", "categories": {"mx": "Post"}, "labels": {"mx.present": "Vorhanden \"x\"", "own": "ü"}}
    files = {
        "de": json.dumps(sound), "fr": json.dumps({**sound, "locale": "fr", "labels": {}}), "it": json.dumps(sound), "a": json.dumps({**sound, "locale": "a", "more": 1}), "b": json.dumps({**sound, "locale": "b", "labels": {"mx.present": " \t"}}),
        "c": json.dumps({**sound, "locale": "c", "labels": {"mx.present": 1}}), "d": json.dumps({**sound, "locale": "d", "labels": []}), "e": "{", "f": json.dumps({**sound, "locale": "f"})[:-1] + ', "locale": "f"}', "g": json.dumps({**sound, "locale": "g"}) + "x", "h": "[]", "i": json.dumps({"locale": "i", "labels": {}}), "j": json.dumps({**sound, "locale": None}),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "notes.txt").write_text("no locale")
    found = publication.locale_files(spark, f"file://{tmp_path}")
    assert {r.locale: r.broken for r in found.collect()} == {"de": None, "fr": None, "it": "locale", "a": "keys", "b": "labels", "c": "labels", "d": "labels", "e": "json", "f": "json", "g": "json", "h": "json", "i": "keys", "j": "locale"}
    assert sorted(map(tuple, publication.label_rows(found).collect())) == [("de", "mx.present", 'Vorhanden "x"'), ("de", "own", "ü")]
    metrics = spark.createDataFrame([("mx.present",), ("mx.absent",)], "metric_id string")
    gaps = {tuple(r) for r in publication.coverage(found.filter("locale IN ('de', 'fr', 'e')"), metrics).collect()}
    assert gaps == {("de", "mx.absent", "missing"), ("de", "own", "surplus"), ("fr", "mx.present", "missing"), ("fr", "mx.absent", "missing"), ("e", "", "json")}
    figures = spark.createDataFrame([("f", 0, "mx.present", 1, 3, "33.33")], "figure string, place int, metric_id string, numerator long, denominator long, percent string")
    assert [tuple(r) for r in publication.figure_lines(figures, publication.label_rows(found)).collect()] == [("f", 0, "de", 'Vorhanden "x"  33,33 %  (1/3)')]


def test_ordered_distinct(spark):
    rows = spark.createDataFrame([("g", 3, "a"), ("g", 1, "b"), ("g", 2, "a"), ("g", 4, "b"), ("h", 1, None), ("h", 2, "x")], "g string, at int, v string")
    assert {r.g: r["values"] for r in publication.ordered_distinct(rows, "g", "at", F.col("v")).collect()} == {"g": ["b", "a"], "h": [None, "x"]}
    assert {r.figure: r["values"] for r in publication.figure_denominators(spark).collect()}["mail-authentication-overview"] == ["population.analyzable", "mx.present"]


def test_frozen_counts(spark):
    schema = "metric_id string, numerator long"
    now, then = spark.createDataFrame([("a", 1), ("b", 2), ("new", 9)], schema), spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], schema)
    assert sorted(map(tuple, publication.against_frozen(now, then).collect())) == [("b", 3, 2, "changed"), ("c", 4, None, "gone")]
