"""Locale files written from suppliers, lines of figures, frozen counts, metrics that are wrong on purpose, shuffled plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, publication, quality, store
from ..operators.tasks import spread
from ..sources import filesets
from ..sources.files import csv_parity, write_metrics
from ..sources.folders import shared_path
from ..sources.projection import plan, wide
from .registry import query
from .twins import COUNTED

_IDS = [m for m, _, _ in metrics.catalogue()]
_CATALOGUE = "(VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(_IDS)) + ") AS c(i, metric_id)"


def _locales(spark, d):
    """A folder with a locale file for each supplier; some lack labels, have others, or are broken."""
    k = F.col("s_suppkey").cast("int")
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(_IDS)])
    kept = F.filter(every, lambda e: (e["i"] + k) % 17 != 0)
    pairs = F.transform(kept, lambda e: F.concat(F.lit('"'), e["m"], F.lit('": "L'), k, F.lit(" "), e["i"], F.lit(' \\"é\\""')))
    more = F.when(k % 5 == 0, F.array(F.concat(F.lit('"own.'), k, F.lit('": "x"')))).otherwise(F.array().cast("array<string>"))
    blank = F.when(k % 19 == 3, F.array(F.lit('"blank": " "'))).when(k % 19 == 4, F.array(F.lit('"number": 1'))).otherwise(F.array().cast("array<string>"))
    name = F.concat(F.lit("s"), F.when(k % 19 == 5, k + 1).otherwise(k))
    text = F.concat(F.lit('{"locale": "'), name, F.lit('", "categories": {}, "labels": {'), F.array_join(F.concat(pairs, more, blank), ", "), F.lit("}"), F.when(k % 19 == 6, ', "more": 1').otherwise(""), F.when(k % 19 == 7, "").otherwise("}"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), k, F.lit(".json")).alias("name"), text.cast("binary").alias("content"))
    folder = shared_path(spark, "locales")
    filesets.write_files(rows, folder)
    return folder


_LOCALES = f"""l AS (SELECT s_suppkey AS k, 's' || s_suppkey AS locale, CASE s_suppkey % 19 WHEN 3 THEN 'labels' WHEN 4 THEN 'labels' WHEN 5 THEN 'locale' WHEN 6 THEN 'keys' WHEN 7 THEN 'json' END AS broken FROM supplier),
  given AS (SELECT k, locale, i, metric_id, 'L' || k || ' ' || i || ' "é"' AS label FROM l CROSS JOIN {_CATALOGUE} WHERE broken IS NULL AND (i + k) % 17 <> 0)"""


@query("locale_coverage", f"""WITH {_LOCALES} SELECT locale, metric_id, 'missing' AS state FROM l CROSS JOIN {_CATALOGUE} WHERE broken IS NULL AND (i + k) % 17 = 0
  UNION ALL SELECT locale, 'own.' || k, 'surplus' FROM l WHERE broken IS NULL AND k % 5 = 0 UNION ALL SELECT locale, '', broken FROM l WHERE broken IS NOT NULL""")
def locale_coverage(spark, d):
    known = spark.createDataFrame([(m,) for m in _IDS], "metric_id string")
    return publication.coverage(publication.locale_files(spark, _locales(spark, d)), known)


_FIGURES = "f AS (SELECT figure, generate_subscripts(ids, 1) - 1 AS place, unnest(ids) AS metric_id FROM (VALUES " + ", ".join(f"('{k}', {list(v[0])})" for k, v in metrics.FIGURES.items()) + ") AS t(figure, ids))"


@query("figure_lines", f"""{COUNTED}, {_LOCALES}, {_FIGURES} SELECT figure, CAST(place AS INTEGER) AS place, locale, label || '  ' || replace(percent, '.', ',') || ' %  (' || numerator || '/' || denominator || ')' AS line FROM f JOIN m USING (metric_id) JOIN given USING (metric_id)""")
def figure_lines(spark, d):
    labels = publication.label_rows(publication.locale_files(spark, _locales(spark, d)))
    return publication.figure_lines(metrics.figure_rows(metrics.counted(wide(spark, d))), labels)


@query("frozen_counts", f"""{COUNTED}, p AS (SELECT m.*, i FROM m JOIN {_CATALOGUE} USING (metric_id)), z AS (SELECT metric_id, numerator + CASE WHEN i % 5 = 2 THEN 1 ELSE 0 END AS frozen FROM p UNION ALL SELECT 'old.' || metric_id, numerator FROM p WHERE i % 9 = 0)
  SELECT z.metric_id, frozen, p.numerator AS actual, CASE WHEN p.metric_id IS NULL THEN 'gone' ELSE 'changed' END AS state FROM z LEFT JOIN p USING (metric_id) WHERE p.metric_id IS NULL OR p.numerator <> frozen""")
def frozen_counts(spark, d):
    """Counts of these results, some of them frozen at another number or under a name that is gone."""
    now = metrics.counted(wide(spark, d))
    places = spark.createDataFrame([(m, i) for i, m in enumerate(_IDS)], "metric_id string, i int")
    placed = now.join(F.broadcast(places), "metric_id")
    frozen = placed.select("metric_id", (F.col("numerator") + F.expr("IF(i % 5 = 2, 1, 0)")).alias("numerator")).unionByName(placed.filter("i % 9 = 0").select(F.concat(F.lit("old."), "metric_id").alias("metric_id"), "numerator"))
    return publication.against_frozen(now, frozen)


# The catalogue once for each supplier, with wrong counts, denominators, shares and repeated ids here and there.
_WRONG = {
    "numerator": "CASE WHEN (i + k) % 41 = 0 THEN denominator + 1 WHEN (i + k) % 43 = 0 THEN -1 ELSE numerator END", "denominator": "CASE WHEN (i + k) % 37 = 0 THEN denominator + 1 ELSE denominator END",
    "percent": "CASE WHEN (i + k) % 31 = 0 THEN '0.01' ELSE percent END", "denominator_id": "CASE WHEN (i + k) % 47 = 0 THEN 'none' ELSE denominator_id END", "times": "CASE WHEN (i + k) % 53 = 0 THEN 2 ELSE 1 END",
}


def _tampered(spark, d):
    places = spark.createDataFrame([(m, i) for i, m in enumerate(_IDS)], "metric_id string, i int")
    rows = metrics.counted(wide(spark, d)).join(F.broadcast(places), "metric_id")
    sets = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("k"))
    own = rows.collect()  # a closed catalogue
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("i", "metric_id", "numerator", "denominator_id", "denominator", "percent")]) for r in own])
    every = spread(sets, len(own), "k").select("k", F.inline(listed))
    made = every.select(F.concat_ws("#", "metric_id", "k").alias("metric_id"), *[F.expr(v).alias(c) for c, v in _WRONG.items() if c not in ("times", "denominator_id")], F.concat_ws("#", F.expr(_WRONG["denominator_id"]), "k").alias("denominator_id"), F.explode(F.sequence(F.lit(1), F.expr(_WRONG["times"]))).alias("nth"))
    return made.drop("nth")


_WRONG_SQL = f"""{COUNTED}, p AS (SELECT m.*, i FROM m JOIN {_CATALOGUE} USING (metric_id)), wrong AS (SELECT p.metric_id || '#' || k AS metric_id, {', '.join(f'{v} AS {c}' for c, v in _WRONG.items() if c not in ('times', 'denominator_id'))}, ({_WRONG['denominator_id']}) || '#' || k AS denominator_id, unnest(range({_WRONG['times']})) AS nth
  FROM p CROSS JOIN (SELECT CAST(s_suppkey AS INTEGER) AS k FROM supplier) AS s)"""
_SHOWN = "CASE WHEN denominator <= 0 THEN '0.00' ELSE CAST(CAST(floor(CAST(numerator AS DECIMAL(18,0)) * 100 / denominator * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(CAST(numerator AS DECIMAL(18,0)) * 100 / denominator * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') END"


@query("validate_tampered_metrics", f"""{_WRONG_SQL}, known AS (SELECT metric_id, count(*) AS times, max(numerator) AS named FROM wrong GROUP BY metric_id)
  SELECT w.metric_id, times = 1 AS unique_id, numerator >= 0 AND denominator >= 0 AND numerator <= denominator AS counts_hold, coalesce(d.named = denominator, false) AS denominator_holds FROM wrong AS w JOIN known USING (metric_id) LEFT JOIN (SELECT metric_id AS denominator_id, named FROM known) AS d USING (denominator_id)""")
def validate_tampered_metrics(spark, d):
    return quality.metric_checks(_tampered(spark, d)).drop("percent_holds")


@query("csv_parity_tampered", f"""{_WRONG_SQL}, one AS (SELECT DISTINCT * EXCLUDE (nth) FROM wrong) SELECT metric_id, hash_free <> 0 AS parity FROM (SELECT metric_id, CAST(regexp_extract(metric_id, '#(\\d+)$', 1) AS INTEGER) % 7 AS hash_free FROM one)""")
def csv_parity_tampered(spark, d):
    """Both files of one set of metrics, the CSV one changed in every row of each seventh set."""
    kept, one, two = (shared_path(spark, "metrics") for _ in range(3))
    _tampered(spark, d).distinct().write.parquet(kept)
    rows = spark.read.parquet(kept)
    write_metrics(rows, one, one_file=False)
    changed = rows.withColumn("percent", F.when(F.regexp_extract("metric_id", r"#(\d+)$", 1).cast("int") % 7 == 0, F.concat("percent", F.lit("0"))).otherwise(F.col("percent")))
    write_metrics(changed, two, one_file=False)
    return csv_parity(spark, one, rows.schema.simpleString()[7:-1].replace(":", " "), csv_folder=two)


@query("plan_shuffle", "SELECT pos, domain FROM (SELECT row_number() OVER (ORDER BY sha256('42|' || c_custkey || '|d' || c_custkey || '.ch')) AS pos, 'd' || c_custkey || '.ch' AS domain FROM customer)")
def plan_shuffle(spark, d):
    return store.seeded_plan(plan(spark, d))


@query("plan_shuffle_limit", "SELECT pos, domain FROM (SELECT row_number() OVER (ORDER BY sha256('7|' || c_custkey || '|d' || c_custkey || '.ch')) AS pos, 'd' || c_custkey || '.ch' AS domain FROM customer) WHERE pos <= 40")
def plan_shuffle_limit(spark, d):
    return store.seeded_plan(plan(spark, d), seed=7, limit=40)
