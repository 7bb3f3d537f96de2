"""Files written from pages against a list that is wrong on purpose, and batches committed from stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.commits import Results
from ..operators.progress import accounted_write
from ..sources import filesets
from ..sources.folders import shared_path
from ..sources.projection import plan, wide
from .registry import query
from .twins import SCAN


def _page_files(spark, d):
    """A folder with a file for most pages, and the lines of its list."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).alias("html"))
    folder = shared_path(spark, "pages")
    filesets.write_files(pages.filter("page_id % 13 <> 0").select("name", F.col("html").cast("binary").alias("content")), folder)
    digest = F.sha2(F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).cast("binary"), 256)
    lines = pages.filter("page_id % 17 <> 0").select(F.concat(F.when(F.col("page_id") % 19 == 0, F.upper(digest)).otherwise(digest), F.lit("  "), "name").alias("value"), F.expr("IF(page_id % 23 = 0, 2, 1)").alias("times"))
    path = shared_path(spark, "list")
    lines.select("value", F.explode(F.sequence(F.lit(1), "times"))).select("value").write.text(path)
    return folder, path


_PAGES = """WITH p AS (SELECT page_id, concat('p/', page_id, '.html') AS name, coalesce(html, '') AS html FROM pages), f AS (SELECT name, sha256(html) AS actual FROM p WHERE page_id % 13 <> 0),
  l AS (SELECT name, CASE WHEN page_id % 11 = 0 THEN sha256(html || 'x') ELSE sha256(html) END AS digest, page_id % 19 = 0 AS loud, page_id % 23 = 0 AS again FROM p WHERE page_id % 17 <> 0)"""


@query("checksum_diff", f"""{_PAGES} SELECT coalesce(l.name, f.name) AS name, CASE WHEN l.name IS NULL THEN 'extra' WHEN l.again THEN 'repeated' WHEN f.name IS NULL THEN 'missing' WHEN digest <> actual THEN 'altered' ELSE 'ok' END AS state, digest AS wanted, actual
  FROM (SELECT * FROM l WHERE NOT loud) AS l FULL JOIN f ON l.name = f.name UNION ALL SELECT upper(digest) || '  ' || name, 'malformed', NULL, NULL FROM l WHERE loud""")
def checksum_diff(spark, d):
    folder, path = _page_files(spark, d)
    return filesets.compared(filesets.checksum_rows(spark, path), filesets.hashed(filesets.listed(spark, folder)))


@query("file_inventory", f"{_PAGES} SELECT f.name, actual AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, 'text/html' AS media_type FROM f JOIN p USING (name)")
def file_inventory(spark, d):
    return filesets.inventory(spark, _page_files(spark, d)[0])


@query("resume_commits", f"""{SCAN}, b AS (SELECT w.domain, error <> '' OR EXISTS (SELECT 1 FROM seen WHERE seen.domain = w.domain AND seen.status = 'error') AS bad FROM w)
  SELECT 'first' AS batch, count(*) AS attempted, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS analyzable, count(*) FILTER (WHERE bad) AS errors FROM b UNION ALL SELECT 'second', count(*), count(*), 0, count(*) FROM b WHERE bad""")
def resume_commits(spark, d):
    results, universe = wide(spark, d), plan(spark, d)
    own = Results(spark, shared_path(spark, "committed"))
    for batch in ("first", "first", "second"):
        own.run(batch, universe, lambda left: results.join(left.select("domain"), "domain", "left_semi"))
    return spark.createDataFrame(own.entries(), "batch string, attempted long, total long, analyzable long, errors long").select("batch", "attempted", "total", "analyzable", "errors")


@query("write_accounting", f"""{SCAN}, b AS (SELECT w.has_mx, error <> '' OR EXISTS (SELECT 1 FROM seen WHERE seen.domain = w.domain AND seen.status = 'error') AS bad FROM w)
  SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS analyzable, count(*) FILTER (WHERE bad) AS errors, count(*) FILTER (WHERE has_mx) AS with_mail FROM b""")
def write_accounting(spark, d):
    return spark.createDataFrame([accounted_write(wide(spark, d), shared_path(spark, "accounted"))], "total long, analyzable long, errors long, with_mail long")
