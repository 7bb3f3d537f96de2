"""What is published beside the metrics: labels in several languages, lines of figures, and counts that must not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_json, trimmed
from .metrics import FIGURES

# Fixed value: the keys of a locale catalogue.
LOCALE_KEYS = ("categories", "labels", "locale")


def locale_files(spark: SparkSession, folder: str) -> DataFrame:
    """locale (by the file's name), broken and labels map<string,string> of each JSON file of a folder; labels are null where broken.

    broken is json, keys (another set of keys), locale (it names another one) or labels (an object of texts that are
    not blank), and null for a sound file.
    """
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    v, name = F.col("v"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    parsed = texts.select(name.alias("locale"), parsed_json(F.col("value")).alias("v"))
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    kinds = F.transform_values(F.try_variant_get(v, "$.labels", "map<string,variant>"), lambda _, x: F.schema_of_variant(x))
    held = F.try_variant_get(v, "$.labels", "map<string,string>")
    sound = F.forall(F.map_values(kinds), lambda k: k == "STRING") & F.forall(F.map_values(held), lambda t: trimmed(t) != "")
    broken = (
        F.when(fields.isNull(), "json").when(F.array_sort(F.map_keys(fields)) != F.array(*[F.lit(k) for k in LOCALE_KEYS]), "keys")
        .when(F.coalesce(F.try_variant_get(v, "$.locale", "string") != F.col("locale"), F.lit(True)), "locale").when(~F.coalesce(sound, F.lit(False)), "labels")
    )
    return parsed.select("locale", broken.alias("broken"), F.when(broken.isNull(), held).alias("labels"))


def label_rows(files: DataFrame) -> DataFrame:
    """locale, metric_id, label of sound locale files."""
    return files.filter("broken IS NULL").select("locale", F.explode("labels").alias("metric_id", "label"))


def coverage(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """locale, metric_id and state of what locale files lack (missing) or have beyond the metrics (surplus); broken ones give one row of their fault."""
    known = [r.metric_id for r in metrics.select("metric_id").distinct().collect()]  # a closed catalogue
    wanted = files.filter("broken IS NULL").select("locale", F.explode(F.array(*[F.lit(m) for m in known]).cast("array<string>")).alias("metric_id"))
    both = wanted.withColumn("wanted", F.lit(True)).join(label_rows(files), ["locale", "metric_id"], "full_outer")
    state = F.when(F.col("label").isNull(), "missing").when(F.col("wanted").isNull(), "surplus")
    gaps = both.select("locale", "metric_id", state.alias("state")).filter("state IS NOT NULL")
    return gaps.unionByName(files.filter("broken IS NOT NULL").select("locale", F.lit("").alias("metric_id"), F.col("broken").alias("state")))


def figure_lines(figures: DataFrame, labels: DataFrame) -> DataFrame:
    """figure, place, locale and line of each row of figures (figure, place, metric_id, numerator, denominator, percent) in each locale that labels it."""
    shown = F.concat("label", F.lit("  "), F.replace("percent", F.lit("."), F.lit(",")), F.lit(" %  ("), "numerator", F.lit("/"), "denominator", F.lit(")"))
    return labels.join(F.broadcast(figures), "metric_id").select("figure", "place", "locale", shown.alias("line"))  # figures: a closed list


def ordered_distinct(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """group and values: the distinct values of each group by their first place; equal values are one before they are gathered."""
    first = rows.select(group, F.col(order).alias("at"), value.alias("value")).groupBy(group, "value").agg(F.min("at").alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def figure_denominators(spark: SparkSession) -> DataFrame:
    """figure and values: the denominators that each figure uses, by first use."""
    places = [(k, i, d) for k, (_, dens) in FIGURES.items() for i, d in enumerate(dens)]
    return ordered_distinct(spark.createDataFrame(places, "figure string, place int, denominator string"), "figure", "place", F.col("denominator"))


def against_frozen(metrics: DataFrame, frozen: DataFrame) -> DataFrame:
    """metric_id, frozen, actual and state (changed, gone) of frozen counts (metric_id, numerator) that metrics no longer give; other metrics are free."""
    now = metrics.select("metric_id", F.col("numerator").alias("actual"))
    both = frozen.select("metric_id", F.col("numerator").alias("frozen")).join(now, "metric_id", "left")
    state = F.when(F.col("actual").isNull(), "gone").when(F.col("actual") != F.col("frozen"), "changed")
    return both.select("metric_id", "frozen", "actual", state.alias("state")).filter("state IS NOT NULL")
