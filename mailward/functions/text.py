"""Column builders for record texts: trimming, tag lists, first matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(trimmed(c), r"(?U)\s+"), lambda t: t != "")


def compact(c: Column) -> Column:
    """Trimmed, lower-cased, without spaces: the form in which version tags are compared."""
    return F.replace(F.lower(trimmed(c)), F.lit(" "), F.lit(""))


def tags(record: Column) -> Column:
    """array<struct<k,v>> of ``k=v;k=v``, in order; parts without ``=`` are left out."""
    parts = F.filter(F.split(record, ";"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(parts, lambda p: F.struct(F.lower(trimmed(F.substring_index(p, "=", 1))).alias("k"), trimmed(F.split(p, "=", 2)[1]).alias("v")))


def tag(entries: Column, key: str) -> Column:
    """The last value of a key; null if it does not occur."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def first_match(records: Column, test) -> Column:
    return F.try_element_at(F.filter(records, test), F.lit(1))


def parsed_json(text: Column) -> Column:
    """A text as VARIANT; null for what is not one whole JSON value, or repeats a key.

    The parser stops behind the first value and lets anything follow. What follows inside a list can only close it
    with a bracket, and inside an object with a brace; a text that is whole in both is whole.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]")))
    named = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("\n}")))
    return F.when(named.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))
