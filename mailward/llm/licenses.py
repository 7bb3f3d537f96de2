"""Licence scans through a positional rare-token index (operator 8), in native expressions only.

Every template is a passage of words with mandatory key phrases. The index orders the words of all templates
by IDF, measured over all scanned documents in one aggregate with a row a word, and posts each word's place
in each of its templates. A file is tokenised once; looking its words up gives the licence words that it
holds, rarest first. A template whose words it lacks in more places than MISSING allows is out. Of the words
of any other template the rarest that the file holds are looked up, two more than may be changed: each of
their occurrences proposes a start of the passage by its relative position, and starts that two words agree on
are compared word by word. A match has at least the share 1 - MISSING of the words in place, and the file
holds every key phrase. Which words are rare decides only what is compared first, never a result.

Base places (words of a phrase in a row) are counted on the text's words written with doubled separators,
so that neighbouring places cannot share one.

Defined results. A null or empty text has no words, no labels and score 0. Documents are independent, so
repeated rows and ties need no rule. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    passage: str
    keys: tuple[str, ...]

    @property
    def changed(self) -> int:
        """Words of the passage that may be missing or changed."""
        return int(MISSING * len(self.passage.split()) + 1e-9)


# Passages of well-known licences and notices, as words, and phrases that must occur.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "are permitted")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event", ("as is", "implied warranty")),
    Template("gpl", "under the terms of the gnu general public license", ("gnu general public license",)),
    Template("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-or-later", "either version 3 of the license or at your option any later version", ("at your option", "any later version")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "under the terms of the eclipse public license", ("eclipse public license",)),
    Template("epl", "licensed under the eclipse public license", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by", "licensed under cc by", ("cc by",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc0", "to the extent possible under law", ("possible under law",)),
)
#: Part of a passage's words that may be missing or changed.
MISSING = 0.1

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z as a-z; null as empty. Other letters may change too, but never into or out of ASCII.

    Words are only counted and compared with ASCII words, so that changes no result. The two letters whose
    lower case holds an ASCII letter are left alone, in the slower letter-by-letter form.
    """
    whole = F.coalesce(text, F.lit(""))
    odd = F.contains(whole, F.lit("\u212a")) | F.contains(whole, F.lit("\u0130"))
    return F.when(odd, F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(whole))


def spaced_words(text: Column) -> Column:
    """`` w1  w2  w3 ``: the words of a text, each between two spaces of its own; empty without words."""
    inner = F.trim(F.regexp_replace(lowered(text), _NOT_WORD, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _needle(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _words_in(spaced: Column) -> Column:
    """Words of a spaced text: each has two spaces."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(spaced: Column, phrase: str) -> Column:
    n = _needle(phrase)
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(n), F.lit("")))) / len(n)).cast("long")


def _first(spaced: Column, phrase: str) -> Column:
    at = F.instr(spaced, _needle(phrase))
    return F.when(at > 0, _words_in(F.substring(spaced, F.lit(1), at - 1)))


def _last(spaced: Column, phrase: str) -> Column:
    after = F.substring_index(spaced, _needle(phrase), -1)
    return F.when(F.contains(spaced, F.lit(_needle(phrase))), _words_in(spaced) - _words_in(after) - len(phrase.split()))


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates occurs; one aggregate over all of them."""
    vocabulary = sorted({w for t in templates for w in t.passage.split()})
    own = F.array_intersect(F.split(lowered(F.col("text")), _NOT_WORD), F.array(*[F.lit(w) for w in vocabulary]))
    found = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()  # a row a word of the templates
    return dict.fromkeys(vocabulary, 0) | {r["word"]: int(r["count"]) for r in found}


def by_rarity(template: Template, frequencies: dict[str, int]) -> list[tuple[str, int]]:
    """(word, first place) of a template's distinct words, highest IDF first, then by place."""
    words = template.passage.split()
    return sorted(((w, words.index(w)) for w in set(words)), key=lambda p: (frequencies.get(p[0], 0), p[1]))


def _proposals(words: Column, word: Column, place: Column) -> Column:
    """Where a template would start if an occurrence of the word were at its place."""
    return F.array_compact(F.transform(words, lambda w, i: F.when(w == word, i - place)))


def template_score(words: Column, held: Column, template: Template, frequencies: dict[str, int]) -> Column:
    """Best share of a template's words in place, 0 below 1 - MISSING; held are the licence words of a file."""
    posted = by_rarity(template, frequencies)
    passage, changed = template.passage.split(), template.changed
    enough = len(posted) - changed
    if enough < changed + 2:
        raise ValueError(f"too few distinct words in {template.passage!r}")
    own = F.array(*[F.lit(w) for w, _ in posted])
    present = F.array_intersect(own, held)
    places = F.create_map(*[F.lit(x) for p in posted for x in p])
    looked = [F.get(present, F.lit(i)) for i in range(changed + 2)]
    starts = [_proposals(words, w, F.element_at(places, w)) for w in looked]
    agreed = F.array_distinct(F.flatten(F.array(*[F.array_intersect(a, b) for i, a in enumerate(starts) for b in starts[:i]])))
    wanted = F.array(*[F.lit(w) for w in passage])
    share = F.array_max(F.transform(agreed, lambda o: F.size(F.filter(F.sequence(F.lit(0), F.lit(len(passage) - 1)), lambda i: F.get(words, o + i) == F.get(wanted, i))) / len(passage)))
    return F.when((F.size(present) >= enough) & (share >= 1 - MISSING - 1e-9), share).otherwise(F.lit(0.0))


def scan(docs: DataFrame, frequencies: dict[str, int], templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    s = F.col("s")
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t.passage.split()}, key=lambda w: (frequencies.get(w, 0), w))])
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced_words(F.col("text")).alias("s"))
    any_base = F.contains(s, F.lit(_needle("cc by"))) | F.contains(s, F.lit(_needle("general public license"))) | F.contains(s, F.lit(_needle("all rights reserved")))
    flagged = wide.select("doc_id", "s", any_base.alias("based"), F.split(F.trim(s), "  ").alias("words"))
    flagged = flagged.select("doc_id", "s", "based", "words", F.array_intersect(vocabulary, F.col("words")).alias("held"))

    def lacks(t):
        return F.size(F.array_except(F.array(*[F.lit(w) for w in sorted(set(t.passage.split()))]), "held"))

    # Templates that the words of a file leave possible; most files leave none.
    possible = F.array_compact(F.array(*[F.when(lacks(t) <= t.changed, F.lit(k)) for k, t in enumerate(templates)]))
    flagged = flagged.withColumn("possible", F.when(F.size("held") >= min(len(set(t.passage.split())) - t.changed for t in templates), possible).otherwise(F.array().cast("array<int>")))
    matches = []
    for k, t in enumerate(templates):
        keys = reduce(and_, [F.contains(s, F.lit(_needle(p))) for p in t.keys])
        score = F.when(F.array_contains("possible", k) & keys, template_score(F.col("words"), F.col("held"), t, frequencies)).otherwise(F.lit(0.0))
        matches.append(F.struct(F.lit(t.label).alias("label"), score.cast("double").alias("score")))
    base = {label: phrase for label, phrase in BASE.items()}
    zero = F.lit(0).cast("long")
    counted = flagged.select(
        "doc_id",
        _words_in(s).alias("n_words"),
        F.when(F.col("based"), sum((_places(s, p) for p in base.values()), start=zero)).otherwise(zero).alias("n_base"),
        F.when(F.col("based"), F.least(*[_first(s, p) for p in base.values()])).alias("first_word"),
        F.when(F.col("based"), F.greatest(*[_last(s, p) for p in base.values()])).alias("last_word"),
        F.when(F.col("based"), F.array_compact(F.array(*[F.when(F.contains(s, F.lit(_needle(p))), F.lit(k)) for k, p in base.items()]))).otherwise(F.array().cast("array<string>")).alias("base"),
        F.when(F.size("possible") > 0, F.filter(F.array(*matches), lambda m: m["score"] > 0)).otherwise(F.array().cast("array<struct<label:string,score:double>>")).alias("matches"),
    )
    return counted.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, document_frequencies(docs))


QUERIES = {"op8_licenses": op8_licenses}
ORACLES: dict[str, str] = {}
