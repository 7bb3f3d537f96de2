import re

from mailward.llm.licenses import BASE, document_frequencies, scan

TEXTS = [
    None, "", "...", "CC BY cc-by cc by", "All rights reserved. all rights reserved", "x General Public License y",
    "Licensed under the Apache License, Version 2.0 (the", "the apache license version 1", "released under the MIT license", "mit the under released license",
    "éall rights reserved", "cc\x00by", "cc by", "cc by sa", "general  public\nlicense all rights reserved cc by",
]


def test_base_and_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "cc by")], "doc_id long, text string").withColumn("s", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r.doc_id: r for r in scan(docs, document_frequencies(docs)).collect()}
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(k, name) for name, p in BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), text
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({n for _, n in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[6].labels == "apache-2.0" and got[7].labels == "" and got[8].labels == "mit" and got[9].labels == ""
    assert scan(docs.limit(0), {}).count() == 0
