from pyspark.sql import functions as F

import corpus_pipeline as p


def test_stages_on_a_small_corpus(spark, tmp_path):
    words = {"en": "the of and that with", "de": "der die und nicht mit"}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(f"{w} {w}{i}" for w in words[lang].split() * 8) + (" card 4785380592391139" if i == 5 else ""), lang, "s", 1))
    rows += [(100, rows[3][1] + "\n", "en", "s", 1), (101, rows[4][1] + " mehr", "de", "s", 1), (102, None, None, None, None), (103, "12 34", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path))
    # Of copies the longer stays, of near copies the smaller id; null and letterless texts are rejected.
    assert {r.doc_id for r in out.select("doc_id").collect()} == (set(range(60)) | {100}) - {3}
    assert out.filter(F.col("padding") < 0).count() == 0
    text = p.pseudonyms(spark, docs, "").filter("doc_id = 5").first().text
    assert "4785380592391139" not in text
