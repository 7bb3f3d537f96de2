import zlib

from mailward.llm.langid import fit, has_letter, keep_identified, op7_language_id, predict

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_defined_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, per_class=60)
    odd = spark.createDataFrame([(1, None, 1.5), (2, "", 0.0), (3, "123 -- !!", 0.0), (4, "the" * 200_000, 0.0), (5, "日本", 0.0), (None, "the and of the with", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected for i in (1, 2, 3))
    assert got[4].lang_pred in model.classes and got[None].lang_pred == "en"
    again = {r.doc_id: r for r in predict(odd, fit(docs, per_class=60)).collect()}
    assert again == got


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。", "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.", "junk": "xkcd qwrtz plmnb vcxzq wrtzp kjhgf mnbvc qxzwv",
}


def test_rejection(spark):
    """Languages that were not learned and letter junk go, also one that is held back from training; at most 1 % of learned rows do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    names, scores, rejected = model.judge(list(FOREIGN.values()))
    assert rejected == [True] * len(FOREIGN)
    kept = predict(docs, model).filter("lang IS NOT NULL").selectExpr("avg(IF(rejected, 1, 0)) AS lost", "avg(IF(lang_pred = lang, 1, 0)) AS right").first()
    assert kept.lost <= 0.01 and kept.right >= 0.98
    without = fit(docs.filter("lang <> 'de'"))
    german = predict(docs.filter("lang = 'de'"), without).selectExpr("avg(IF(rejected, 1, 0)) AS gone").first()
    assert german.gone >= 0.9


def test_columns_in_other_case(spark):
    docs = spark.createDataFrame([(1, "text", 2.0, "x", "y")], "doc_id long, text string, Score double, LANG_PRED string, Rejected string")
    found = predict(docs, fit(docs.withColumn("lang", docs.text).limit(0)))
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "rejected"] and found.first().lang_pred == "und"


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None, "s")], "doc_id long, text string, lang string, source string")
    assert [r.lang_pred for r in predict(docs, fit(docs)).collect()] == ["und"]
    assert predict(docs.limit(0), fit(docs.limit(0))).count() == 0
    assert keep_identified(docs.limit(0)).columns == docs.columns


def test_letters():
    assert has_letter("1é") and not has_letter("12́") and not has_letter(None)
