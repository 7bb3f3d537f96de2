"""Columns that are called like what operators make or use inside, repeated rows and empty tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from mailward.llm import chat, exact_dedup, langid, packing

TEXT = "the one and the other with that and of the"


def test_exact_dedup(spark):
    rows = [(1, "a b", "x"), (1, "ab", "y"), (2, "c", "z"), (2, "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    groups = exact_dedup.copy_groups(docs).collect()
    assert sorted((r.doc_id, r.kept) for r in groups) == [(1, False), (1, True), (2, False), (2, True)]
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b", "x"), (2, "c", "z")]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_language_id(spark):
    docs = spark.createDataFrame([(i, TEXT + f" w{i}", "en", 0.25, "p", True) for i in range(20)], "doc_id long, text string, lang string, score double, Lang_Pred string, rejected boolean")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {(r.score, r.Lang_Pred, r.rejected) for r in kept.collect()} == {(0.25, "p", True)}


def test_language_pieces(monkeypatch):
    rows = [("the cat and the dog " * 30, "en"), ("der hund und die katze " * 30, "de")] * 4
    model = langid.train([t for t, _ in rows], [y for _, y in rows])
    whole = model.scores(rows[0][0].encode())
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert abs(model.scores(rows[0][0].encode()) - whole).max() < 1e-5


def test_packing(spark):
    docs = spark.createDataFrame([(i, i % 7, 1, 2, 3, "r") for i in range(50)], "doc_id long, n int, bucket int, shard int, nth int, ROOM string").withColumn("n", F.col("n").cast("long"))
    rows = packing.pack(docs, "n", buckets=3, budget=20)
    assert rows.columns == ["doc_id", "n", "shard", "nth", "ROOM", "bucket", "bucket_length", "batch_id", "slot", "padding"]
    assert {(r.shard, r.nth, r.ROOM) for r in rows.collect()} == {(2, 3, "r")}
    again = packing.pack_texts(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"))
    assert sorted(r.n_tokens for r in again.collect()) == [0, 2, 2]


def test_chat(spark):
    record = '{"messages": [{"role": "user", "content": "a"}]}'
    rows = spark.createDataFrame([(record, "l", 1, "p"), (record, "l", 1, "p")], "record string, layout string, turns int, __paths string")
    found = chat.canonical_turns(rows)
    assert found.columns == ["record", "__paths", "fingerprint", "layout", "turns"]
    assert [(r["__paths"], r.layout, r.turns[0].text) for r in found.collect()] == [("p", "messages", "a")] * 2
    long = spark.createDataFrame([(1, 0, "user", "<|end|>" * 20_000), (1, 0, "user", None), (1, None, None, "x")], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.conversation_records(long)).select(chat.parsed(F.col("formatted")).alias("t")).first().t
    assert [(t.role, len(t.text)) for t in done] == [("", 1), ("user", 0), ("user", 140_000)]


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, sha string, score string, bucket string"
    rows = [(i, f"{TEXT} number {i} is here and that is all", "en", "s", 1, "h", "q", "b") for i in range(12)]
    rows += [rows[0], rows[1], (3, "quite another text of the same id and that", "en", "s", 1, "h", "q", "b"), (None, "the text without any id is here and so", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    for name, table in (("full", rows), ("none", [])):
        spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == schema.replace("long", "").replace("string", "").replace(" ", "").split(",")
        assert {(r.sha, r.score, r.bucket) for r in docs.filter("doc_id is not null").collect()} <= {("h", "q", "b")}
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in docs.collect())
        if table:
            assert sorted(str(r.doc_id) for r in out) == sorted([*map(str, range(12)), "3", "None"])
