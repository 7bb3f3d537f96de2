from mailward.streaming import merge_slices, merge_stream

SCHEMA = "domain string, at long, v string"


def batches(spark, path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


ROWS = [[("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")], [("b", 3, "z"), ("c", 1, "x")], [("a", 1, "old"), ("d", 9, "w")]]
LAST = {"a": "y", "b": "z", "c": "x", "d": "w"}


def test_slices(spark, tmp_path):
    stream = merge_slices(batches(spark, f"{tmp_path}/in", ROWS), f"{tmp_path}/out", SCHEMA, "domain", ["at", "v"], f"{tmp_path}/mark", slices=4)
    stream.processAllAvailable()
    stream.stop()
    rows = spark.read.schema(f"{SCHEMA}, slice long").parquet(f"{tmp_path}/out").collect()
    assert {r.domain: r.v for r in rows} == LAST and len(rows) == 4


def test_whole_table(spark, tmp_path):
    held = {"rows": []}
    stream = merge_stream(batches(spark, f"{tmp_path}/in", ROWS[:2]), lambda: spark.createDataFrame(held["rows"], SCHEMA), lambda df, i: held.update(rows=[tuple(r) for r in df.select("domain", "at", "v").collect()]), "domain", ["at"], f"{tmp_path}/mark")
    stream.processAllAvailable()
    stream.stop()
    assert {r[0] for r in held["rows"]} == {"a", "b", "c"}
