"""Checksum lists, snapshots and commits against files that change."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from mailward import schema
from mailward.operators.commits import CommitRefused, Results, plan_digest
from mailward.sources import filesets
from mailward.sources.filesets import SnapshotChanged, hashed, hygiene, inventory, listed, snapshot, verified, with_stable_input


def folder_of(path, files):
    for name, data in files.items():
        at = path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return f"file://{path}"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_checksums(spark, tmp_path):
    files = {"a.json": b"{}", "deep/b c.csv": b"x,y\n", "altered.md": b"now", "extra.txt": b"", "twice.txt": b"2"}
    lines = [f"{sha(b'{}')}  a.json", f"{sha(b'x,y' + bytes([10]))}  deep/b c.csv", f"{sha(b'then')}  altered.md", f"{sha(b'gone')}  gone.txt", f"{sha(b'2')}  twice.txt", f"{sha(b'2')}  twice.txt", "no checksum", f"{sha(b'u').upper()}  upper.txt"]
    root = folder_of(tmp_path, {**files, "checksums.sha256": "\n".join(lines).encode()})
    got = {r.name: r.state for r in verified(spark, root).collect()}
    assert got == {"a.json": "ok", "deep/b c.csv": "ok", "altered.md": "altered", "extra.txt": "extra", "gone.txt": "missing", "twice.txt": "repeated", "no checksum": "malformed", f"{sha(b'u').upper()}  upper.txt": "malformed"}
    found = {r.name: (r.sha256, r.bytes, r.media_type) for r in inventory(spark, root).collect()}
    assert found == {n: (sha(d), len(d), {"json": "application/json", "csv": "text/csv", "md": "text/markdown", "txt": "text/plain"}[n.rsplit(".", 1)[1]]) for n, d in files.items()}
    assert [r.value for r in filesets.checksum_lines(hashed(listed(spark, root))).collect()] == [f"{sha(d)}  {n}" for n, d in sorted(files.items())]


def test_files_beyond_a_rows_size(spark, tmp_path):
    """A sparse file above 2 GiB, more than a column can hold, is hashed in pieces."""
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((1 << 31) + 5)
    digest = hashlib.sha256()
    for _ in range(1 << 9):
        digest.update(bytes(1 << 22))
    digest.update(bytes(5))
    r = hashed(listed(spark, f"file://{tmp_path}")).first()
    assert (r.sha256, r.bytes, r.length) == (digest.hexdigest(), (1 << 31) + 5, (1 << 31) + 5)


def test_hygiene(spark):
    names = ["ok.json", ".git/x", "a/.hidden", "x~", "x.BAK", "data.sqlite3", "../up", "/abs", "a\\b", "two  spaces", "..ok"]
    got = {}
    for r in hygiene(spark.createDataFrame([(n,) for n in names], "name string")).collect():
        got.setdefault(r.name, []).append(r.rule)
    assert got == {".git/x": ["hidden"], "a/.hidden": ["hidden"], "x~": ["scratch"], "x.BAK": ["scratch"], "data.sqlite3": ["private"], "../up": ["unsafe"], "/abs": ["unsafe"], "a\\b": ["unsafe"], "two  spaces": ["unsafe"], "..ok": ["hidden"]}


def test_listing(spark, tmp_path):
    root = folder_of(tmp_path, {"a/b/c.txt": b"1", ".hidden/_x": b"", "_SUCCESS": b"", "ü %20 x.md": b"12"})
    (tmp_path / "link.md").symlink_to(tmp_path / "_SUCCESS")
    got = {r.name: (r.length, r.kind) for r in listed(spark, root).collect()}
    assert got == {"a/b/c.txt": (1, "file"), ".hidden/_x": (0, "file"), "_SUCCESS": (0, "file"), "ü %20 x.md": (2, "file"), "link.md": (None, "link")}
    assert {(r.name, r.rule) for r in hygiene(listed(spark, root)).collect()} == {(".hidden/_x", "hidden"), ("link.md", "link")}
    assert {r.name: r.sha256 for r in hashed(listed(spark, root)).collect()}["ü %20 x.md"] == sha(b"12")
    assert listed(spark, f"{root}/none").count() == 0


def table(spark, path):
    spark.range(100).repartition(3).write.parquet(str(path))
    return f"file://{path}"


def test_media_types(spark):
    names = {"LICENSE": "text/plain", "a/LICENSE": "text/plain", "CITATION.cff": "text/yaml", "x.JSON": "application/json", "a.b/c": "application/octet-stream", "x.der": "application/octet-stream"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", filesets.media_type(F.col("name")).alias("t")).collect()
    assert {r.name: r.t for r in rows} == names


def data_file(path):
    return sorted(p for p in path.iterdir() if p.name.endswith(".parquet"))[0]


def test_stable_scan(spark, tmp_path):
    root = table(spark, tmp_path / "t")
    assert with_stable_input(spark, root, lambda s, f: s.read.parquet(f), lambda rows: rows.agg(F.sum("id")).first()[0]) == 4950
    assert snapshot(spark, root).digest == snapshot(spark, root).digest and snapshot(spark, root).unchanged().files == len(list((tmp_path / "t").iterdir()))


@pytest.mark.parametrize(("change", "want"), [("altered", {"altered"}), ("missing", {"missing"}), ("extra", {"extra"}), ("same length and time", {"altered"})])
def test_changes_are_refused(spark, tmp_path, change, want):
    root = table(spark, tmp_path / "t")
    pinned, file = snapshot(spark, root), data_file(tmp_path / "t")

    def tamper():
        if change == "missing":
            file.unlink()
        elif change == "extra":
            (tmp_path / "t" / "part-extra.parquet").write_bytes(file.read_bytes())
        else:
            times, data = os.stat(file), bytearray(file.read_bytes())
            data[len(data) // 2] ^= 1
            file.write_bytes(bytes(data) + (b"" if "same" in change else b"x"))
            if "same" in change:
                os.utime(file, ns=(times.st_atime_ns, times.st_mtime_ns))

    tamper()
    assert {r.change for r in pinned.changes().collect()} == want
    with pytest.raises(SnapshotChanged):
        pinned.unchanged()
    assert snapshot(spark, root).digest != pinned.digest


def test_the_scan_itself_is_pinned(spark, tmp_path):
    root = table(spark, tmp_path / "t")
    pinned, file = snapshot(spark, root), data_file(tmp_path / "t")
    assert pinned.enforced(spark.read.parquet(root)).count() == 100
    (tmp_path / "t" / "part-extra.parquet").write_bytes(file.read_bytes())
    with pytest.raises(Exception, match="not a pinned file"):
        pinned.enforced(spark.read.parquet(root)).agg(F.sum("id")).collect()
    with pytest.raises(Exception, match="pinned|SnapshotChanged"):
        with_stable_input(spark, f"file://{table(spark, tmp_path / 'u')[7:]}", lambda s, f: s.read.parquet(f), lambda rows: (rows.count(), data_file(tmp_path / "u").unlink()))


def results(rows, error=""):
    def full(c):
        if c in ("domain",):
            return F.col(c)
        return (F.lit(error) if c == "error" else F.expr(schema.default(c))).alias(c)

    return rows.select(*[full(c) for c in schema.ALL])


def test_a_repeated_batch_leaves_one_result(spark, tmp_path):
    plan = spark.range(1, 21).select(F.col("id").alias("pos"), F.concat(F.lit("d"), "id").alias("domain"))
    own = Results(spark, f"file://{tmp_path}/r")
    prepared, left = own.prepare("one", plan)
    own.stage(prepared, results(left))  # killed before it commits
    assert own.rows().count() == 0 and own.entries() == []
    first = own.run("one", plan, lambda left: results(left).withColumn("error", F.when(F.col("domain") == "d7", "mx_query_error").otherwise("")))
    assert (first["total"], first["analyzable"], first["errors"]) == (20, 19, 1)
    assert own.run("one", plan, lambda left: pytest.fail("committed batches do nothing")) is None
    again = own.run("two", plan, results)
    assert (again["attempted"], again["total"]) == (1, 1) and own.rows().count() == 20 and own.rows().filter("error <> ''").count() == 0
    assert own.commit(prepared, "ignored", plan)["batch"] == "one" and len(own.entries()) == 2


def test_batches_that_no_longer_fit(spark, tmp_path):
    plan = spark.range(1, 6).select(F.col("id").alias("pos"), F.concat(F.lit("d"), "id").alias("domain"))
    other = plan.withColumn("pos", 6 - F.col("pos"))
    assert plan_digest(plan) == plan_digest(plan.repartition(3)) != plan_digest(other)
    own = Results(spark, f"file://{tmp_path}/r")
    a, left = own.prepare("a", plan)
    b, _ = own.prepare("b", plan)
    staged = own.stage(a, results(left))
    for rows, match in ((results(left.limit(4)), "4 rows"), (results(left.limit(4)).unionByName(results(left.limit(1))), "5 rows of 4"), (results(left.limit(4)).unionByName(results(spark.range(1).select(F.lit("strange").alias("domain")))), "1 of them not attempted")):
        with pytest.raises(CommitRefused, match=match):
            own.commit(a, own.stage(a, rows), plan)
    with pytest.raises(CommitRefused, match="plan"):
        own.commit(a, staged, other)
    own.commit(a, staged, plan)
    with pytest.raises(CommitRefused, match="since"):
        own.commit(b, staged, plan)
    with pytest.raises(CommitRefused, match="taken"):
        own._create(own._entry(0), "{}")
    with pytest.raises(ValueError):
        own.prepare("c", plan.unionByName(plan))
    (tmp_path / "r" / "log" / "00000000.json").rename(tmp_path / "r" / "log" / "00000001.json")
    with pytest.raises(CommitRefused, match="gaps"):
        own.entries()


def test_listing_in_pieces(tmp_path, monkeypatch):
    """A directory's files come in batches of bounded size, whatever their number."""
    import pyarrow as pa

    root = folder_of(tmp_path, {f"p/{i}.html": b"x" * i for i in range(25)})
    monkeypatch.setattr(filesets, "PIECE", 10)
    found = list(filesets._children([pa.RecordBatch.from_pydict({"path": [f"{root}/p"], "name": ["p"]})]))
    assert sorted(b.num_rows for b in found) == [5, 10, 10]
    assert sorted(n for b in found for n in b.column("length").to_pylist()) == list(range(25))
    assert list(filesets._children([pa.RecordBatch.from_pydict({"path": [f"{root}/none"], "name": [""]})])) == []
