import os
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators import indexing as ix
from lodeworks.sources import files as src
from lodeworks.sources.git import GitSource, Repository


def test_drift_and_prune(spark, rows):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None)], "file_path string, file_hash string")
    index = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("n", None)], "file_path string, file_hash string")
    assert rows(ix.drift(disk, index)) == [("a", "fresh"), ("b", "stale"), ("c", "orphan"), ("n", "fresh")]
    assert rows(ix.prune(index, disk), "file_path") == [("a",), ("b",), ("n",)]
    with pytest.raises(ValueError, match="refusing"):
        ix.prune(index, disk.where("file_path = 'a'"))
    assert rows(ix.changed_files(disk, index), "file_path") == [("b",), ("n",)]
    new = spark.createDataFrame([("a", "9", 1)], "file_path string, file_hash string, extra int")
    assert rows(ix.upsert_by_file(index, new), "file_path", "file_hash", "extra") == [("a", "9", 1), ("b", "x", None), ("c", "3", None), ("n", None, None)]
    assert rows(ix.upsert_by_file(index, new.limit(0), spark.createDataFrame([("c",)], "file_path string")), "file_path") == [("a",), ("b",), ("n",)]
    moves = index.sparkSession.createDataFrame([("a", "z"), ("./a", "zz"), (None, "q")], "old_path string, new_path string")
    assert rows(ix.moved(index, moves), "file_path") == [("b",), ("c",), ("n",), ("z",)]


def test_guards(spark):
    names = [("src/a.py", 10, True), ("src/a.min.js", 10, False), ("node_modules/x/a.js", 10, False), ("a.exe", 1, False), ("big.py", 2 << 20, False), ("sub\\dist\\a.js", 1, False), ("distance/a.js", 1, True)]
    df = spark.createDataFrame(names, "p string, n bigint, want boolean")
    assert all(r[0] == r[1] for r in df.select(ix.safe_to_index("p", "n"), "want").collect())
    raw = spark.createDataFrame([(bytearray(b"abc\x00"), True), (bytearray(b"x" * 600), True), (bytearray(b"ok\n"), False), (bytearray(b""), False), (bytearray(b"\x10\x0a"), False)], "c binary, want boolean")
    assert all(r[0] == r[1] for r in raw.select(ix.looks_binary("c"), "want").collect())
    texts = [(bytearray("\ufeffhé".encode()), "hé"), (bytearray("привет".encode("cp1251")), "привет"), (bytearray("né".encode("latin-1")), "né"), (bytearray("привет".encode()), "привет")]
    assert all(r[0] == r[1] for r in spark.createDataFrame(texts, "c binary, want string").select(ix.decoded("c"), "want").collect())


@pytest.mark.parametrize(("pattern", "hits", "misses"), [("*.log", ["a.log", "x/b.log"], ["a.log.txt"]), ("build/", ["build/a", "x/build/b"], ["build"]), ("/top", ["top", "top/a"], ["x/top"]), ("a/**/b", ["a/b", "a/x/y/b"], ["b"]), ("# c", [], ["# c"]), ("f?o", ["foo"], ["fo"])])
def test_ignore_patterns(spark, pattern, hits, misses):
    df = spark.createDataFrame([(p, True) for p in hits] + [(p, False) for p in misses], "p string, want boolean")
    assert all(r[0] == r[1] for r in df.select(ix.ignored("p", [pattern]), "want").collect())


def test_schema_retention_health(spark, rows):
    want = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame([("a", 1.5)], "id string, x double")
    assert ix.schema_problems(df, want) == ["n is missing"]
    assert rows(ix.with_schema(df, want, {"n": 7})) == [("a", 7)]
    arts = spark.createDataFrame([("log", "2025-01-01"), ("log", "2025-03-01"), ("x", "2020-01-01")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert ix.retained(arts, "k", "ts", "2025-03-10", {"log": 30}).count() == 2
    checks = spark.createDataFrame([("a", "ok", ""), ("b", "warning", "")], "component string, severity string, message string")
    assert ix.health_rollup(checks).first().state == "degraded" and ix.health_rollup(checks.limit(0)).first().state == "healthy"


def test_versioned_tables(spark, tmp_path, rows):
    base = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1,)], "a int")
    for _ in range(3):
        ix.swap_table(df, base)
    os.makedirs(tmp_path / "t" / "v000009")  # a write that never ended
    assert rows(ix.current_table(spark, base)) == [(1,)]
    ix.drop_old_versions(spark, base, 1)
    assert sorted(p for p in os.listdir(tmp_path / "t")) == ["v000003", "v000009"]


def test_source_tree(spark, tmp_path, rows):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "empty.py").write_text("# only a comment\n")
    (tmp_path / "pkg" / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "skip.py").write_text("y = 2\n")
    got = src.source_files(spark, str(tmp_path), ["skip*"])
    assert rows(got, "file_path", "text") == [("pkg/a.py", "x = 1\n")]
    src.append_ledger(spark.createDataFrame([("a", 1)], "k string, ts int"), str(tmp_path / "led"))
    src.append_ledger(spark.createDataFrame([("b", 2)], "k string, ts int"), str(tmp_path / "led"))
    assert rows(src.ledger_tail(src.ledger(spark, str(tmp_path / "led"), "k string, ts int"), "ts", 1)) == [("b", 2)]


@pytest.mark.parametrize("packed", [False, True])
def test_git(spark, tmp_path, packed, rows):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x", "-c", "commit.gpgsign=false", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / "a.txt").write_text("line\n" * 50 + str(i))
        (tmp_path / f"f{i}.txt").write_text(str(i))
        git("add", "-A")
        git("commit", "-q", "-m", f"Commit {i}\n\nbody {i}")
    if packed:
        git("gc", "-q", "--aggressive")
        assert Repository(str(tmp_path)).packs
    spark.dataSource.register(GitSource)
    log = spark.read.format("git_commits").option("commits_per_partition", 2).load(str(tmp_path))
    assert rows(log, "message", "author", "body", "files") == [(f"Commit {i}", "Ann", f"body {i}", ["d/a.txt", f"f{i}.txt"]) for i in range(3)]
