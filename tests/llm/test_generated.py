import random
import threading
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeworks.llm import generated as g

WORDS = "index cache graph vector chunk offset branch symbol limit writer reader table budget".split()


def hand(rnd):
    out = ["import json", ""]
    for _ in range(rnd.randint(2, 6)):
        name = "_".join(rnd.sample(WORDS, 2))
        out += [f"def {name}(rows, limit={rnd.randint(1, 50)}):", f'    """{rnd.choice(WORDS).title()} the {rnd.choice(WORDS)} of each {rnd.choice(WORDS)} before it is used."""', f"    for item in {rnd.choice(WORDS)}:", f"        {rnd.choice(WORDS)}.append(item.{rnd.choice(WORDS)})", "    return rows", ""]
    return "\n".join(out)


def made(rnd):
    name = "_".join(rnd.sample(WORDS, 2)).upper()
    return "\n".join(f"_{name}_{rnd.choice(WORDS).upper()}{i} = _D(name='{rnd.choice(WORDS)}{i}', number={i}, type={rnd.randint(0, 16)})" for i in range(rnd.randint(40, 120)))


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.go", "// Code generated by x 1.2. DO NOT EDIT.\npackage a", (True, False)), ("a.py", "# do not edit the cache by hand while the worker runs\nx = 1", (False, False)), ("a.py", "# loads generated stubs and checks which were generated by the tool\n", (False, False)),
        ("a.py", "# Этот файл создан автоматически, правки будут потеряны", (True, False)), ("a.ts", "// 本文件由 x 自动生成，请勿手动修改", (True, False)), ("a.js", "x;\n//# sourceMappingURL=a.map", (True, False)), ("a.js", "/* symbol build 1.0.7 */\nx", (True, False)),
        ("a.rs", "// Vendored from pathwalkr 2.2.6, local changes: none", (False, True)), ("a.rs", "// the vendor field is optional for minified inputs", (False, False)), ("a_pb2.py", "x", (True, False)), ("a.py", 's = "Code generated by x. DO NOT EDIT."', (False, False)), ("a.min.js", None, (True, False)),
    ],
)
def test_notices(path, text, want):
    assert g.notices(path, text) == want


@pytest.mark.parametrize(("path", "want"), [("p/vendor/x/a.go", (True, False)), ("p/src/vendor_portal/a.go", (False, False)), ("p/src/core/vendors/a.py", (False, False)), ("p/lib/hashmesh-2.4.4/a.go", (True, False)), ("p\\node_modules\\x.js", (True, False)), ("p/dist/a.js", (False, True)), ("p/app/distance/a.js", (False, False)), ("p/src/generated_reports/a.py", (False, False)), (None, (False, False))])
def test_paths(path, want):
    assert g.by_path(path) == want


def test_constants():
    assert g.is_constant("a.py", "X_DATA = [\n" + "    0x7e, 0xf4,\n" * 60 + "]\n")
    assert g.is_constant("a.go", "var XData = []any{\n" + '    {"id": 0, "w": 0.3},\n' * 60 + "}\n")
    assert g.is_constant("a.rs", "// lookup\npub const X: &[Item] = &[\n" + "    23527, 43853,\n" * 60 + "];\n")
    assert not g.is_constant("a.py", "import json\nx = 1\n" + "y = f(x)\n" * 100)
    assert not g.is_constant("a.py", "X = [1]") and not g.is_constant("a.py", "")


def test_hidden_notices_do_not_feed_the_features():
    body = hand(random.Random(1))
    assert g.features("a.py", "# Code generated by x. DO NOT EDIT.\n" + body) == g.features("a.py", body)
    assert g.features("a.py", "") == [0.0] * len(g.FEATURES) and g.features(None, "x y") != g.features("a.py", "")
    assert len(g.features("a.js", "x" * 300_000)) == len(g.FEATURES)


SCHEMA = "id string, p string, t string, score int, reason string"


def test_forest_finds_what_bears_no_notice(spark):
    rnd = random.Random(7)
    rows = [(f"h{i}", f"p/src/h{i}.py", hand(rnd), 0, "") for i in range(150)]
    rows += [(f"n{i}", f"p/src/n{i}.py", "# Autogenerated at build time by x\n" + made(rnd), 0, "") for i in range(40)]
    rows += [(f"u{i}", f"p/src/u{i}.py", made(rnd), 0, "") for i in range(15)]
    third = hand(rnd)
    rows += [("v", "p/vendor/x/v.py", third, 0, ""), ("c", "p/src/copy.py", third.replace("\n", "\r\n"), 0, ""), ("m", "p/vendor/x/README.md", "words", 0, ""), ("z", "p/vendor/x/z.py", None, 0, ""), ("q", "p/src/q.py", None, 0, ""), ("w", "p/src/w.min.js", None, 0, ""), ("e", "p/src/e.py", "  \n", 0, "")]
    found = g.not_written_by_hand(g.describe(spark.createDataFrame(rows, SCHEMA), "id", "p", "t")).collect()
    got = {r.key: r.reason for r in found}
    assert all(got.get(f"n{i}") == "generated" for i in range(40))
    assert sum(f"u{i}" in got for i in range(15)) >= 14
    assert sum(f"h{i}" in got for i in range(150)) <= 1
    assert (got["v"], got["c"], got["z"], got["w"]) == ("vendored", "copy", "vendored", "path")
    assert not {"m", "q", "e"} & got.keys()


def test_without_labels_and_without_rows(spark):
    rows = [("a", "a.py", "x = 1\n", 0, ""), ("b", "b/vendor/b.py", "y = 1\n", 0, "")]
    found = g.not_written_by_hand(g.describe(spark.createDataFrame(rows, SCHEMA), "id", "p", "t"))
    assert [(r.key, r.reason) for r in found.collect()] == [("b", "vendored")]
    assert g.not_written_by_hand(g.describe(spark.createDataFrame([], SCHEMA), "id", "p", "t")).count() == 0


def test_every_row_teaches(spark):
    # what the labelled rows of the highest hashes show, no others do
    kind = F.when(F.col("id") >= 11_500, 3.0).otherwise(F.when(F.row_number().over(Window.partitionBy(F.col("id") >= 11_500).orderBy(F.xxhash64("file_path"))) > 10_000, 5.0).otherwise(1.0))
    rows = spark.range(14_500).withColumn("file_path", F.concat(F.lit("p/"), F.col("id"), F.lit(".py"))).withColumn("kind", kind)
    rows = rows.unionByName(spark.createDataFrame([(20_000, "q/a.py", 5.0), (20_001, "q/b.py", 1.0), (20_002, "q/c.py", 3.0)], "id bigint, file_path string, kind double"))
    x = F.array_repeat("kind", len(g.FEATURES))
    made = (F.col("id") < 11_500).alias("made")
    no = F.lit(False)
    described = rows.select(F.col("id").cast("string").alias("key"), "file_path", F.lit(True).alias("has_text"), made, no.alias("copied"), no.alias("vendored"), no.alias("made_path"), F.col("file_path").alias("content"), x.alias("x"))
    found = {r.key for r in g.not_written_by_hand(described).collect()}
    assert {"20000", "20001"} <= found and "20002" not in found and len(found) == 11_502


def test_bounds_and_threshold_come_from_all_rows(spark):
    width = len(g.FEATURES)
    rows = spark.range(6400).select(F.concat(F.array(F.col("id") + 1.0, F.lit(7.0), (F.col("id") % 3).cast("double")), F.array_repeat(F.lit(0.0), width - 3)).alias("x"))
    edges = g._edges(rows)
    assert edges[0] == [100 * i + 0.5 for i in range(1, 64)] and edges[1] == [] and edges[2] == [0.5, 1.5]
    assert edges == g._edges(rows.repartition(7))
    binned = rows.select(g._binned(edges).alias("x")).groupBy(F.col("x")[0]).count().collect()
    assert sorted(tuple(r) for r in binned) == [(float(i), 100) for i in range(64)]
    pos, neg = [0.6, 0.7, 0.9], [0.0, 0.1, 0.45]
    below = [[sum(s < t for s in part) for t in g.GRID] for part in (pos, neg)]
    assert g.least_wrong(below[0], 3, below[1], 3) == g.GRID[33]  # of 0.46 to 0.59


def test_forests_grow_one_after_another(spark, monkeypatch):
    # several at once took more than the driver's memory
    lock, now, most, sizes = threading.Lock(), 0, 0, []

    def grow(rows, n):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        sizes.append((rows.count(), n))
        time.sleep(0.2)
        with lock:
            now -= 1
        return n

    monkeypatch.setattr(g, "_grow", grow)
    rows = spark.range(30).select((F.col("id") % 3 == 0).cast("double").alias("label"), (F.col("id") % g.FOLDS).alias("fold"))
    assert g._grow_without_each(rows, *g._counts(rows)) == [24] * g.FOLDS
    assert most == 1 and sizes == [(24, 24)] * g.FOLDS
