import random
import time
from collections import Counter

from pyspark.sql import functions as F

from lodeworks.operators import duplicates as d

DUPE = "def total(items):\n    out = 0\n    for item in items:\n        if item > 3:\n            out = out + item\n    return out\n"
NEAR = "def add_up(values):\n    acc = 0\n    for value in values:\n        if value > 3:\n            acc = acc + value\n    log(acc)\n    return acc\n"


def test_exact_groups(spark, rows):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, ""), (7, "")], "k int, t string")
    assert rows(d.exact_groups(docs, "k", "t")) == [(1, 1, 2), (2, 1, 2), (6, 6, 2), (7, 6, 2)]


def test_symbols(spark, rows):
    s = spark.createDataFrame([("a", DUPE), ("b", DUPE.replace("total", "sum_of")), ("c", NEAR), ("d", "def f():\n    pass\n")], "k string, t string")
    assert rows(d.symbol_copies(s, "k", "t")) == [("a", "a", 2), ("b", "a", 2)]
    assert [(r.a, r.b) for r in d.symbol_duplicates(s, "k", "t", threshold=0.7).collect()] == [("a", "c")]
    assert d.symbol_duplicates(s, "k", "t", threshold=0.99).count() == 0
    assert d.symbol_duplicates(s, "k", "t", threshold=0.1, min_tokens=200).count() == 0


def test_similarity_join_is_exact(spark):
    rnd = random.Random(4)
    sets = {}
    for i in range(60):
        base = set(rnd.sample(range(200), rnd.randint(1, 25)))
        sets[i * 3] = base
        sets[i * 3 + 1] = set(list(base)[: max(1, len(base) - rnd.randint(0, 3))]) | set(rnd.sample(range(200, 260), rnd.randint(0, 2)))
    sets[999] = set()
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k int, f array<bigint>")
    for t in (0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in d.similarity_join(df, "k", "f", t).collect()}
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= t}
        assert got == want


def test_bag_join_is_exact(spark):
    from lodeworks.operators.bags import bag_join

    rnd = random.Random(6)
    # a few tokens in nearly every bag, many rare ones, copies with few changes, one crowd of a size and one very large bag
    common, rare = list("()[].,=+-"), [f"r{i}" for i in range(90)]
    bags = {}
    for i in range(90):
        base = rnd.choices(common, k=rnd.randint(1, 60)) + rnd.sample(rare, rnd.randint(0, 12))
        bags[f"k{i}"] = base
        bags[f"k{i}+"] = base[: max(1, len(base) - rnd.randint(0, 6))] + rnd.choices(common + rare, k=rnd.randint(0, 4))
    bags |= {f"same{i}": ["x"] * 40 + rnd.choices(common, k=4) for i in range(30)}
    bags |= {"empty": [], "large": ["x"] * 70_000 + ["y"], "large+": ["x"] * 69_990 + ["z"] * 30, "half": ["x"] * 4, "odd": ["x"] * 8}
    df = spark.createDataFrame(list(bags.items()), "k string, t array<string>").select("k", d.counted(F.col("t")).alias("f"))
    counts = {k: Counter(v) for k, v in bags.items()}
    for t, block, against in ((0.5, 7, 20), (0.85, 4096, 65_536), (0.85, 5, 11), (1.0, 9, 30)):
        got = sorted((r.a, r.b, r.jaccard) for r in bag_join(df, "k", "f", t, block, against).collect())
        want = [(a, b, round((counts[a] & counts[b]).total() / (counts[a] | counts[b]).total(), 6)) for a in bags for b in bags if a < b and bags[a] and bags[b]]
        assert got == sorted(x for x in want if x[2] >= t)


def test_bags_over_few_tokens_list_no_pairs_to_be_dropped(spark):
    rnd = random.Random(5)
    tokens = "( ) [ ] . , = + - return if for x 1".split()
    rows = [(f"f{i}", " ".join(rnd.choices(tokens, k=60))) for i in range(7000)]
    s = spark.createDataFrame(rows, "k string, t string")
    began = time.time()
    assert 0 < d.symbol_duplicates(s, "k", "t").count() < 2000
    # about 3 s; through shared features a minute and more
    assert time.time() - began < 30


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    docs = [(1, text), (2, text.upper()), (3, text + " tail"), (4, " ".join(words[::-1])), (5, None), (6, ""), (7, "!!!"), (8, "short one"), (9, "Short, one!")]
    got = {r.k: (r.class_id, r.copies, r.links) for r in d.near_duplicates(spark.createDataFrame(docs, "k int, t string"), "k", "t").collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (1, 1, 1), 4: (4, 1, 0), 6: (6, 1, 0), 7: (7, 1, 0), 8: (8, 2, 0), 9: (8, 2, 0)}


def test_contamination(spark, rows):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x y z")], "k int, t string")
    held = spark.createDataFrame([(7, "B C D E F G H I J"), (8, None)], "h int, t string")
    assert rows(d.contamination(docs, "k", "t", held, "h", "t")) == [(1, 7, 1)]


def test_near_copies_of_functions_are_registered(spark, rows, tmp_path):
    from lodeworks.queries.texts import QUERIES

    longer = DUPE + "".join(f"    emit(out, {i})\n" for i in range(9))
    made = [("a", DUPE, "function"), ("b", DUPE.replace("total", "sum_of"), "Method"), ("c", longer, "function"), ("d", longer + "    log(out)\n", "function"), ("e", DUPE, "section")]
    df = spark.createDataFrame(made, "chunk_id string, text string, symbol_kind string")
    df.selectExpr("*", "'p' AS file_path", "1 AS chunk_index", "'f' AS symbol_name", "'' AS docstring", "'' AS layer", "'2024-01-01T00:00:00Z' AS indexed_at").write.parquet(f"{tmp_path}/fts5_index.parquet")
    assert rows(QUERIES["code_near_copies"](spark, str(tmp_path)), "a", "b") == [("c", "d")]
    assert rows(QUERIES["code_classes"](spark, str(tmp_path))) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("d", "d", 1)]


def test_reviews_are_held_out(spark, rows, tmp_path):
    from lodeworks.queries.texts import QUERIES

    run = "one two three four five six seven eight"
    docs = [(1, run + " nine", "issue"), (2, "x " + run, "Review-Comment"), (3, run, "review comment"), (4, "one two", "issue"), (5, run, "glossary"), (6, run, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = rows(QUERIES["review_contamination"](spark, str(tmp_path)))
    assert found == [(d, i, 1) for d in (1, 5, 6) for i in (2, 3)]
