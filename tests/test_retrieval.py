import math
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as tx
from lodeworks.operators import fusion, inverted, lexical, vector
from lodeworks.plans import search
from lodeworks.queries import retrieval


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr).first()[0]


def test_identifiers_and_tokens(spark):
    cases = {"SQLiteDictionary": "SQ Lite Dictionary sq lite dictionary", "get_callers": "get callers", "OCRManager": "OCR Manager ocr manager", "hybridSearchAsync": "hybrid Search Async search async", "a::b->c.d": "a b c d", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", tx.split_identifier("n").alias("w"))
    assert {r.n: r.w for r in df.collect()} == cases
    assert one(spark, tx.tokens("t"), t="Файл x_1 — YES!") == ["файл", "x_1", "yes", ""]
    assert one(spark, tx.token_estimate("t"), t="abc") == 1 and one(spark, tx.token_estimate("t"), t="a" * 9) == 2


def test_query_helpers(spark):
    assert tx.expand_query("find config") == ["find config", "search config", "locate config"]
    assert tx.expand_query("xyz") == ["xyz"]
    kinds = {"def load": "code", "readme guide": "docs", "module layer design": "docs", "hello": "auto", "": "auto"}
    df = spark.createDataFrame([(k,) for k in kinds], "q string").select("q", tx.intent("q").alias("i"))
    assert {r.q: r.i for r in df.collect()} == kinds
    bare, names = tx.mentions("q")
    assert one(spark, bare, q="auth @api @web-ui flow") == "auth flow" and one(spark, names, q="auth @api @web-ui flow") == ["api", "web-ui"]
    assert tx.decompose("load rows and write index; check cache") == ["load rows", "write index", "check cache"]
    assert tx.decompose("load rows") == ["load rows"]
    assert one(spark, tx.key_terms("t"), t="The get_rows return cache_key self abc") == ["get_rows", "cache_key"]


def test_lexical_scores(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red red dog"), (3, None), (4, ""), (5, "cat")], "id bigint, t string")
    top = lexical.lexical_topk(docs, "id", "t", lexical.query_terms(spark, {"q": "red fish"}), 5).collect()
    n = 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    want = {1: idf(2) + 2 * idf(1), 2: 2 * idf(2)}
    assert {r.id: r.score for r in top} == pytest.approx(want, abs=1e-6)
    post = lexical.postings(docs, "id", "t")
    changed = lexical.updated_postings(post, "id", spark.createDataFrame([(1, "dog")], "id bigint, t string"), "t")
    assert {(r.id, r.term) for r in changed.where("id = 1").collect()} == {(1, "dog")}


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalization", "gener"), ("triplicate", "triplic"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("файлы", "файлы")])
def test_porter(word, stem):
    assert lexical.porter_stem(word) == stem


def test_full_text(spark, tmp_path):
    rows = [("a", "hybrid_search", "def hybrid_search(): pass", "Searching of everything"), ("b", "build_index", "def build_index(): pass", None), ("c", "", "calls build_index", "indexes are built")]
    chunks = spark.createDataFrame(rows, "id string, symbol_name string, text string, docstring string")
    index = inverted.InvertedIndex.build(chunks, f"{tmp_path}/i", "id", inverted.CHUNK_FIELDS, ["text"], buckets=3)
    got = inverted.full_text_search(index, {"q": "hybrid_search", "r": "build_index"}).collect()
    first = {r.query_id: r.id for r in got if r["rank"] == 1}
    assert first == {"q": "a", "r": "b"}
    assert {r.id for r in got if r.query_id == "q"} == {"a"}
    asks = spark.createDataFrame([("x", "()"), ("y", "BUILD_"), ("z", "nowhere"), ("e", ""), ("n", None)], "query_id string, phrase string")
    assert sorted(map(tuple, index.containing(asks, "grams", ["symbol_name", "text"]).drop("within").collect())) == [("x", "a"), ("x", "b"), ("y", "b"), ("y", "c")]


def test_bm25_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    texts = {i: " ".join(rnd.choices(["index", "indexes", "vector", "stores", "graph", "Graph"], k=rnd.randint(0, 9))) for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (99, None)], "id bigint, t string")
    index = inverted.InvertedIndex.build(docs, f"{tmp_path}/i", "id", {"d": inverted.Field("stems", ("t",))}, [], buckets=2)
    asks = spark.createDataFrame([("a", "index"), ("a", "graph"), ("b", "store"), ("c", "absent")], "query_id string, stem string")
    bags = {i: [lexical.porter_stem(w) for w in t.lower().split()] for i, t in texts.items() if t}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    want = {}
    for q, s in (("a", "index"), ("a", "graph"), ("b", "store")):
        df = sum(s in b for b in bags.values())
        for i, b in bags.items():
            tf = b.count(s)
            if tf:
                want[q, i] = want.get((q, i), 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / avg))
    assert {(r.query_id, r.id): r.score for r in index.bm25(asks, ["d"]).collect()} == pytest.approx(want)


def test_index_upkeep_equals_a_new_index(spark, tmp_path):
    field = {"t": inverted.Field("words", ("t",))}
    docs = spark.createDataFrame([(1, "red fish"), (2, "red dog"), (3, None), (4, ""), (5, "cat red"), (None, "red")], "id bigint, t string")
    index = inverted.InvertedIndex.build(docs, f"{tmp_path}/a", "id", field, ["t"], buckets=4)
    index.add(spark.createDataFrame([(2, "blue cat"), (7, "red red")], "id bigint, t string")).remove(spark.createDataFrame([(5,), (77,)], "id bigint"))
    index.add(spark.createDataFrame([(7, "fish")], "id bigint, t string"))
    now = spark.createDataFrame([(1, "red fish"), (2, "blue cat"), (3, None), (4, ""), (7, "fish")], "id bigint, t string")
    fresh = inverted.InvertedIndex.build(now, f"{tmp_path}/b", "id", field, ["t"], buckets=7)
    asks = lexical.query_terms(spark, {"x": "red cat", "y": "fish", "z": "none"})
    for one_ in (index, inverted.InvertedIndex.open(spark, f"{tmp_path}/a"), index.compact(f"{tmp_path}/c")):
        assert sorted(map(tuple, one_.docs().select("id", "t").collect()), key=repr) == sorted(map(tuple, now.collect()), key=repr)
        assert sorted(map(tuple, one_.lexical(asks, "t", 9).collect())) == sorted(map(tuple, fresh.lexical(asks, "t", 9).collect())) != []
        assert one_.totals().collect() == fresh.totals().collect()
    assert sorted(map(tuple, lexical.lexical_topk(now, "id", "t", asks, 9).collect())) == sorted(map(tuple, fresh.lexical(asks, "t", 9).collect()))
    # a segment whose writing broke off does not count
    fresh.spark.read.parquet(f"{tmp_path}/b/docs/segment=0").write.partitionBy("bucket").parquet(f"{tmp_path}/b/docs/segment=1")
    assert fresh.docs().count() == 5
    empty = inverted.InvertedIndex.build(docs.limit(0), f"{tmp_path}/e", "id", field, ["t"])
    assert empty.lexical(asks, "t", 3).count() == 0 and empty.fetch(now, ["t"]).count() == 0


def test_a_search_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 50} common") for i in range(300)], "id bigint, t string")
    index = inverted.InvertedIndex.build(docs, f"{tmp_path}/i", "id", {"t": inverted.Field("words", ("t",))}, [], buckets=32)
    hits = index.hits(spark.createDataFrame([("t", "w7")], "field string, term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:200] and "w7" in plan.split("PushedFilters")[1][:300]
    assert hits.count() == 6


def test_fusion(spark, rows):
    a = spark.createDataFrame([("q", i, i) for i in (1, 2, 3)], "g string, k int, rank int")
    b = spark.createDataFrame([("q", 3, 1), ("q", 9, 2)], "g string, k int, rank int")
    got = {r.k: r.score for r in fusion.fused([a, b], "g", "k", 10).collect()}
    assert got[3] == pytest.approx(1 / 63 + 1 / 61, abs=1e-9) and set(got) == {1, 2, 3, 9}
    w = fusion.weighted_fusion(a, b, "g", "k", F.col("k") == 1)
    assert {r.k: r.score for r in w.collect()}[1] == pytest.approx(0.45)
    scores = spark.createDataFrame([("x", 1, 0.1), ("x", 2, 0.5), ("y", 3, 0.1)], "g string, k int, score double")
    assert rows(fusion.score_floor(scores, "g"), "k") == [(2,), (3,)]
    assert rows(scores.select("k", fusion.min_max("score", "g").alias("m"))) == [(1, 0.0), (2, 1.0), (3, 1.0)]
    assert rows(fusion.prepend_missing(a, spark.createDataFrame([("q", 7, 1), ("q", 2, 2)], "g string, k int, rank int"), "g", "k", 2)) == [("q", 1, 2), ("q", 7, 1)]


def test_boosts(spark):
    r = spark.createDataFrame([("q", 1, "a.py", "get_db", "def get_db(", 1.0), ("q", 2, "a.md", "get_db", "get_db", 2.0), ("q", 3, "b.py", "other", "x", 3.0), ("q", 4, "b.py", None, "get_db(1)", 0.5)], "g string, k int, p string, n string, t string, score double")
    got = fusion.exact_boost(r, "g", "k", fusion.exact_name(F.lit("get_db"), F.col("n"), F.col("t")), "p").orderBy("rank").collect()
    assert [(x.k, x.boosted) for x in got] == [(1, True), (3, False), (2, False), (4, False)] and got[0].score == 100.0
    up = fusion.cochange_boost(r.withColumnRenamed("p", "file_path"), spark.createDataFrame([("a.py", "b.py", 0.5)], "file_a string, file_b string, coupling double"), "g", "k")
    assert {x.k: x.score for x in up.collect()} == {1: 1.15, 2: 2.0, 3: 3.45, 4: 0.575}
    weights = spark.createDataFrame([("d/x.PY",), ("x.md",), ("x",), (".env",), (None,)], "p string").select(fusion.bucket_weight("p", F.lit("docs")))
    assert [w[0] for w in weights.collect()] == [0.8, 0.6, 1.0, 1.0, 1.0]


def test_vectors(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], "a"), (4, [0.0, 0.0], "a"), (5, None, "b"), (6, [1.0], "a")], "k int, v array<float>, g string")
    q = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, query_vector array<float>")
    assert [r.k for r in vector.knn(v, "k", "v", q, 2).orderBy("rank").collect()] == [1, 3]
    assert rows(vector.knn(v, "k", "v", q, 1, group="g"), "g", "k") == [("a", 1), ("b", 2)]
    assert rows(v.where("k in (1, 6)").select(vector.fitted("v", 3).alias("f"))) == [([1.0, 0.0, 0.0],), ([1.0, 0.0, 0.0],)]
    assert rows(v.where(vector.not_zero("v")), "k") == [(1,), (2,), (3,), (6,)]
    same = vector.canary(v.where("k <= 3"), v.where("k <= 3"), "k", "v").first()
    assert same["rows"] == 3 and same.mean_cosine == 1.0 and same.degraded == 0.0


def test_mmr_prefers_the_different(spark):
    c = spark.createDataFrame([("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.99, [1.0, 0.001]), ("q", 3, 0.8, [0.0, 1.0]), ("q", 4, 0.0, [0.0, 0.9])], "g string, k int, score double, vector array<float>")
    assert [r.k for r in fusion.mmr(c, "g", "k", 3).orderBy("rank").collect()] == [1, 3, 2]


def test_hybrid_pipeline(spark, tmp_path):
    rows = [(f"c{i}", f"p/f{i}.py", f"fn_{i}", f"def fn_{i}(): load rows {i}", "loads", "core", [float(i), 1.0], i) for i in range(12)] + [("doc", "p/r.md", "fn_3", "fn_3 is described", None, "docs", [3.0, 1.0], 5)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, symbol_name string, text string, docstring string, layer string, vector array<float>, at_us bigint")
    q = spark.createDataFrame([("q", [3.0, 1.0])], "query_id string, query_vector array<float>")
    chunks = inverted.InvertedIndex.build(chunks, f"{tmp_path}/i", "chunk_id", inverted.CHUNK_FIELDS, chunks.columns, buckets=4)
    got = search.hybrid_search(chunks, {"q": "fn_3"}, q, limit=5, trace=True).orderBy("rank").collect()
    assert got[0].chunk_id == "c3" and got[0].boosted and len(got) <= 5
    fast = search.hybrid_search(chunks, {"q": "fn_3"}, q, mode="fast", limit=3, layer="core", since_us=2).collect()
    assert fast and all(r.chunk_id.startswith("c") for r in fast)
    assert search.over_fetch(10) == 20 and search.over_fetch(50) == 50 and search.result_budget(10) == 4
    deep = search.deep_search(chunks, "load rows", limit=4).collect()
    assert len(deep) == 4


def test_query_sets_beyond_one_block(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)], f"row {i % 7}") for i in range(60)]
    df = spark.createDataFrame([*rows, (98, [0.0] * 4, "zero"), (99, None, "none")], "id bigint, v array<float>, t string")
    asks = spark.createDataFrame([(f"q{i}", rows[i % 60][1], "row 0") for i in range(1100)], "query_id string, query_vector array<float>, query_text string")
    few = asks.where("query_id in ('q0', 'q1', 'q2', 'q3', 'q4', 'q5', 'q6')")
    for search_ in (lambda q, **b: vector.knn(df, "id", "v", q, 2, **b), lambda q, **b: vector.context_search(df, "id", "v", "t", q, 2, **b)):
        assert search_(asks).count() == 2200
        assert sorted(search_(few, block=2).collect()) == sorted(search_(few).collect()) != []


def test_query_set_is_every_hundredth_row(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], f"l{i % 2}") for i in range(1, 801)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("vector_knn", "vector_knn_per_label", "cross_project_search", "mmr_rerank", "context_search", "score_floor"):
        found = retrieval.QUERIES[f"{name}_set"](spark, str(tmp_path)).select("query_id").distinct().collect()
        assert {r.query_id for r in found} == {str(i) for i in range(100, 801, 100)}, name


def test_vector_index(spark, tmp_path):
    import numpy as np

    from lodeworks.operators.vector_index import VectorIndex

    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(30, 16))
    x = np.repeat(centres, 40, axis=0) + 0.3 * rnd.normal(size=(1200, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (5000, [0.0] * 16), (5001, None), (None, [1.0] * 16)], "id bigint, v array<float>")
    asks = spark.createDataFrame([(f"{i}", rows[i][1]) for i in range(0, 1200, 10)] + [("zero", [0.0] * 16), ("null", None)], "query_id string, query_vector array<float>")
    index = VectorIndex.build(df, f"{tmp_path}/v", "id", "v")
    want = {(r.query_id, r.id) for r in vector.knn(df.where("id is not null"), "id", "v", asks, 5).collect()}
    exact = index.search(asks, 5, probes=10_000).collect()
    assert {(r.query_id, r.id) for r in exact} == want and len(exact) == 600
    near = {(r.query_id, r.id) for r in VectorIndex.open(spark, f"{tmp_path}/v").search(asks, 5, block=50).collect()}
    assert len(near & want) / len(want) >= 0.9 and len(near) == 600
    empty = VectorIndex.build(df.limit(0), f"{tmp_path}/w", "id", "v")
    assert empty.search(asks, 3).count() == 0
