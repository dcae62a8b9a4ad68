import pytest
from pyspark.sql import functions as F

from lodeworks.operators import context as cx
from lodeworks.operators import graph as gr
from lodeworks.operators import indexing, inverted, memory

N = "id bigint, name string, label string, qualified_name string, file_path string, properties string"
E = "id bigint, source_id bigint, target_id bigint, type string, weight double, properties string"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(1, "load", "Function", "m.load", "p/core/load.py", '{"line": 4}'), (2, "save", "function", "m.save", "p/core/load.py", None), (3, "Store", "Class", "m.Store", "p/core/store.py", "{broken"), (4, None, "Method", None, None, None)]
    edges = [(1, 1, 2, "CALLS", 1.0, None), (2, 3, 1, "calls", None, None), (3, 2, 1, "CALLS", 1.0, None), (4, 1, 1, "CALLS", 1.0, None), (5, 1, 9, "CALLS", 1.0, None), (6, None, 1, "CALLS", 1.0, None)]
    return spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)


def test_symbols_and_chains(graph, rows):
    nodes, edges = graph
    assert rows(cx.symbol_context(nodes, edges)) == [(1, 2, 1, 1), (2, 1, 1, 1), (4, 0, 0, 0)]
    assert [r.id for r in cx.symbols_in_file(nodes, "p/core/load.py").collect()] == [2, 1]
    assert rows(cx.find_nodes(nodes, "FUNCTION", "A"), "id") == [(1,), (2,)] and rows(cx.find_nodes(nodes, offset=3), "id") != []
    assert rows(cx.call_chain(nodes, edges, "load", "incoming", 2), "node", "depth") == [(2, 1), (3, 1)]
    assert rows(cx.topology(nodes, edges)) == [("p/core/load.py", 2, 0, 4)]


def test_related_tests_and_reports(spark, graph, rows):
    files = spark.createDataFrame([("a/load.py",), ("t/test_load.py",), ("t/test_load_all.py",), ("t/loader_test.go",), ("a/loader.go",), ("w/load.spec.ts",), (None,), ("t/test_.py",), ("a/load.py",)], "file_path string")
    assert rows(cx.related_tests(files)) == [("a/load.py", "t/test_load.py"), ("a/load.py", "t/test_load_all.py"), ("a/load.py", "w/load.spec.ts"), ("a/loader.go", "t/loader_test.go")]
    nodes, edges = graph
    report = cx.feature_report(nodes, edges, spark.createDataFrame([(1,), (1,), (77,)], "start bigint"), spark.createDataFrame([("p/core/load.py", "t")], "file_path string, test string"), spark.createDataFrame([("p/core/load.py", 3)], "file_path string, bugs bigint"))
    (r,) = report.collect()
    assert (r.start, r.tests, r.bugs, r.direct_callers) == (1, 1, 3, 2)


def test_nearest_names(spark, rows):
    lost = spark.createDataFrame([("lod_rows",), ("merge_ranks_of_all",), ("abc",), (None,), ("zzzzzzzz",)], "name string")
    names = spark.createDataFrame([("load_rows",), ("load_row",), ("merge_rank_of_all",), ("emrge_ranks_of_al",), ("abd",), (None,)], "name string")
    assert rows(cx.nearest_names(lost, names)) == [("lod_rows", "load_rows", 1), ("merge_ranks_of_all", "merge_rank_of_all", 1)]
    assert rows(cx.nearest_names(lost, names, k=5)) == [("lod_rows", "load_row", 2), ("lod_rows", "load_rows", 1), ("merge_ranks_of_all", "emrge_ranks_of_al", 3), ("merge_ranks_of_all", "merge_rank_of_all", 1)]


def test_stamps_drift_and_fallback(spark, rows):
    hits = spark.createDataFrame([("a/vendor/x.py", "x"), ("b\\R.MD", "y"), ("c.go", "z"), (None, None)], "p string, t string")
    assert rows(cx.stamped(hits, "p", "t"), "trust") == [("code",), ("docs",), ("external",), ("unknown",)]
    assert rows(hits.where(cx.real_result("t", "p")), "t") == [("x",), ("y",), ("z",)]
    noted = spark.createDataFrame([("d", "f", "aaaaaaaa1"), ("d", "g", "bbbbbbbb")], "doc string, symbol string, hash string")
    now = spark.createDataFrame([("f", "aaaaaaaa2"), ("g", "cccccccc")], "symbol string, hash string")
    assert rows(cx.drifted(noted, now)) == [("d", "g", "bbbbbbbb", "cccccccc")]
    assert rows(cx.keyword_fallback(hits, "p", "t", "of x y zz"), "p") == [] and rows(cx.keyword_fallback(hits.withColumn("t", F.lit("Index the rows")), "p", "t", "index of rows", 2), "hits") == [(2,), (2,)]
    found = spark.createDataFrame([("a", "f"), ("b", "f"), ("b", "g"), ("a", "f"), ("c", None)], "query_id string, file_path string")
    assert rows(cx.subquery_relations(found)) == [("a", "b", 1)]
    kinds = spark.createDataFrame([("x", "y", "cochange", 2.0), ("x", "z", "cochange", 1.0)], "file_a string, file_b string, kind string, weight double")
    assert rows(cx.relation_summary(kinds)) == [("cochange", 2, 3, 3.0)]


def test_cycles_of_any_length(spark, rows):
    ring = [(i, i % 9 + 1) for i in range(1, 10)]
    pairs = spark.createDataFrame([*ring, (20, 21), (21, 20), (5, 20), (30, 30), (1, 40), (40, 41), (None, 1)], "src bigint, dst bigint")
    assert rows(gr.on_cycles(pairs)) == sorted([(i, 1) for i in range(1, 10)] + [(20, 20), (21, 20)], key=repr)
    assert gr.on_cycles(pairs.where("src > 29")).count() == 0 and gr.on_cycles(pairs.limit(0)).count() == 0


def test_a_common_name_is_no_product(spark, rows):
    """A name of many nodes and many calls: each call gets the smallest ids, and no row more is made."""
    nodes = spark.range(3000).select(F.col("id"), F.lit("get").alias("name"))
    calls = spark.range(2000).select(F.col("id").alias("call_id"), F.when(F.col("id") % 2 == 0, "get").otherwise("x.get").alias("callee"))
    got = gr.resolve_calls(calls, nodes)
    assert got.count() == 10_000 and rows(got.groupBy("how").count()) == [("exact", 5000), ("suffix", 5000)]
    assert rows(got.select("target_id").distinct()) == [(i,) for i in range(5)]


def test_claims_need_the_name(spark, graph, rows):
    nodes, edges = graph
    claims = spark.createDataFrame([("a", "load", "calls", "save"), ("b", "load", "calls", "sav"), ("c", "load", "defined_in", "core/load.py"), ("d", "load", "defined_in", "ore/load.py"), ("e", "nobody", "calls", "x")], "claim_id string, subject string, predicate string, object string")
    assert rows(gr.verify_claims(claims, nodes, edges), "claim_id", "verdict") == [("a", "confirmed"), ("b", "contradicted"), ("c", "confirmed"), ("d", "contradicted"), ("e", "unverifiable")]


def test_a_move_reaches_every_layer(spark, tmp_path, rows):
    chunks = spark.createDataFrame([("1", "src\\core\\a.py", "text of a", "a", "core"), ("2", "src/b.py", "text of b", "b", "root")], "chunk_id string, file_path string, text string, module_name string, layer string")
    nodes = spark.createDataFrame([(1, "src/core/a.py"), (2, None)], "id bigint, file_path string")
    index = inverted.InvertedIndex.build(chunks, f"{tmp_path}/i", "chunk_id", {"text": inverted.Field("words", ("text",))}, chunks.columns, buckets=2)
    moves = spark.createDataFrame([("./src/core/a.py", "src\\mcp\\z.py")], "old_path string, new_path string")
    c, n = indexing.apply_file_moves(chunks, nodes, index, moves)
    want = [("1", "src/mcp/z.py", "z", "mcp"), ("2", "src/b.py", "b", "root")]
    assert rows(c, "chunk_id", "file_path", "module_name", "layer") == want == rows(index.docs(), "chunk_id", "file_path", "module_name", "layer")
    assert rows(n) == [(1, "src/mcp/z.py"), (2, None)]
    assert rows(index.fetch(c.where("chunk_id = '1'"), ["text"])) == [("1", "text of a")]


def test_causes_with_commits(spark, rows):
    incidents = spark.createDataFrame([("i", "cache broken after update", "stale key", True)], "incident_id string, symptom string, root_cause string, success boolean")
    symptoms = spark.createDataFrame([("s", "the cache looks broken")], "symptom_id string, text string")
    commits = spark.createDataFrame([("c1", "fix broken cache"), ("c2", "add docs")], "hash string, message string")
    assert rows(memory.root_causes(incidents, symptoms, commits)) == [("s", "commit c1", 2), ("s", "stale key", 4)]
