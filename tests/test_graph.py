import pytest

from lodeworks.operators import graph as g
from lodeworks.operators.components import connected_components

E = "id bigint, source_id bigint, target_id bigint, type string, weight double, properties string"
N = "id bigint, name string, label string, qualified_name string, file_path string, properties string"


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(i + 1, a, b, kind, 1.0, "{}") for i, (a, b) in enumerate(pairs)], E)


@pytest.fixture(scope="module")
def abcd(spark):
    return edges(spark, [(1, 2), (2, 3), (4, 2)])


def test_shortest_paths(abcd):
    assert g.shortest_path(abcd, 1, 3) == [1, 2, 3]
    assert g.shortest_path(abcd, 3, 1, direction="incoming") == [3, 2, 1]
    assert g.shortest_path(abcd, 3, 2) == []
    assert g.shortest_path(abcd, 3, 4, direction="both") == [3, 2, 4]
    assert g.shortest_path(abcd, 1, 3, max_depth=1) == []
    assert g.shortest_path(abcd, 2, 2) == [2]


def test_bfs_depth_cycles_and_parents(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (None, 2), (3, None)])
    got = {(r.node, r.depth, r.parent) for r in g.neighbours(e, [1], 5).collect()}
    assert got == {(2, 1, 1), (3, 1, 1)}
    assert g.neighbours(e, [99], 3).count() == 0


def test_pagerank(spark, rows):
    one = g.pagerank(spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "a")], "src string, dst string"))
    ranks = {r.node: r["rank"] for r in one.collect()}
    assert max(ranks.values()) == pytest.approx(1.0) and ranks["hub"] == pytest.approx(1.0) and ranks["a"] > ranks["b"]
    assert g.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0
    flat = {r.node: r["rank"] for r in g.pagerank(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), damping=0.5).collect()}
    assert flat["a"] == pytest.approx(flat["b"])


def test_communities(spark):
    pairs = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (10, 11, 1.0), (5, 5, 1.0), (None, 1, 1.0)]
    got = {r.node: r.community for r in g.communities(spark.createDataFrame(pairs, "a bigint, b bigint, weight double")).collect()}
    assert set(got) == {1, 2, 3, 10, 11} and got[1] == got[2] == got[3] != got[10] == got[11]


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (None, 1)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and all(got[200 + i] == 200 for i in range(50)) and len(got) == 61 + 3 + 50
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_impact_and_confidence(spark):
    nodes = spark.createDataFrame([(i, f"f{i}", "Function", f"q{i}", f"D:/x/src/mod{i}/f.py", "{}") for i in range(1, 6)], N)
    e = edges(spark, [(2, 1), (3, 2), (4, 3), (1, 5)])
    r = g.impact(nodes, e, spark.createDataFrame([(1,), (77,)], "start bigint")).orderBy("start").collect()
    assert (r[0].direct_callers, r[0].transitive_callers, r[0].may_break, r[0].review, r[0].files, r[0].modules, r[0].direct_callees) == (1, 2, 1, 1, 3, 3, 1)
    assert r[0].risk == 5 + 4 + 9 + 15 + 2 and r[0].level == "medium" and r[1].risk == 0
    names = spark.createDataFrame([("a", "{}"), ("a.b", "{}"), ("a.b", '{"placeholder": true}'), (None, None)], "n string, p string")
    assert [x[0] for x in names.select(g.call_confidence("n", "p")).collect()] == [1.0, 0.8, 0.5, 1.0]


def test_dead_code_and_report(spark):
    nodes = spark.createDataFrame([(1, "main", "Function", "a", "x.py", None), (2, "used", "function", "b", "x.py", None), (3, "dead", "METHOD", "c", "x.py", '{"line": 7}'), (4, "k", "Class", "d", "x.py", None)], N)
    dead = g.dead_code(nodes, edges(spark, [(1, 2), (1, None)]))
    assert [r.id for r in dead.collect()] == [3]
    assert '"startLine":7' in g.sarif(dead).first().result
    assert g.sarif(dead, spark.createDataFrame([("x.py", 7)], "file_path string, line int")).count() == 0


def test_patterns_of_links(spark, rows):
    p = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 3), (1, 1)], "src bigint, dst bigint")
    assert rows(g.chain_without_shortcut(p)) == [(1, 3, 4), (2, 3, 4)]
    assert rows(g.mutual(p)) == [(3, 4)]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("a", "a")], "src string, dst string")
    assert sorted(r.path for r in g.cycles(ring, 4).collect()) == [["a", "b"], ["a", "b", "c"]]


def test_cascade(spark, rows):
    m = [("a", "OK", None, []), ("b", "OK", None, ["a"]), ("c", "OK", None, ["b"]), ("d", "REFUTED", None, ["a"]), ("e", "OK", None, ["d"]), ("f", "OK", "a", None), ("x", "OK", None, ["y"]), ("y", "OK", None, ["x"]), ("z", None, None, [])]
    memory = spark.createDataFrame(m, "node_id string, status string, superseded_by string, depends_on array<string>")
    assert rows(g.retract(memory, ["a"])) == [("b", 1), ("c", 2), ("f", 1)]
    assert rows(g.retract(memory, ["x"])) == [("y", 1)]


def test_upserts_and_deletes(spark, rows):
    old = spark.createDataFrame([(1, "a", "F", "p.a", "x", "{}"), (2, "b", "F", "p.b", "x", "{}")], N)
    new = spark.createDataFrame([(9, "a2", "F", "p.a", "y", "{}"), (10, "c", "F", "p.c", "y", "{}")], N)
    both = g.upsert_nodes(old, new)
    assert rows(both, "id", "name") == [(1, "a2"), (10, "c"), (2, "b")]
    e = g.upsert_edges(edges(spark, [(1, 2), (2, 77)]), spark.createDataFrame([(9, 1, 2, "CALLS", 5.0, "{}")], E), both)
    assert rows(e, "id", "source_id", "target_id") == [(9, 1, 2)]
    left, kept = g.delete_nodes(both, e, spark.createDataFrame([(2,)], "id bigint"))
    assert rows(left, "id") == [(1,), (10,)] and kept.count() == 0
    assert rows(g.merged_nodes(old, new), "name") == [("a",), ("b",), ("c",)]
    assert rows(g.renamed(old, "a", "z"), "id", "name", "qualified_name") == [(1, "z", "p.z"), (2, "b", "p.b")]


def test_call_resolution(spark, rows):
    nodes = spark.createDataFrame([(i, n, "F", n, "", None) for i, n in enumerate(["run", "A.run", "B.stop", "only"])], N)
    calls = spark.createDataFrame([(1, "run"), (2, "x.stop"), (3, "self.only"), (4, "nothing")], "call_id bigint, callee string")
    assert rows(g.resolve_calls(calls, nodes)) == [(1, 0, "exact"), (2, 2, "suffix"), (3, 3, "suffix"), (4, None, "placeholder")]


def test_claims(spark, rows):
    nodes = spark.createDataFrame([(1, "Load", "F", "l", "src/io.py", None), (2, "open", "F", "o", "x", None)], N)
    claims = spark.createDataFrame([("a", "load", "calls", "Open"), ("b", "load", "calls", "close"), ("c", "load", "imports", "x"), ("d", "load", "defined_in", "io.py"), ("e", "gone", "calls", "x")], "claim_id string, subject string, predicate string, object string")
    got = {r.claim_id: (r.verdict, r.confidence) for r in g.verify_claims(claims, nodes, edges(spark, [(1, 2)])).collect()}
    assert got == {"a": ("confirmed", 0.9), "b": ("contradicted", 0.85), "c": ("unverifiable", 0.3), "d": ("confirmed", 0.9), "e": ("unverifiable", 0.3)}


def test_import_chains_are_registered(spark, rows, tmp_path):
    from lodeworks.queries.graphs import QUERIES

    edges = [(1, 1, 2, "IMPORTS"), (2, 2, 3, " imports"), (3, 2, 4, "IMPORTS"), (4, 1, 4, "IMPORTS"), (5, 1, 2, "IMPORTS"), (6, 3, 5, "DECORATES"), (7, 4, None, "IMPORTS"), (8, 2, 1, "IMPORTS")]
    made = spark.createDataFrame(edges, "id bigint, source_id bigint, target_id bigint, type string").selectExpr("*", "1D AS weight", "'' AS properties", "timestamp'2024-01-01 00:00:00' AS loaded_at")
    made.write.parquet(f"{tmp_path}/graph_edges.parquet")
    assert rows(QUERIES["import_chains"](spark, str(tmp_path)), "a", "b", "c") == [(1, 2, 3)]
    assert rows(QUERIES["import_chain_no_shortcut"](spark, str(tmp_path))) == [(2, 1)]
