import random

import pytest

from lodeworks.plans.cypher import CypherError, cypher, parse

NODES = [
    (1, "main", "Function", "p.main", "app.py", "{}"), (2, "parse", "Function", "p.parse", "parser.py", '{"line": 4}'), (3, "validate", "Function", "p.validate", "validator.py", '{"line": 40}'),
    (4, "render", "Function", "p.render", "view.py", "not json"), (5, "log_error", "Function", "p.log_error", "logger.py", None), (6, "config", "Variable", "p.config", "config.py", "{}"), (7, "db_conn", "Variable", "p.db_conn", None, "{}"),
]
EDGES = [(1, 1, 2, "CALLS", 1.0, "{}"), (2, 1, 3, "CALLS", 1.0, "{}"), (3, 2, 4, "CALLS", 1.0, "{}"), (4, 3, 5, "CALLS", 2.0, "{}"), (5, 2, 6, "USAGE", None, "{}"), (6, 3, 7, "USAGE", 1.0, "{}")]
N = "id bigint, name string, label string, qualified_name string, file_path string, properties string"
E = "id bigint, source_id bigint, target_id bigint, type string, weight double, properties string"
LABELS, TYPES = {"Function", "Variable", "File"}, {"CALLS", "USAGE"}


@pytest.fixture(scope="module")
def ask(spark):
    nodes, edges = spark.createDataFrame(NODES, N), spark.createDataFrame(EDGES, E)
    return lambda q: sorted((tuple(r) for r in cypher(nodes, edges, q, LABELS, TYPES).collect()), key=repr)


def test_counts(ask):
    assert ask("MATCH (f:Function) RETURN count(*)") == [(5,)]
    assert ask("MATCH (n) RETURN count()") == [(7,)]
    assert ask("MATCH (n) RETURN count(n) AS c") == [(7,)]
    assert ask("MATCH (f:FUNCTION) RETURN count(*) AS c") == [(5,)]
    assert ask("MATCH (n) RETURN n.label AS l, count(*) AS c, collect(n.id) AS ids")[0][:2] == ("Function", 5)


def test_hops_and_directions(ask):
    assert ask("MATCH (a)-[:CALLS]->(b) RETURN a.name, b.name") == [("main", "parse"), ("main", "validate"), ("parse", "render"), ("validate", "log_error")]
    assert ask("MATCH (a {name: 'parse'})<-[:CALLS]-(b) RETURN b.name") == [("main",)]
    assert ask("MATCH (a {name: 'parse'})-[:CALLS]-(b) RETURN b.name") == [("main",), ("render",)]
    assert ask("MATCH (a)-[:CALLS]->(b)-[:USAGE]->(c) RETURN a.name, c.name") == [("main", "config"), ("main", "db_conn")]
    assert ask("MATCH (a {name: 'main'})-[:CALLS*1..2]->(b) RETURN b.name") == [("log_error",), ("parse",), ("render",), ("validate",)]
    assert ask("MATCH (a {name: 'main'})-[:CALLS*2]->(b) RETURN b.name") == [("log_error",), ("render",)]
    assert ask("MATCH (a)-[r:CALLS]->(b) WHERE r.weight > 1 RETURN a.name, r.type") == [("validate", "CALLS")]


def test_optional(ask):
    base = "MATCH (f:Function)-[:CALLS]->(g:Function) OPTIONAL MATCH (g)-[:USAGE]->(v:Variable) "
    assert ask(base + "RETURN v.name") == [("config",), ("db_conn",), (None,), (None,)]
    assert len(ask(base + "WHERE v IS NOT NULL RETURN v.name")) == 2
    assert len(ask(base + "WHERE v IS NULL RETURN v.name")) == 2
    assert ask("MATCH (f:Function)-[:CALLS]->(g) OPTIONAL MATCH (g)-[:NOTHING]->(v) RETURN v.name") == [(None,)] * 4


def test_logic_and_precedence(ask):
    assert ask("MATCH (f) WHERE f.name = 'main' OR f.name = 'parse' AND f.label = 'Variable' RETURN f.name") == [("main",)]
    assert ask("MATCH (f) WHERE (f.name = 'main' OR f.name = 'parse') AND f.label = 'Function' RETURN f.name") == [("main",), ("parse",)]
    assert ask("MATCH (f:Function) WHERE NOT (f.name CONTAINS 'r' AND f.name CONTAINS 'e') RETURN f.name") == [("main",), ("validate",)]
    assert ask("MATCH (f) WHERE f.name STARTS WITH 'db' XOR f.name ENDS WITH 'g' RETURN f.name") == [("config",), ("db_conn",)]
    assert ask("MATCH (f) WHERE f.name IN ['main', 'config'] AND f:Variable RETURN f.name") == [("config",)]
    assert ask("MATCH (f) WHERE f.name =~ '.*a.*e' RETURN f.name") == [("parse",), ("validate",)]
    assert ask("MATCH (f) WHERE f.line > 10 RETURN f.name") == [("validate",)]
    assert ask("MATCH (f) WHERE f.name CONTAINS '%' RETURN f.name") == []
    # unknown stays unknown under NOT
    assert ask("MATCH (f:Variable) WHERE NOT f.file_path = 'x' RETURN f.name") == [("config",)]


def test_exists(ask):
    assert ask("MATCH (f:Function) WHERE EXISTS { (f)-[:USAGE]->() } RETURN f.name") == [("parse",), ("validate",)]
    assert ask("MATCH (f:Function) WHERE NOT EXISTS { (g)-[:CALLS]->(f) } RETURN f.name") == [("main",)]
    assert ask("MATCH (f:Function) WHERE f.name = 'render' OR EXISTS { (f)-[:USAGE]->() } RETURN f.name") == [("parse",), ("render",), ("validate",)]
    assert ask("MATCH (f:Function) WHERE (f)-[:USAGE]->(:Variable) RETURN f.name") == [("parse",), ("validate",)]


def test_shared_variables_and_order(ask, spark):
    assert ask("MATCH (a)-[:CALLS]->(b), (b)-[:CALLS]->(c) RETURN a.name, c.name") == [("main", "log_error"), ("main", "render")]
    assert ask("MATCH (a)-[:CALLS]->(b) MATCH (x:Variable) RETURN count(*) AS n") == [(8,)]
    q = cypher(spark.createDataFrame(NODES, N), spark.createDataFrame(EDGES, E), "MATCH (a)-[:CALLS]->(b) RETURN a.name AS n, count(*) AS c ORDER BY count(*) DESC, n SKIP 1 LIMIT 1")
    assert [tuple(r) for r in q.collect()] == [("parse", 1)]
    assert len(ask("MATCH (a)-[:CALLS]->(b) RETURN DISTINCT a.label")) == 1
    whole = cypher(spark.createDataFrame(NODES, N), spark.createDataFrame(EDGES, E), "MATCH (a:Variable) RETURN a")
    assert whole.columns[:2] == ["a.id", "a.name"]


@pytest.mark.parametrize(
    "q",
    ["MATCH (a:Nope) RETURN a", "MATCH (a)-[:NOPE]->(b) RETURN a", "MATCH (a) WHERE cycle(a) RETURN a", "RETURN 1", "MATCH (a)-[:CALLS*]->(b) RETURN a", "MATCH (a)-[:CALLS*2..]->(b) RETURN a", "MATCH (a) RETURN b.name", "MATCH (a RETURN a", "MATCH (a) RETURN a.name AS x, a.id AS x", "MATCH (a) RETURN a.name ; drop", ""],
)
def test_errors(ask, q):
    with pytest.raises(CypherError):
        ask(q)


def test_undirected_does_not_return_the_start(spark):
    nodes = spark.createDataFrame([(1, "a", "F", "a", "", None), (2, "b", "F", "b", "", None)], N)
    edges = spark.createDataFrame([(1, 1, 2, "T", 1.0, None), (2, 1, 1, "T", 1.0, None), (3, None, 2, "T", 1.0, None)], E)
    got = sorted(tuple(r) for r in cypher(nodes, edges, "MATCH (x)-[:T]-(y) RETURN x.name AS x, y.name AS y").collect())
    assert got == [("a", "a"), ("a", "b"), ("b", "a")]


def _eval(e, row):
    kind = e[0]
    if kind == "cmp":
        a, b = row.get(e[2][2]), e[3][1]
        return None if a is None else a == b if e[1] == "=" else a != b
    if kind == "null":
        return row.get(e[1][2]) is None
    if kind == "not":
        v = _eval(e[1], row)
        return None if v is None else not v
    a, b = _eval(e[1], row), _eval(e[2], row)
    if kind == "and":
        return False if a is False or b is False else None if a is None or b is None else True
    return True if a is True or b is True else None if a is None or b is None else False


@pytest.mark.parametrize("seed", range(4))
def test_random_conditions_against_an_evaluator(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.choice(["x", "y", None]), rnd.choice(["x", "z", None]), f"q{i}", rnd.choice(["x", "y", None]), None) for i in range(40)]
    nodes, edges = spark.createDataFrame(data, N), spark.createDataFrame([], E)

    def text(depth):
        k = rnd.random()
        if depth == 0 or k < 0.3:
            prop = rnd.choice(["name", "label", "file_path"])
            return rnd.choice([f"n.{prop} = '{rnd.choice('xyz')}'", f"n.{prop} <> '{rnd.choice('xyz')}'", f"n.{prop} IS NULL"])
        if k < 0.45:
            return f"NOT ({text(depth - 1)})"
        return f"({text(depth - 1)}) {rnd.choice(['AND', 'OR'])} ({text(depth - 1)})"

    for _ in range(4):
        q = f"MATCH (n) WHERE {text(3)} RETURN n.id AS id"
        tree = parse(q).where
        want = sorted(d[0] for d in data if _eval(tree, dict(zip(["id", "name", "label", "qualified_name", "file_path", "properties"], d))) is True)
        assert sorted(r.id for r in cypher(nodes, edges, q).collect()) == want, q
