import os
import random

import pytest

from lodeworks.operators.hierarchy import descendant_pairs, hierarchy, other_parent_links, parent_links
from lodeworks.queries.links import QUERIES, containment_links

DATA = "/root/testdata/sf0.001"

SCHEMA = "tree string, node string, parent string"


def brute(links):
    """{(tree, node): (root, depth)} by walking up; one parent per node, the smallest."""
    parent = {}
    for tree, node, up in links:
        if node is None or up is None:
            continue
        key = (tree, node)
        parent[key] = min(parent.get(key, up), up)
    out = {}
    for tree, node in parent:
        seen, at, depth = set(), node, 0
        while (tree, at) in parent and at not in seen:
            seen.add(at)
            at = parent[tree, at]
            depth += 1
        out[tree, node] = ("", -1) if (tree, at) in parent else (at, depth)
    return out


def check(spark, links, **options):
    got = {(r.tree, r.node): (r.root, r.depth) for r in hierarchy(spark.createDataFrame(links, SCHEMA), **options).collect()}
    assert got == brute(links)


def test_trees_cycles_tails_and_self_links(spark):
    links = [
        ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "b"), ("t", "b", "a"),
        ("t", "x", "y"), ("t", "y", "z"), ("t", "z", "x"), ("t", "tail", "x"), ("t", "tail2", "tail"),
        ("t", "self", "self"), ("t", "under", "self"), ("u", "b", "q"), ("t", None, "a"), ("t", "n", None),
    ]
    check(spark, links)
    check(spark, links, with_path=False)
    check(spark, links, max_component=2)


def test_paths_descendants_and_cycle_edges(spark):
    links = [("t", "b", "a"), ("t", "c", "b"), ("t", "d", "b"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x")]
    for bound in (100, 1):
        tree = hierarchy(spark.createDataFrame(links, SCHEMA), max_component=bound)
        got = {r.node: (r.path, r.descendants, r.cycle_edge) for r in tree.collect()}
        assert got["b"] == (["a", "b"], 2, False)
        assert got["d"] == (["a", "b", "d"], 0, False)
        assert got["x"] == (None, None, True)
        assert got["y"] == (None, None, False)
        assert got["z"] == (None, None, False)
    pairs = {(r.node, r.descendant, r.distance) for r in descendant_pairs(hierarchy(spark.createDataFrame(links, SCHEMA))).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_several_parents_keep_the_smallest(spark):
    check(spark, [("t", "b", "z"), ("t", "b", "a"), ("t", "c", "b")])


def test_no_parent_link_is_lost(spark, rows):
    links = spark.createDataFrame([("t", "b", "z"), ("t", "b", "a"), ("t", "b", "z"), ("t", "c", "b"), ("t", "b", None), ("u", "b", "y")], SCHEMA)
    assert rows(other_parent_links(links)) == [("t", "b", "z")]


def test_roots_and_depths_of_large_components_need_no_ancestor_lists(spark, rows):
    links = spark.createDataFrame([("t", f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x")], SCHEMA)
    want = rows(hierarchy(links, with_path=False), "node", "root", "depth", "cycle_edge")
    assert rows(hierarchy(links, with_path=False, with_descendants=False, max_component=2), "node", "root", "depth", "cycle_edge") == want


def test_empty_and_clashing_columns(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([("t", "b", "a", "r", 9, "x")], SCHEMA + ", root string, depth int, comp string")
    assert [(r.root, r.depth) for r in hierarchy(odd).collect()] == [("a", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_cycles(spark, seed):
    rnd = random.Random(seed)
    n = 300
    links = [("t", f"n{i}", f"n{rnd.randrange(max(1, i - 5), n) if rnd.random() < 0.02 else rnd.randrange(max(1, i))}") for i in range(1, n)]
    links += [("t", f"c{i}", f"c{i - 1}") for i in range(1, 150)]
    check(spark, links, with_path=False, max_component=rnd.choice([50, 1000]))


def test_hot_parent(spark):
    links = [("t", f"k{i}", "hub") for i in range(2000)] + [("t", "hub", "top")]
    check(spark, links, with_path=False)


def test_roots_have_rows_of_their_own(spark):
    links = [("t", "b", "a"), ("t", "c", "b"), ("t", "x", "y"), ("t", "y", "x"), ("u", "k", "top"), ("u", "l", "top")]
    for bound in (100, 1):
        tree = hierarchy(spark.createDataFrame(links, SCHEMA), max_component=bound, with_roots=True)
        got = {(r.tree, r.node): (r.root, r.depth, r.path, r.descendants) for r in tree.collect()}
        assert len(got) == 8 and tree.count() == 8
        assert got["t", "a"] == ("a", 0, ["a"], 2) and got["u", "top"] == ("top", 0, ["top"], 2)
        assert got["t", "c"] == ("a", 2, ["a", "b", "c"], 0) and got["t", "x"] == ("", -1, None, None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_nodes_and_descendants_are_registered(spark):
    """Against the links of the smallest tables, walked up one by one."""
    parent = {(r.tree, r.node): r.parent for r in parent_links(containment_links(spark, DATA)).collect()}
    ends = brute([(t, n, p) for (t, n), p in parent.items()])
    nodes = QUERIES["p3_nodes"](spark, DATA).collect()
    roots = {(t, r) for (t, _), (r, d) in ends.items() if d > 0}
    assert roots and {(r.table_name, r.node_id) for r in nodes if r.depth == 0} == roots
    assert {(r.table_name, r.node_id): (r.root_id, r.depth) for r in nodes if r.depth} == ends and len(nodes) == len(ends) + len(roots)
    pairs = set()
    for (tree, node), (_, depth) in ends.items():
        at = node
        for k in range(1, depth + 1):
            at = parent[tree, at]
            pairs.add((tree, at, node, k))
    found = [tuple(r) for r in QUERIES["p3_descendants"](spark, DATA).collect()]
    assert len(found) == len(pairs) and set(found) == pairs
    closing = QUERIES["p3_cycles"](spark, DATA).collect()
    assert sorted((r.table_name, r.node_id) for r in nodes if r.cycle_edge) == sorted((r.table_name, r.node_id) for r in closing)
    assert all(parent[r.table_name, r.node_id] == r.parent_id and ends[r.table_name, r.node_id][1] == -1 for r in closing)
