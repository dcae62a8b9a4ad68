import datetime as dt

import pytest

from lodeworks.operators import history as h

C = "hash string, author string, email string, date timestamp, message string, body string, files array<string>"


@pytest.fixture(scope="module")
def log(spark):
    d = lambda n: dt.datetime(2025, 1, n)
    rows = [
        ("1", "ann", "", d(1), "Initial commit", "", ["a.py", "b.py"]), ("2", "bob", "", d(2), "Fix null pointer", "why", ["a.py", "b.py", "b.py"]), ("3", "ann", "", d(3), "Add feature", None, ["a.py", "c.py"]),
        ("4", "ann", "", d(4), "Bug fix: resolve crash", "", ["a.py", "b.py", "c.py", "d.py", "e.py"]), ("5", "cy", "", d(5), "prefix only", "", None), ("6", "cy", "", None, None, None, []),
    ]
    return spark.createDataFrame(rows, C)


def test_cochange(log, rows):
    assert rows(h.pair_frequency(log, 2), "file_a", "file_b", "n") == [("a.py", "b.py", 3), ("a.py", "c.py", 2)]
    assert rows(h.cochange(log, 2, 0.5)) == [("a.py", "b.py", 3, 0.75), ("a.py", "c.py", 2, 0.5)]
    assert rows(h.file_pairs(log.where("hash = '4'"))).__len__() == 10


def test_bugs(log):
    t = h.bug_totals(log).first()
    assert (t.commits, t.bugfixes, t.ratio) == (6, 2, 0.333)
    assert {r.file: r.bugfixes for r in h.buggy_files(log).collect()} == {"a.py": 2, "b.py": 2, "c.py": 1, "d.py": 1, "e.py": 1}
    hot = {r.file: (r.bugs, r.score) for r in h.bug_hotspots(log, "2025-02-02").collect()}
    assert hot["a.py"] == (2, 7) and hot["d.py"] == (1, 5)
    assert {r.file: r.score for r in h.bug_hotspots(log, "2026-01-01").collect()}["a.py"] == 4
    risk = {r.file: (r.total, r.bugfixes) for r in h.file_risk(log).collect()}
    assert risk["a.py"] == (4, 2)


def test_significance_decisions_search(log, rows):
    got = {r["hash"]: r.score for r in h.significance(log, 0.0).collect()}
    assert got["4"] == pytest.approx(0.85) and got["2"] == pytest.approx(0.7) and got["6"] == 0.0
    assert rows(h.search_commits(log, message="FIX"), "hash") == [("2",), ("4",), ("5",)]
    assert rows(h.search_commits(log, file="d.py"), "hash") == [("4",)]
    assert rows(h.search_commits(log, hash_prefix="3"), "hash") == [("3",)]
    assert h.decisions(log).count() == 0
    errors = log.sparkSession.createDataFrame([("e", "the crash, and Null pointer")], "error_id string, text string")
    assert [(r["hash"], r.score) for r in h.similar_bugs(log, errors).orderBy("rank").collect()] == [("2", 2), ("4", 1)]


def test_related(spark, rows):
    rel = spark.createDataFrame([("a", "b", "call_graph", 1.0), ("b", "c", "cochange", 3.0), ("b", "d", "other", 1.0), ("a", "a", "cochange", 9.0)], "file_a string, file_b string, kind string, weight double")
    got = {(r.src, r.dst): (r.depth, r.weight) for r in h.related_files(h.knowledge_graph(rel)).collect()}
    assert got["a", "b"] == (1, 3.0) and got["a", "c"] == (2, 3.0) and got["d", "a"] == (2, pytest.approx(1.732051)) and ("a", "a") not in got


def test_empty(spark):
    none = spark.createDataFrame([], C)
    assert h.cochange(none).count() == 0 and h.bug_totals(none).first().ratio == 0.0 and h.significance(none).count() == 0
