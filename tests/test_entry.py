import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 90 and set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_smallest_tables(spark):
    assert entry.entry(spark).columns == ["table_name", "node_id", "root_id", "depth"]
    queries = entry.queries()
    for name in ("p4_found", "lexical_topk", "cypher_one_hop", "cochange_matrix", "tool_metrics", "section_split"):
        assert queries[name](spark, DATA).count() >= 0
