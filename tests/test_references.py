from lodeworks.operators.references import Children, orphan_report, orphans

P = "ref string, since bigint, gone boolean"
C = "record_id string, ref string, at bigint"
DAY = 86_400_000_000


def run(spark, parents, children):
    return orphans({"p": spark.createDataFrame(parents, P)}, [Children("t", "f", "p", spark.createDataFrame(children, C))])


def test_reasons(spark):
    parents = [("a", 10, False), ("b", 10, True), ("c", 50, False)]
    children = [("1", "a", 20), ("2", "a", 5), ("3", "b", 20), ("4", "c", 50), ("5", "d", 1), ("6", None, 1), ("7", "A", 20), ("8", "a", 10), ("9", "d", None), ("10", "a", None)]
    got = {r.record_id: r.reason for r in run(spark, parents, children).collect()}
    assert got == {"2": "later", "3": "removed", "5": "missing", "7": "missing", "9": "missing"}


def test_report_by_month_and_hot_key(spark):
    children = [(str(i), "hot", 31 * DAY + i) for i in range(3000)] + [("x", "cold", 0)]
    got = {(r.period, r.reason): r.orphans for r in orphan_report(run(spark, [], children)).collect()}
    assert got == {("1970-02", "missing"): 3000, ("1970-01", "missing"): 1}


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert run(spark, [("a", 1, False)], []).count() == 0


def test_instants_in_any_spelling(spark):
    from lodeworks.common import counting_rows, micros_of, utc_month

    texts = ["2025-01-01T00:00:00Z", "2025-01-01 00:00:00", "2025-01-01T03:00:00+03:00", "2024-12-31T19:00:00-0500", "2025-01-01T00:00:00", "nonsense", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in df.orderBy("id").select(micros_of(df, "t")).collect()]
            months = {r[0] for r in df.limit(5).select(utc_month(micros_of(df, "t"))).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == [1735689600000000] * 5 + [None, None]
        assert months == {"2025-01"}
    again = spark.createDataFrame([("k", "2025-01-01T03:00:00+03:00", 1), ("k", "2025-01-01T01:00:00Z", 2), ("k", None, 3), (None, "2025-01-01T01:00:00Z", 4)], "id string, t string, v int")
    from pyspark.sql import functions as F

    assert [(r.id, r.v) for r in counting_rows(again, "id", micros_of(again, "t"), v=F.col("v")).collect()] == [("k", 2)]
