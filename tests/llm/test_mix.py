import random

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import mix

T = "mix_name string, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choices(["big", "mid", "small"], [80, 15, 5])[0], rnd.randint(1, 400)) for i in range(4000)]
    rows += [(9001, None, 50), (9002, "big", 0), (9003, "other", 70)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").cache()


@pytest.mark.parametrize("balanced", [False, True])
def test_shares_caps_and_copies(spark, docs, balanced):
    targets = spark.createDataFrame([("m", "Big", 1.0, 1), ("m", " mid ", 1.0, 2), ("m", "small", 2.0, 4), ("m", "absent", 1.0, 1), ("n", "big", 0.7, 3), ("n", "small", 0.3, 1)], T)
    rows, plan = mix.mixture(docs, targets, balanced=balanced)
    got = {(r.mix_name, r.source): r for r in mix.shares(rows, plan, targets).collect()}
    assert got["m", "absent"].reached_share == 0 and len(got) == 6
    for r in got.values():
        assert r.most_copies <= r.max_repeats
        assert r.reached_share == pytest.approx(r.wanted_share, rel=0.01 if balanced else 0.1)
        assert balanced or r.z is None or abs(r.z) < 4
    assert got["m", "small"].wanted_share == pytest.approx(0.5)
    # the tightest source is used to its cap
    assert got["n", "small"].rate == 1.0 and got["n", "small"].used_tokens == got["n", "small"].tokens
    each = rows.groupBy("mix_name", "doc_id").count().collect()
    top = {"m": 4, "n": 3}
    assert all(r["count"] <= top[r.mix_name] for r in each)
    again, _ = mix.mixture(docs.repartition(7), targets, balanced=balanced)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_spellings_and_empty_tables(spark, docs):
    names = spark.createDataFrame([(" Issue-Report",), ("issue report",), (None,), ("",)], "s string").select(mix.source_name("s"))
    assert [r[0] for r in names.collect()] == ["issue_report", "issue_report", None, ""]
    targets = spark.createDataFrame([("m", "big", 1.0, 1), ("m", "mid", -1.0, 1), ("m", "small", None, 1), ("m", "other", 1.0, 0)], T)
    rows, plan = mix.mixture(docs, targets)
    assert {r.source for r in plan.collect()} == {"big"} and rows.where("copy > 1").count() == 0
    rows, plan = mix.mixture(docs.limit(0), targets)
    assert rows.count() == 0 and mix.shares(rows, plan, targets).count() == 4
    rows, plan = mix.mixture(docs, targets.limit(0))
    assert rows.count() == 0


def test_one_huge_document(spark):
    docs = spark.createDataFrame([(1, "a", 100_000)] + [(i, "a", 10) for i in range(2, 500)] + [(1000, "b", 3000)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], T)
    rows, plan = mix.mixture(docs, targets, balanced=True)
    got = {r.source: r.reached_share for r in mix.shares(rows, plan, targets).collect()}
    assert got["a"] == pytest.approx(0.5, abs=0.01)


def test_the_draw_is_bernoulli_in_the_fraction(spark, docs):
    """Each document's extra copy has the fraction as probability, whatever its size and whoever else is there."""
    targets = spark.createDataFrame([(f"m{i}", "big", 1.0, 3) for i in range(40)] + [(f"m{i}", "mid", 0.26, 1) for i in range(40)], T)
    rows, plan = mix.mixture(docs, targets)
    rate = {(r.mix_name, r.source): r.rate for r in plan.collect()}
    part = rate["m0", "big"] % 1
    assert 0.05 < part < 0.95
    n = docs.where("source = 'big' and n_tokens > 0").count()
    for low, high in ((1, 100), (300, 400)):
        some = docs.where(f"source = 'big' and n_tokens between {low} and {high}").count() * 40
        extra = rows.where(f"source = 'big' and n_tokens between {low} and {high} and copy = {int(rate['m0', 'big']) + 1}").count()
        assert abs(extra - part * some) < 4 * (part * (1 - part) * some) ** 0.5
    assert n > 1000
    # other documents of the source do not matter as long as the rate is the same
    u = dict(docs.withColumn("mix_name", F.lit("m0")).select("doc_id", mix.chance("doc_id", "mix_name")).collect())
    drawn = {r.doc_id for r in rows.where(f"mix_name = 'm0' and source = 'big' and copy = {int(rate['m0', 'big']) + 1}").collect()}
    assert drawn == {r.doc_id for r in docs.where("source = 'big' and n_tokens > 0").collect() if u[r.doc_id] < part}
