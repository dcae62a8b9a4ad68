import numpy as np
import pytest

from lodeworks.llm import neighbours as nb

SCHEMA = "id string, vector array<float>"


def pairs(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows], SCHEMA)
    return {tuple(r) for r in nb.similar_pairs(nb.nearest(df, "id", "vector", **({"least": 0.9} | options))).collect()}


def clusters(seed, groups, size, dim=64, noise=0.25):
    rnd = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rnd.normal(size=dim)
        for k in range(size):
            v = (c + noise * rnd.normal(size=dim)) * rnd.uniform(0.1, 30)
            out.append((f"v{g:03d}_{k:02d}", v.astype(np.float32).tolist()))
    return out


def test_bound_keeps_every_neighbour():
    rnd = np.random.default_rng(11)
    base = rnd.normal(size=(20, 64))
    x = nb._unit(np.float32(np.repeat(base, 40, axis=0) + 0.01 * rnd.normal(size=(800, 64))))
    cos = x @ x.T
    for least in (-2.0, 0.9):
        i, j = nb.survivors(x, x, least, 6)
        got = set(zip(i.tolist(), j.tolist()))
        best = np.argsort(-cos, axis=1)[:, :6]
        assert all((r, int(c)) in got for r in range(800) for c in best[r])
        assert len(got) < 800 * 41


def test_bound_keeps_every_pair():
    rnd = np.random.default_rng(1)
    x = nb._unit(np.float32(rnd.normal(size=(300, 64))))
    y = nb._unit(np.float32(x[:200] + 0.05 * rnd.normal(size=(200, 64))))
    i, j = nb.survivors(x, y, 0.9)
    got = set(zip(i.tolist(), j.tolist()))
    a, b = np.nonzero(x @ y.T >= 0.9)
    assert set(zip(a.tolist(), b.tolist())) <= got and len(got) < 4000


def test_against_brute_force(spark):
    rows = clusters(2, 60, 9)
    want = nb.brute_force([i for i, _ in rows], [v for _, v in rows])
    assert pairs(spark, rows, exact=True, block=100) == want
    got = pairs(spark, rows, cell=120, block=20)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)
    # pivots gone through in parts give the same cells
    assert pairs(spark, rows, cell=120, part=3) == pairs(spark, rows, cell=120)


def test_every_vector_gets_its_k(spark):
    rows = clusters(6, 70, 3) + clusters(7, 1, 120, noise=0.02)
    rows = [(f"{n}_{i}", v) for n, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"cell": 40, "block": 25}):
        near = nb.nearest(df, "id", "vector", **options).collect()
        count = {}
        for r in near:
            count[r.id] = count.get(r.id, 0) + 1
        assert count == dict.fromkeys((i for i, _ in rows), 5)
    assert {tuple(r) for r in nb.similar_pairs(nb.nearest(df, "id", "vector", exact=True, block=50)).collect()} == nb.brute_force([i for i, _ in rows], [v for _, v in rows], least=None)


def test_cells_stay_of_one_size_as_vectors_grow(spark):
    """Rows sent to tiles are probes times the vectors, whatever their number: no block is needed."""
    sent = []
    for n in (300, 600, 1200):
        df = spark.createDataFrame([(i, np.frombuffer(np.float32(v).tobytes(), np.float32).tobytes()) for i, v in clusters(9, n // 6, 6)], "id string, raw binary")
        placed, pivots = nb._placed(df, n, 3, 100, nb.PART)
        sizes = [r["count"] for r in placed.selectExpr("explode(cells) cell").groupBy("cell").count().collect()]
        assert sum(sizes) == 3 * n and pivots == pytest.approx(3 * n / 100, rel=0.6)
        sent.append(max(sizes) / (sum(sizes) / len(sizes)))
    assert max(sent) < 6


def test_odd_vectors_take_no_part(spark):
    good = clusters(3, 2, 4)
    odd = [("a", None), ("b", []), ("c", [1.0] * 63), ("d", [0.0] * 64), ("e", [float("nan")] + [1.0] * 63), ("f", [float("inf")] * 64), ("g", [None] + [1.0] * 63), ("h", [-float("inf")] + [0.0] * 63)]
    assert pairs(spark, good + odd, probes=8) == nb.brute_force([i for i, _ in good], [v for _, v in good])
    tiny = [("x", [1e-38] * 64), ("y", [3e38] * 64)]
    assert pairs(spark, tiny) == {("x", "y")}


def test_copies_and_ties(spark):
    base = clusters(4, 1, 3)
    hot = [(f"copy{k:04d}", base[0][1]) for k in range(400)]
    rows = base + hot
    got = pairs(spark, rows)
    assert got == nb.brute_force([i for i, _ in rows], [v for _, v in rows])
    assert ("copy0000", "copy0399") in got
    repeated = [("r", base[0][1]), ("s", base[0][1])]
    assert pairs(spark, repeated) == {("r", "s")}


@pytest.mark.parametrize("rows", [[], [("only", [1.0] * 64)], [("z", [0.0] * 64)]])
def test_nothing_to_find(spark, rows):
    assert pairs(spark, rows) == set()
