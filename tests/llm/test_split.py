import random

import numpy as np
import pytest

from lodeworks.llm import split


def test_range_max_against_brute_force():
    rnd = random.Random(0)
    for n, widest in ((1, 1), (2, 9), (7, 7), (64, 64), (131, 200), (131, 20), (90, 1)):
        v = np.array([rnd.randrange(4) for _ in range(n)], dtype=np.int8)
        index = split.RangeMax(v, widest)
        assert len(index.rows) <= widest.bit_length()
        for lo in range(n):
            for hi in range(lo, min(n, lo + widest)):
                best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
                assert index.rightmost(lo, hi) == best


def test_a_sliding_table_gives_the_same_pieces(monkeypatch):
    rnd = random.Random(9)
    text = " ".join(rnd.choice(["alpha", "x.", "\n", "\n\n", "def f():", "a" * 300, "\r\n"]) for _ in range(4000))
    want = {limit: split.pieces(text, limit, limit // 9) for limit in (60, 500, 1800)}
    for stride in (1, 700, 5000):
        monkeypatch.setattr(split, "STRIDE", stride)
        assert {limit: split.pieces(text, limit, limit // 9) for limit in want} == want


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_overlap_and_fit(seed):
    rnd = random.Random(seed)
    words = ["alpha", "βeta", "x.", "\n", "\n\n", "def f():", "你好。", "\r\n", "😀", "a" * 70]
    text = " ".join(rnd.choice(words) for _ in range(1500))
    for limit, overlap in ((1800, 200), (100, 0), (101, 30)):
        p = split.pieces(text, limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in p)
        for (_, b), (c, d) in zip(p, p[1:]):
            assert b - overlap <= c <= b and d > b


def test_natural_places():
    para = ("One sentence of some length here. " * 20).strip()
    text = "\n\n".join([para] * 5)
    for a, b in split.pieces(text)[:-1]:
        assert text[b - 2 : b] == "\n\n"
    code = "".join(f"def f{i}():\n    x = {i}\n    return x\n\n\n" for i in range(120))
    for a, b in split.pieces(code)[:-1]:
        assert code[b:].startswith("def ")
    assert split.pieces("x" * 4000)[:2] == [(0, 1800), (1600, 3400)]
    assert split.pieces("") == [(0, 0)] and split.pieces("a" * 1800) == [(0, 1800)]
    crlf = ("a" * 99 + "\r\n") * 40
    assert all(not (crlf[b - 1] == "\r" and crlf[b : b + 1] == "\n") for _, b in split.pieces(crlf))
    with pytest.raises(ValueError):
        split.pieces("x" * 10, 5, 4)


def test_operator(spark):
    long = "\n".join(f"line {i} of the text" for i in range(400))
    rows = [("a", long, 11, 0), ("b", "short", 1, 0), ("c", None, 1, 0), ("d", long.replace("\n", "\r\n"), 0, 0), ("e", "字" * 1801, None, 0), ("a", long, 11, 0), ("f", "", 1, 0)]
    df = spark.createDataFrame(rows, "key string, text string, line int, chunk_index int")
    got = split.split_oversized(df, "key", "text", "line").collect()
    a = sorted({(r.chunk_index, r.char_start, r.char_end, r.line_start, r.line_end) for r in got if r.key == "a"})
    assert {r.key for r in got} == {"a", "d", "e"} and len([r for r in got if r.key == "a"]) == 2 * len(a)
    lines = long.split("\n")
    for _, s, e, top, bottom in a:
        assert top == 11 + long[:s].count("\n") and bottom == 11 + long[: e - 1].count("\n")
    assert a[-1][4] == 11 + len(lines) - 1
    d = sorted((r.chunk_index, r.line_start, r.line_end, r.lines_known) for r in got if r.key == "d")
    assert d[0][1:] == (1, d[0][2], False) and d[-1][2] == 400
    assert split.split_oversized(df.limit(0), "key", "text").count() == 0


@pytest.mark.parametrize("lead", ["One sentence.\n\n", "A line of prose that is neither long nor short. " * 14 + "\n\n", "x "])
def test_cut_before_a_run_without_boundaries(lead):
    text = lead + "Qk3" * 1500 + "\n\nThe end of it."
    p = split.pieces(text)
    assert p[0] == (0, len(lead))
    assert p[-1][1] == len(text) and all(0 < b - a <= 1800 for a, b in p)
    assert all(b - 200 <= c <= b and d > b and c > a for (a, b), (c, d) in zip(p, p[1:]))
