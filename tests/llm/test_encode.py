import os
import random

import numpy as np
import pytest

from lodeworks.llm import encode

PATH = f"{encode.TOKENIZER_DIR}/{encode.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.mark.parametrize("seed", range(4))
def test_joined_leaves_equal_the_whole(seed):
    e, rnd = encode.encoder(PATH), random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "abc     \n", "ab'sre ' t1234 ,.\t\n", "字符号码中文的 ，。abc", "приветмир ", "😀👩‍💻a= =-_", "aaaaab", " \n\n  x"]
    for _ in range(200):
        if rnd.random() < 0.3:
            text = "".join(rnd.choice(["the", "ing", "tion", " ", "un", "ness", "'s", "12", "字"]) for _ in range(rnd.choice([5, 400])))
        else:
            text = "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.choice([1, 50, 1500])))
        for leaf in (1, 7, 300):
            assert encode.encode_long(e, text, leaf).tolist() == e.ids(text).tolist()


@pytest.mark.parametrize("text", ["abcdefghij" * 5000, "中文字符没有空格" * 4000, "=" * 30000, "7" * 20000, " " * 20000, "á" * 9000])
def test_long_runs_without_a_split(text):
    e = encode.encoder(PATH)
    assert encode.encode_long(e, text).tolist() == e.ids(text).tolist()


def test_window_stays_local():
    e, text = encode.encoder(PATH), "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(40000))
    calls = []
    old = e.ids
    e.ids = lambda t: calls.append(len(t)) or old(t)
    try:
        encode.encode_long(e, text)
    finally:
        del e.ids
    assert max(calls) <= encode.LEAF_CHARS


def test_corpus(spark):
    special = "<|endoftext|> is plain text"
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "字" * 20000), (5, "hello world"), (6, special), (7, "word " * 9000), (8, "x" * encode.LEAF_CHARS)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df, "doc_id", "text").collect()}
    e = encode.encoder(PATH)
    assert got == {k: e.ids(t).tolist() if t else [] for k, t in rows}
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert "".join(e.enc.decode(got[6])) == special
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for k, t in rows[:1] + rows[5:7]:
        assert got[k] == other.encode(t, add_special_tokens=False).ids
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(df.select("doc_id", "text"), "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert got[1] == np.array(got[5]).tolist()


def test_repeated_and_null_keys_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(encode, "FAN", 3)
    texts = ["ab c" * 900, "dé. f" * 900, "ab c" * 900, "g1 h" * 900, "字 " * 700]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, texts[4]), (2, texts[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    e = encode.encoder(PATH)
    got = sorted(((r.doc_id, list(r.ids)) for r in encode.encode_corpus(df, "doc_id", "text", leaf_chars=256).collect()), key=repr)
    assert got == sorted(((k, e.ids(t).tolist() if t else []) for k, t in rows), key=repr)


def test_a_text_of_many_nodes(spark):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(400_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = encode.encode_corpus(df, "doc_id", "text", leaf_chars=4096).first()
    assert list(got.ids) == encode.encoder(PATH).ids(text).tolist()
