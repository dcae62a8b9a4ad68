"""Encoding a corpus with a public byte-level tokenizer.

A text within ``LEAF_CHARS`` is encoded in place. A longer one is cut into leaves that
are encoded in parallel; the leaves' ids are concatenated pairwise as a tree, whose lower
levels lie in tasks of ``FAN`` leaves and whose upper ones in one task a text. Around each join a growing window is
encoded again until both sides agree with it exactly (see :func:`join_ids`). The result equals encoding the text at once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 8192
#: Leaves that one task joins before their nodes meet.
FAN = 64

#: Fixed value: the pre-tokenizer's pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Places where the pattern always splits, whatever stands around: after a letter
# or digit that another kind of character follows. No alternative runs across, and none looks behind.
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿЀ-ҁҊ-ԯ一-鿿"
_SAFE = re.compile(rf"(?<=[{_LETTER}])(?=[ \n\t\r0-9.,;:!?()，。；：！？、])|(?<=[0-9])(?=[ \n\t\r.,;:!?(){_LETTER}])")
_LETTERS = re.compile(rf"[{_LETTER}]+")


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def piece_ids(self, piece: bytes) -> np.ndarray:
        """Of bytes known to lie within one pre-token."""
        return np.array(self.enc._encode_single_piece(piece), dtype=np.int32)

    def token(self, i: int) -> bytes:
        return self.enc.decode_single_token_bytes(int(i))

    def agree(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side: their bytes encode to just them."""
        return self.piece_ids(self.token(left) + self.token(right)).tolist() == [left, right]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _count(e: Encoder, ids: np.ndarray, size: int) -> int | None:
    """How many of the first ids have ``size`` bytes together; None if no token ends there."""
    ends = np.cumsum(e.sizes[ids[: size + 1]])
    at = int(np.searchsorted(ends, size))
    return 0 if size == 0 else at + 1 if at < len(ends) and ends[at] == size else None


def _count_back(e: Encoder, ids: np.ndarray, size: int) -> int | None:
    return _count(e, ids[-size - 1 :][::-1], size)


def join_ids(e: Encoder, a: str, ia: np.ndarray, b: str, ib: np.ndarray) -> np.ndarray:
    """Ids of a + b from the exact ids of both.

    A window around the join is encoded again. Its ends lie at places where the pattern always splits, and the
    window is accepted when, from its end to the next such place inside, its tokens are those that the side has
    there already, on both sides; else it grows. A side that is shorter than the window
    takes part whole. Inside one long run of letters there is no such place: there the window grows by
    tokens until its first and last token agree with their neighbours outside, for a sequence in
    which all neighbours agree is the encoding of its bytes.
    """
    if not a or not b:
        return np.concatenate([ia, ib])
    span = 64
    while True:
        tail, head = a[-span:], b[:span]
        left = [m.start() for m in _SAFE.finditer(tail) if m.start() > 0][-2:]
        right = [m.start() for m in islice((m for m in _SAFE.finditer(head) if m.start() > 0), 2)]
        if (len(left) == 2 or span >= len(a)) and (len(right) == 2 or span >= len(b)):
            found = _agreed(e, tail, left if len(left) == 2 else None, ia, head, right if len(right) == 2 else None, ib)
            if found is not None:
                return found
        elif span >= 256 and _LETTERS.fullmatch(tail) and _LETTERS.fullmatch(head):
            found = _join_run(e, ia, len(tail.encode()), ib, len(head.encode()))
            if found is not None:
                return found
        span *= 2


def _agreed(e: Encoder, tail: str, left: list[int] | None, ia: np.ndarray, head: str, right: list[int] | None, ib: np.ndarray) -> np.ndarray | None:
    """The joined ids if the window agrees with both sides; ``left`` and ``right`` are the outer parts' borders, None for a whole side."""
    window = e.ids((tail[left[0] :] if left else tail) + (head[: right[1]] if right else head))
    keep, skip = 0, len(ib)
    if left:
        size, edge = len(tail[left[0] :].encode()), len(tail[left[0] : left[1]].encode())
        back, same = _count_back(e, ia, size), _count(e, window, edge)
        if back is None or same is None or not np.array_equal(window[:same], ia[len(ia) - back :][:same]):
            return None
        keep = len(ia) - back
    if right:
        size, edge = len(head[: right[1]].encode()), len(head[right[0] : right[1]].encode())
        skip, same = _count(e, ib, size), _count_back(e, window, edge)
        if skip is None or same is None or not np.array_equal(window[len(window) - same :], ib[:skip][max(0, skip - same) :]):
            return None
    return np.concatenate([ia[:keep], window, ib[skip:]])


def _join_run(e: Encoder, ia: np.ndarray, left_bytes: int, ib: np.ndarray, right_bytes: int) -> np.ndarray | None:
    """Join within one run of letters whose nearest bytes are ``left_bytes`` and ``right_bytes``."""
    k = 4
    while True:
        if k >= len(ia) or k >= len(ib) or e.sizes[ia[-k - 1 :]].sum() > left_bytes or e.sizes[ib[: k + 1]].sum() > right_bytes:
            return None
        raw = b"".join(e.token(i) for i in (*ia[-k:], *ib[:k]))
        mid = e.piece_ids(raw)
        if e.agree(int(ia[-k - 1]), int(mid[0])) and e.agree(int(mid[-1]), int(ib[k])):
            return np.concatenate([ia[:-k], mid, ib[k:]])
        k *= 2


def join_tree(e: Encoder, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Ids of the concatenation of consecutive leaves."""
    while len(leaves) > 1:
        up = [(x[0] + y[0], join_ids(e, x[0], x[1], y[0], y[1])) for x, y in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = up + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0][1] if leaves else np.zeros(0, dtype=np.int32)


def encode_long(e: Encoder, text: str, leaf: int = LEAF_CHARS) -> np.ndarray:
    return join_tree(e, [(text[i : i + leaf], e.ids(text[i : i + leaf])) for i in range(0, len(text), leaf)])


def _encode_arrow(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The last column is the text; it becomes the list of ids, the others pass."""
    e = encoder(path)
    empty = np.zeros(0, dtype=np.int32)
    for batch in batches:
        ids = [e.ids(t) if t else empty for t in batch.column(batch.num_columns - 1).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([empty, *ids]), pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ids"])


def _count_arrow(batches: Iterator[pa.RecordBatch], path: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:
        n = pa.array([len(e.ids(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])


def _leaves(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    """Encoded leaves of long texts, each text cut in one pass: key, h1, h2, leaves, leaf, piece, ids."""
    e = encoder(path)
    for batch in batches:
        texts = batch.column("text")
        for row in range(batch.num_rows):
            text = texts[row].as_py()
            total = -(-len(text) // size)
            for first in range(0, total, FAN):
                leaf = np.arange(first, min(total, first + FAN), dtype=np.int32)
                pieces = [text[i * size : (i + 1) * size] for i in leaf]
                ids = [e.ids(p) for p in pieces]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                same = pa.array(np.full(len(leaf), row, dtype=np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                columns = [batch.column(c).take(same) for c in ("key", "h1", "h2")]
                counts = pa.array(np.full(len(leaf), total, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(leaf), pa.array(pieces), lists], names=["key", "h1", "h2", "leaves", "leaf", "piece", "ids"])


def _join_group(pdf: pd.DataFrame, path: str) -> pd.DataFrame:
    """One node of the leaves of a text. Rows of equal key and text send equal leaves: each is joined once and counted."""
    first = pdf["leaf"].min()
    copies = int(pdf.loc[pdf["leaf"] == first, "copies"].sum())
    pdf = pdf.drop_duplicates("leaf").sort_values("leaf")
    nodes = [(t, np.asarray(i, dtype=np.int32)) for t, i in zip(pdf["piece"], pdf["ids"], strict=True)]
    ids = nodes[0][1] if len(nodes) == 1 else join_tree(encoder(path), nodes)
    whole = len(pdf) == pdf["leaves"].iloc[0]
    one = pdf.iloc[[0]][["key", "h1", "h2", "leaves", "leaf"]]
    # a text that is complete goes on without its characters
    return one.assign(piece=None if whole else "".join(t for t, _ in nodes), ids=[ids], copies=copies)


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row; a null or empty text has the empty list.

    Special tokens are ordinary text. Keys may repeat or be null: the leaves of a long text find each other by key and
    hashes of the text, so every row keeps its own ids. Other columns are ignored.
    """
    path = f"{tokenizer_dir}/{BYTE_BPE}"
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    short = rows.where(F.col("text").isNull() | (F.length("text") <= leaf_chars)).mapInArrow(lambda it: _encode_arrow(it, path), f"key {kind}, ids array<int>")
    schema = f"key {kind}, h1 bigint, h2 bigint, leaves int, leaf int, piece string, ids array<int>"
    long = rows.where(F.length("text") > leaf_chars).select("key", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2"), "text")

    def leaves(some: DataFrame) -> DataFrame:
        # texts are spread before they are cut, so that files of many long ones do not hold up one task
        return some.repartition("h1", "h2").mapInArrow(lambda it: _leaves(it, path, leaf_chars), schema).withColumn("copies", F.lit(1))

    def joined(nodes: DataFrame, *by: str | Column) -> DataFrame:
        return nodes.groupBy("key", "h1", "h2", *by).applyInPandas(lambda pdf: _join_group(pdf, path), f"{schema}, copies int")

    within = F.length("text") <= leaf_chars * FAN
    nodes = joined(leaves(long.where(~within)), F.floor(F.col("leaf") / F.lit(FAN)).alias("node"))
    # a node of the second level is as many leaves as its text has nodes
    nodes = nodes.withColumn("leaves", F.ceil(F.col("leaves") / F.lit(FAN)).cast("int"))
    whole = joined(leaves(long.where(within))).unionByName(joined(nodes)).select("key", "ids", F.explode(F.sequence(F.lit(1), "copies")))
    return short.unionByName(whole.select("key", "ids")).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with n_tokens in place of the text; null and empty texts have 0."""
    path = f"{tokenizer_dir}/{BYTE_BPE}"
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(lambda it: _count_arrow(it, path, keep), f"{schema}, n_tokens bigint")
