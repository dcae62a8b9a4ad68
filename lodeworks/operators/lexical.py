"""Lexical scoring of frames, Porter stems and phrases; :mod:`lodeworks.operators.inverted` keeps the stored index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import tokens


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of each document (A7). Empty tokens count as a term; null texts have none."""
    each = docs.where(F.col(text).isNotNull()).select(key, F.explode(tokens(text)).alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: str, n: str) -> Column:
    return F.log((F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1)


def lexical_scores(post: DataFrame, n_docs: int, key: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score): sum of tf x idf over the query's distinct terms.

    queries: (query_id, term). Only postings of queried terms are read on: document
    frequencies are counted over those alone, which is the same for these terms.
    """
    q = queries.select("query_id", "term").distinct()
    hits = post.join(q.select("term").distinct(), "term", "left_semi")
    df = doc_frequencies(hits).withColumn("n", F.lit(n_docs))
    scored = hits.join(df, "term").join(q, "term").withColumn("s", F.col("tf") * idf("df", "n"))
    return scored.groupBy("query_id", key).agg(F.sum("s").alias("score")).where("score > 0")


def query_terms(spark, queries: dict[str, str]) -> DataFrame:
    """(query_id, term) of a few queries, tokenised as documents are."""
    rows = spark.createDataFrame(list(queries.items()), "query_id string, q string")
    return rows.select("query_id", F.explode(tokens("q")).alias("term")).where("term <> ''").distinct()


def lexical_topk(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` documents of each query; ties go to the smaller key."""
    from pyspark.sql import Window as W

    n = docs.where(F.col(text).isNotNull()).count()
    scores = lexical_scores(postings(docs, key, text), n, key, queries).withColumn("score", F.round("score", 6))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def updated_postings(post: DataFrame, key: str, changed: DataFrame, text: str) -> DataFrame:
    """Postings after documents changed: theirs are replaced, frequencies follow from counts, not from old scores."""
    return post.join(changed.select(key).distinct(), key, "left_anti").unionByName(postings(changed, key, text))


# ---- stems and phrases ---------------------------------------------------------

_VOWEL = re.compile(r"[aeiouy]")


def porter_stem(word: str) -> str:
    """Porter's stem of a lower-case English word; others pass through."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w

    def forms(s: str) -> str:
        out = []
        for i, c in enumerate(s):
            vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
            out.append("v" if vowel else "c")
        return "".join(out)

    def m(s: str) -> int:
        return len(re.findall(r"v+c+", forms(s)))

    def has_vowel(s: str) -> bool:
        return "v" in forms(s)

    def cvc(s: str) -> bool:
        return len(s) >= 3 and forms(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def double(s: str) -> bool:
        return len(s) >= 2 and s[-1] == s[-2] and forms(s)[-1] == "c"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"

    def replaced(s: str, rules: str, least: int) -> str:
        pairs = [(a, b.strip("-")) for a, b in (r.split(":") for r in rules.split())]
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if s.endswith(end):
                stem = s[: len(s) - len(end)]
                return stem + new if m(stem) > least else s
        return s

    w = replaced(w, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", 0)
    w = replaced(w, "icate:ic ative:- alize:al iciti:ic ical:ic ful:- ness:-", 0)
    if w.endswith("ion") and len(w) > 3 and w[-4] in "st":
        w = replaced(w, "ion:-", 1)
    else:
        w = replaced(w, "al:- ance:- ence:- er:- ic:- able:- ible:- ant:- ement:- ment:- ent:- ou:- ism:- ate:- iti:- ous:- ive:- ize:-", 1)
    if w.endswith("e"):
        stem = w[:-1]
        if m(stem) > 1 or (m(stem) == 1 and not cvc(stem)):
            w = stem
    if m(w) > 1 and double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def substring_tier(chunks: DataFrame, key: str, columns: list[str], phrases: DataFrame) -> DataFrame:
    """Tiers 2 and 3: rows that contain the phrase, case-insensitively, in any column.

    phrases: (query_id, phrase), a handful of rows by contract: they are broadcast after a check of their number.
    """
    if phrases.limit(1001).count() > 1000:
        raise ValueError("at most 1000 phrases at a time")
    p = F.broadcast(phrases.select("query_id", F.lower("phrase").alias("p")))
    hay = F.lower(F.concat_ws("\n", *columns))
    found = chunks.select(key, hay.alias("hay")).join(p, F.expr("contains(hay, p)"))
    return found.select("query_id", key, F.lit(1.0).alias("score"))


def stemmed_queries(spark, queries: dict[str, str]) -> DataFrame:
    rows = [(q, s) for q, text in queries.items() for s in {porter_stem(w) for w in re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower())}]
    return spark.createDataFrame(rows, "query_id string, stem string")
