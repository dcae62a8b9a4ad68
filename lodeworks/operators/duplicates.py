"""Exact and near duplicates.

The similarity join is exact: by prefix filtering, two sets of Jaccard t share at least one of
their rarest features, so only features in those prefixes are joined on. Copies of one text are a
class and take part once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut
from lodeworks.functions.text import TOKEN_SPLIT
from lodeworks.operators.bags import bag_join
from lodeworks.operators.components import connected_components


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group, copies) of rows whose whole text occurs more than once; the group is its smallest key."""
    at = docs.where(F.col(text).isNotNull()).select(key, F.sha1(text).alias("h"))
    groups = at.groupBy("h").agg(F.min(key).alias("group"), F.count("*").alias("copies")).where("copies > 1")
    return at.join(groups, "h").select(key, "group", "copies")


def words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda w: w != "")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once per row: inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def shingle_set(text: str | Column, n: int = 5) -> Column:
    """Distinct hashes of all runs of ``n`` words; a shorter text is one run."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        each = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")))
        return F.when(F.size(w) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return once(words(text), runs)


def normalised_tokens(text: str | Column, keywords: str = "def class return if else elif for while in not and or import from try except finally with as pass break continue lambda yield raise async await function func fn let var const new this self true false null none") -> Column:
    """Tokens of code in which names, numbers and strings lose their identity."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(c, r"(?m)(#|//)[^\n]*$", " "), r"\"[^\"\n]*\"|'[^'\n]*'", " STR ")
    toks = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*|\d[\w.]*|[^\s\w])"), F.lit(1))
    kw = keywords.split()

    def within(t: Column, first: str, last: str) -> Column:
        """Whether the first character lies between these; a comparison costs less than a pattern."""
        return (t >= first) & (t < chr(ord(last) + 1))

    def bare_token(t: Column) -> Column:
        word = F.when(t == "STR", t).when(F.lower(t).isin(kw), F.lower(t)).otherwise("ID")
        return F.when(within(t, "a", "z") | within(t, "A", "Z") | within(t, "_", "_"), word).when(within(t, "0", "9"), "NUM").otherwise(t)

    return F.transform(toks, bare_token)


def multiset(tokens: Column) -> Column:
    """A bag as a set: the k-th occurrence of a token is its own feature, so Jaccard counts min over max."""

    def bag(t: Column) -> Column:
        return F.flatten(F.transform(F.array_distinct(t), lambda x: F.transform(F.sequence(F.lit(1), F.size(F.filter(t, lambda y: y == x))), lambda k: F.xxhash64(x, k))))

    return once(tokens, bag)


def counted(tokens: Column) -> Column:
    """A bag as its distinct tokens, hashed and in order, with their numbers."""

    def runs(h: Column, d: Column) -> Column:
        end = lambda i: F.when(i + 1 < F.size(d), F.array_position(h, F.get(d, i + 1))).otherwise(F.size(h) + 1)
        return F.transform(d, lambda x, i: F.struct(x.alias("x"), (end(i) - F.array_position(h, x)).alias("c")))

    return once(F.sort_array(F.transform(tokens, lambda x: F.xxhash64(x))), lambda h: once(F.array_distinct(h), lambda d: runs(h, d)))


def similarity_join(sets: DataFrame, key: str, features: str, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of rows whose sets have at least that Jaccard similarity.

    sets: (key, features ARRAY<BIGINT> without repeats). Empty sets are similar to nothing. Exact, without caps.
    """
    s = cut(sets.where(F.size(features) > 0).select(F.col(key).alias("k"), F.array_sort(features).alias("f")))
    each = s.select("k", F.size("f").alias("n"), F.explode("f").alias("x"))
    df = each.groupBy("x").agg(F.count("*").alias("df"))
    # a feature of one set only joins nothing, but keeps its place in the order
    order = W.partitionBy("k").orderBy("df", "x")
    prefix = each.join(df, "x").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.round(F.col("n") * threshold, 9)) + 1)
    prefix = cut(prefix.where("df > 1").select("k", "n", "x", "r"))
    left, right = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), "x", F.col("r").alias("ra")), prefix.select(F.col("k").alias("b"), F.col("n").alias("nb"), "x", F.col("r").alias("rb"))
    # sizes must fit, and what is left behind the shared feature must still suffice
    need = F.ceil(F.round((F.col("na") + F.col("nb")) * threshold / (1 + threshold), 9))
    fits = (F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + F.least("ra", "rb") >= need)
    pairs = left.join(right, "x").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    fa, fb = s.select(F.col("k").alias("a"), F.col("f").alias("fa")), s.select(F.col("k").alias("b"), F.col("f").alias("fb"))
    both = pairs.join(fa, "a").join(fb, "b").withColumn("common", F.size(F.array_intersect("fa", "fb")))
    scored = both.select("a", "b", F.round(F.col("common") / (F.size("fa") + F.size("fb") - F.col("common")), 6).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(key, class_id, copies, links) of each row with text: classes of equal texts, joined by near-duplicate links.

    Texts are equal if their words are. ``links`` counts the near but different texts of the row's own text;
    ``class_id`` is the smallest key within reach over copies and links. Rows without words are classes of their own.
    """
    bag = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.sha1(F.array_join(words(text), " ")).alias("h"), shingle_set(text, n).alias("f"))
    bag = cut(bag)
    reps = bag.groupBy("h").agg(F.min("k").alias("rep"), F.count("*").alias("copies"))
    sets = bag.join(reps.select(F.col("rep").alias("k")), "k", "left_semi").select("k", "f")
    pairs = cut(similarity_join(sets, "k", "f", threshold))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    comp = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "rep")
    empty = F.size("f") == 0
    at = bag.select("k", "h", empty.alias("e")).join(reps, "h").join(links, "rep", "left").join(comp, "rep", "left")
    return at.select(
        F.col("k").alias(key), F.when(F.col("e"), F.col("k")).otherwise(F.coalesce("component", "rep")).alias("class_id"), F.when(F.col("e"), 1).otherwise(F.col("copies")).cast("bigint").alias("copies"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )


def _bags(symbols: DataFrame, key: str, text: str, min_tokens: int) -> DataFrame:
    bags = symbols.select(F.col(key).alias("k"), normalised_tokens(text).alias("t")).where(F.size("t") >= min_tokens)
    return bags.select("k", F.array_sort(multiset(F.col("t"))).alias("f"))


def symbol_duplicates(symbols: DataFrame, key: str, text: str, threshold: float = 0.85, min_tokens: int = 24) -> DataFrame:
    """(a, b, jaccard) of functions alike up to the names in them (R34, J18): bags of normalised tokens.

    Functions with equal bags are one class, represented by their smallest key.
    """
    # cut before the filter, which would make the tokens a second time
    bags = cut(symbols.select(F.col(key).alias("k"), once(normalised_tokens(text), lambda t: F.when(F.size(t) >= min_tokens, counted(t))).alias("f")))
    return bag_join(bags.where("f is not null").groupBy("f").agg(F.min("k").alias("k")), "k", "f", threshold)


def symbol_classes(symbols: DataFrame, key: str, text: str, min_tokens: int = 24) -> DataFrame:
    """(key, representative, copies) of all functions that take part in :func:`symbol_duplicates`: the smallest key of equal bags and their number."""
    bags = _bags(symbols, key, text, min_tokens).select("k", F.sha1(F.array_join("f", ",")).alias("h"))
    reps = bags.groupBy("h").agg(F.min("k").alias("representative"), F.count("*").alias("copies"))
    return bags.join(reps, "h").select(F.col("k").alias(key), "representative", "copies")


def symbol_copies(symbols: DataFrame, key: str, text: str, min_tokens: int = 24) -> DataFrame:
    """(key, group, copies) of functions with the same sequence of normalised tokens."""
    seq = symbols.select(F.col(key).alias(key), normalised_tokens(text).alias("t")).where(F.size("t") >= min_tokens).select(key, F.array_join("t", " ").alias("s"))
    return exact_groups(seq, key, "s")


def contamination(docs: DataFrame, key: str, text: str, held_out: DataFrame, held_key: str, held_text: str, n: int = 8) -> DataFrame:
    """(key, held_key, common): rows that share runs of ``n`` words with held-out items."""
    a = docs.where(F.col(text).isNotNull()).select(key, F.explode(shingle_set(text, n)).alias("x"))
    b = held_out.where(F.col(held_text).isNotNull()).select(F.col(held_key).alias("_held"), F.explode(shingle_set(held_text, n)).alias("x"))
    return a.join(b, "x").groupBy(key, F.col("_held").alias(held_key)).agg(F.count("*").alias("common"))
