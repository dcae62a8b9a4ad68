"""A stored inverted index: postings in buckets by term, read for the queried terms only, kept up by segments.

Under the index's folder lie, each written by segment:

* ``docs``      key, stored columns and the length of every field, in buckets by key
* ``postings``  field, term, key, tf, dl, in buckets by field and term and sorted by them
* ``removed``   keys whose rows in earlier segments no longer count
* ``stats``     per field the documents and total length that the segment adds, negative for what it removes

A segment counts once its ``stats`` are there, which are written last. A search reads the buckets of its
terms, in which sorting lets row groups be skipped, and never the corpus.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.common import path_exists
from lodeworks.functions.text import split_identifier, tokens
from lodeworks.operators.lexical import idf, porter_stem

#: Terms or keys that are looked up by a list; more of them are joined.
MOST_LISTED = 10_000
KINDS = ("words", "stems", "name_stems", "trigrams")


@dataclass(frozen=True)
class Field:
    """How one field of the index comes from a column of the documents.

    words: lower-case tokens, the empty one included. stems: Porter stems. name_stems: stems
    of the words of an identifier. trigrams: distinct runs of three characters, of several columns joined by line ends.
    """

    kind: str
    columns: tuple[str, ...]

    def parts(self) -> Column:
        """The array of what is counted; null where the document has no such field."""
        if self.kind == "trigrams":
            return F.array(F.lower(F.concat_ws("\n", *self.columns)))
        c = F.col(self.columns[0])
        if self.kind == "words":
            return tokens(c)
        return F.filter(tokens(split_identifier(c) if self.kind == "name_stems" else c), lambda t: t != "")


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    return porter_stem(word)


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _counted(batches: Iterator[pd.DataFrame], fields: list[tuple[str, str]]) -> Iterator[pd.DataFrame]:
    """Terms of each document with their counts; a document's terms meet nowhere else, so nothing is shuffled for it."""
    for pdf in batches:
        names, terms, keys, tfs, dls = [], [], [], [], []
        for n, (field, kind) in enumerate(fields):
            for key, parts in zip(pdf["key"], pdf[f"p{n}"], strict=True):
                if parts is None:
                    continue
                counts = Counter(_trigrams(parts[0])) if kind == "trigrams" else Counter(parts) if kind == "words" else Counter(map(_stem, parts))
                size = sum(counts.values())
                names += [field] * len(counts)
                keys += [key] * len(counts)
                terms += counts.keys()
                tfs += counts.values()
                dls += [size] * len(counts)
                if len(terms) > 200_000:
                    yield pd.DataFrame({"field": names, "term": terms, "key": keys, "tf": tfs, "dl": dls})
                    names, terms, keys, tfs, dls = [], [], [], [], []
        yield pd.DataFrame({"field": names, "term": terms, "key": keys, "tf": tfs, "dl": dls})


@dataclass(frozen=True)
class InvertedIndex:
    spark: SparkSession
    path: str
    key: str
    fields: dict[str, Field]
    stored: list[str]
    buckets: int
    schema: T.StructType

    # ---- making and keeping ---------------------------------------------------

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str, fields: dict[str, Field], stored: list[str], buckets: int = 16) -> InvertedIndex:
        """A new index in an empty folder. Keys are unique and not null (rows without key are left out).

        A search reads whole buckets less the row groups that sorting rules out, so ``buckets`` should grow with the
        corpus, to some 100 MB each.
        """
        spark = docs.sparkSession
        used = dict.fromkeys([key, *stored, *(c for f in fields.values() for c in f.columns)])
        kept = docs.select(*used, *[F.lit(0).alias(f"len_{n}") for n in fields]).schema
        made = cls(spark, path.rstrip("/"), key, fields, list(dict.fromkeys(stored)), buckets, T.StructType([T.StructField(f.name, f.dataType) for f in kept]))
        meta = json.dumps({"key": key, "fields": {n: [f.kind, *f.columns] for n, f in fields.items()}, "stored": made.stored, "buckets": buckets, "schema": made.schema.jsonValue()})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.parquet(f"{made.path}/meta")
        made._write(docs, 0, None)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedIndex:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        return cls(spark, path.rstrip("/"), meta["key"], {n: Field(kind, tuple(c)) for n, (kind, *c) in meta["fields"].items()}, meta["stored"], meta["buckets"], T.StructType.fromJson(meta["schema"]))

    def _write(self, docs: DataFrame, segment: int, gone: DataFrame | None) -> None:
        docs = docs.where(F.col(self.key).isNotNull())
        used = [n for n in self.schema.names if not n.startswith("len_") or n[4:] not in self.fields]
        lengths = {f"len_{n}": (F.size(f.parts()) if f.kind != "trigrams" else F.lit(None).cast("int")) for n, f in self.fields.items()}
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        rows = docs.select(self.key, *[c for c in used if c != self.key], *[F.when(v >= 0, v).alias(n) for n, v in lengths.items()], bucket.alias("bucket"))
        # rebalancing splits buckets that one hot key or term would overfill
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/docs/segment={segment}")
        own = self.spark.read.schema(self.schema).parquet(f"{self.path}/docs/segment={segment}")
        listed = [(n, f.kind) for n, f in self.fields.items()]
        parts = own.select(F.col(self.key).alias("key"), *[f.parts().alias(f"p{i}") for i, f in enumerate(self.fields.values())])
        post = parts.mapInPandas(lambda it: _counted(it, listed), self._posting())
        post = post.withColumn("bucket", self._bucket("field", "term"))
        post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        stats = self._sums(own, 1)
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{self.path}/removed/segment={segment}")
            keys = self.spark.read.schema(gone.schema).parquet(f"{self.path}/removed/segment={segment}")
            stats = stats.unionByName(self._sums(self.docs(below=segment).join(keys, self.key, "left_semi"), -1))
        stats.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment={segment}")

    def _sums(self, docs: DataFrame, sign: int) -> DataFrame:
        """Per field the documents that have it (for stems: have any) and their length."""
        out = []
        for n, f in self.fields.items():
            if f.kind != "trigrams":
                size = F.col(f"len_{n}")
                has = size.isNotNull() if f.kind == "words" else size > 0
                out.append(F.struct(F.lit(n).alias("field"), F.when(has, sign).otherwise(0).alias("n"), (F.coalesce(size, F.lit(0)) * sign).alias("total")))
        each = docs.select(F.explode(F.array(*out)).alias("s")).select("s.*")
        return each.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def _segments(self) -> int:
        """The number of segments that count: those whose statistics are complete. Nothing but folder names is read."""
        n = 0
        while path_exists(self.spark, f"{self.path}/stats/segment={n}/_SUCCESS"):
            n += 1
        return n

    def add(self, docs: DataFrame) -> InvertedIndex:
        """Documents join the index as one segment; those of known keys replace what was there."""
        self._write(docs, self._segments(), docs.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        return self

    def remove(self, keys: DataFrame) -> InvertedIndex:
        """Rows with these keys leave the index; unknown keys do nothing."""
        segment = self._segments()
        empty = self.spark.createDataFrame([], self.schema)
        self._write(empty, segment, keys.select(self.key).distinct())
        return self

    def compact(self, path: str) -> InvertedIndex:
        """The rows that count as one segment of a new index, to be put in the place of this one."""
        return InvertedIndex.build(self.docs(), path, self.key, self.fields, self.stored, self.buckets)

    # ---- reading --------------------------------------------------------------

    def _bucket(self, field: str | Column, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(field, term), F.lit(self.buckets)).cast("int")

    def _counting(self, rows: DataFrame, key: str, below: int) -> DataFrame:
        """Rows of committed segments that no later segment removed."""
        rows = rows.where(F.col("segment") < below)
        if below < 2 or not path_exists(self.spark, f"{self.path}/removed"):
            return rows
        schema = T.StructType([self.schema[self.key], T.StructField("segment", T.IntegerType())])
        gone = self.spark.read.schema(schema).parquet(f"{self.path}/removed").where(F.col("segment") < below).groupBy(F.col(self.key).alias("_gone")).agg(F.max("segment").alias("_until"))
        return rows.join(gone, (F.col(key) == F.col("_gone")) & (F.col("segment") < F.col("_until")), "left_anti")

    def _table(self, name: str) -> DataFrame:
        columns = self.schema.fields if name == "docs" else self._posting().fields
        folders = [T.StructField("segment", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
        return self.spark.read.schema(T.StructType([*columns, *folders])).parquet(f"{self.path}/{name}")

    def _posting(self) -> T.StructType:
        text, number = T.StringType(), T.LongType()
        return T.StructType([T.StructField(n, t) for n, t in (("field", text), ("term", text), ("key", self.schema[self.key].dataType), ("tf", number), ("dl", number))])

    def docs(self, below: int | None = None) -> DataFrame:
        below = self._segments() if below is None else below
        return self._counting(self._table("docs"), self.key, below).drop("segment", "bucket")

    def fetch(self, keys: DataFrame, columns: list[str]) -> DataFrame:
        """Stored columns of the given keys; up to ``MOST_LISTED`` keys are looked up in their buckets."""
        wanted = keys.select(self.key).distinct()
        few = wanted.select(self.key, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("b")).limit(MOST_LISTED + 1).collect()
        rows = self._table("docs")
        if len(few) <= MOST_LISTED:
            rows = rows.where(F.col("bucket").isin(sorted({r["b"] for r in few})) & F.col(self.key).isin([r[0] for r in few]))
        else:
            rows = rows.join(wanted, self.key, "left_semi")
        return self._counting(rows.select(self.key, *[c for c in columns if c != self.key], "segment"), self.key, self._segments()).drop("segment")

    def hits(self, terms: DataFrame) -> DataFrame:
        """(field, term, key, tf, dl) of the queried (field, term) pairs."""
        wanted = terms.select("field", "term")
        few = wanted.withColumn("b", self._bucket("field", "term")).limit(MOST_LISTED + 1).collect()
        rows = self._table("postings")
        if len(few) <= MOST_LISTED:
            rows = rows.where(F.col("bucket").isin(sorted({r["b"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})) & F.col("field").isin(sorted({r["field"] for r in few})))
        rows = self._counting(rows, "key", self._segments())
        # the list holds each field's terms for all fields: the pairs decide
        return rows.join(F.broadcast(wanted) if len(few) <= MOST_LISTED else wanted, ["field", "term"], "left_semi").select("field", "term", "key", "tf", "dl")

    def totals(self) -> DataFrame:
        """(field, n, total): documents and their length, one row per field."""
        stats = self.spark.read.schema("field string, n bigint, total bigint, segment int").parquet(f"{self.path}/stats").where(F.col("segment") < self._segments())
        return stats.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def _scored(self, queries: DataFrame, each: Column) -> DataFrame:
        """queries: (query_id, field, term). Sums ``each`` over (tf, dl, df, n, avg_dl) of the hits per query and key."""
        q = queries.select("query_id", "field", "term").distinct()
        hits = self.hits(q)
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
        known = self.totals().withColumn("avg_dl", F.col("total") / F.col("n"))
        weights = q.join(df, ["field", "term"]).join(F.broadcast(known), "field")
        scored = hits.join(weights, ["field", "term"]).withColumn("s", each)
        return scored.groupBy("query_id", "field", "key").agg(F.sum("s").alias("score")).withColumnRenamed("key", self.key)

    def lexical(self, queries: DataFrame, field: str, k: int) -> DataFrame:
        """(query_id, key, score, rank) as :func:`lodeworks.operators.lexical.lexical_topk`, from stored postings. queries: (query_id, term)."""
        scores = self._scored(queries.select("query_id", F.lit(field).alias("field"), "term"), F.col("tf") * idf("df", "n")).where("score > 0")
        scores = scores.select("query_id", self.key, F.round("score", 6).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def bm25(self, queries: DataFrame, fields: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, field, key, score) of BM25 over each field of stems. queries: (query_id, stem)."""
        asked = queries.select("query_id", F.col("stem").alias("term"), F.explode(F.array(*map(F.lit, fields))).alias("field"))
        each = idf("df", "n") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
        return self._scored(asked, each)

    def containing(self, phrases: DataFrame, field: str, *alternatives: list[str]) -> DataFrame:
        """(query_id, key, within): rows where the columns of an alternative, joined by line ends, contain the phrase, case-insensitively.

        phrases: (query_id, phrase). within is the number of the alternative. The trigrams of a phrase give
        the candidates, their text decides. A phrase below three characters has no trigrams: for those the stored columns are scanned.
        """
        columns = list(dict.fromkeys(c for a in alternatives for c in a))
        asked = phrases.select("query_id", F.lower("phrase").alias("p")).where("p <> ''").distinct()
        long = asked.where("length(p) >= 3").withColumn("grams", F.expr("array_distinct(transform(sequence(1, length(p) - 2), i -> substring(p, i, 3)))"))
        grams = long.select("query_id", "p", F.size("grams").alias("all"), F.lit(field).alias("field"), F.explode("grams").alias("term"))
        found = self.hits(grams).join(grams, ["field", "term"]).groupBy("query_id", "p", "all", "key").agg(F.count("*").alias("n")).where("n = all")
        found = found.select("query_id", "p", F.col("key").alias(self.key))
        few = found.limit(MOST_LISTED + 1).collect()
        if len(few) <= MOST_LISTED:
            found = self.spark.createDataFrame(few, found.schema)

        def within(p: Column) -> Column:
            marks = [F.when(F.contains(F.lower(F.concat_ws("\n", *a)), p), F.lit(i)) for i, a in enumerate(alternatives)]
            return F.explode(F.array_compact(F.array(*marks))).alias("within")

        out = found.join(self.fetch(found, columns), self.key).select("query_id", self.key, within(F.col("p")))
        short = asked.where("length(p) < 3").limit(MOST_LISTED + 1).collect()
        if len(short) > MOST_LISTED:
            raise ValueError(f"more than {MOST_LISTED} phrases below three characters: ask them in parts")
        if short:
            listed = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.lit(r["p"]).alias("p")) for r in short])
            rows = self.docs().select(self.key, *[c for c in columns if c != self.key], F.explode(listed).alias("q"))
            out = out.unionByName(rows.select("q.query_id", self.key, within(F.col("q.p"))))
        return out.distinct()


#: Fields of an index of chunks for :func:`full_text_search`.
CHUNK_FIELDS = {
    "text": Field("words", ("text",)), "name": Field("name_stems", ("symbol_name",)), "doc": Field("stems", ("docstring",)), "grams": Field("trigrams", ("symbol_name", "text")),
}


def full_text_search(index: InvertedIndex, queries: dict[str, str], k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): names and docstrings by BM25 over stems, names and texts and texts alone by phrase, fused by reciprocal rank."""
    from lodeworks.operators.fusion import fused
    from lodeworks.operators.lexical import stemmed_queries

    spark, key = index.spark, index.key
    phrases = spark.createDataFrame(list(queries.items()), "query_id string, phrase string")
    # rounded, so that equal documents tie whatever the order of the sums
    stems = index.bm25(stemmed_queries(spark, queries), ["name", "doc"]).withColumn("score", F.round("score", 9))
    held = index.containing(phrases, "grams", ["symbol_name", "text"], ["text"])
    # the text alone is searched for phrases of three characters or more
    short = [q for q, text in queries.items() if len(text) < 3]
    held = held.where(~((F.col("within") == 1) & F.col("query_id").isin(short))) if short else held
    tiers = stems.select("query_id", "field", key, "score").unionByName(held.select("query_id", F.concat(F.lit("in"), "within").alias("field"), key, F.lit(1.0).alias("score")))
    order = W.partitionBy("query_id", "field").orderBy(F.desc("score"), key)
    return fused([tiers.select("query_id", key, F.row_number().over(order).alias("rank"))], "query_id", key, k)
