"""Queries of retrieval and ranking."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import counting_rows, micros_of, session_dir, table
from lodeworks.functions import text as tx
from lodeworks.operators import fusion, inverted, lexical, vector
from lodeworks.operators.vector_index import VectorIndex
from lodeworks.plans import search
from lodeworks.queries.base import CHUNKS_SQL, TOKENS, chunk_index, chunks, document_index

#: The questions that the retrieval queries ask.
QUESTIONS = {"q1": "vector store limit", "q2": "graph loader ignores files", "q3": "dependency cache reindex", "q4": "файлы больше памяти"}
NAMES = {"n1": "merge_rank", "n2": "filter", "n3": "BatchDigest"}


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return document_index(spark, sf).lexical(lexical.query_terms(spark, QUESTIONS), "text", 20).withColumnRenamed("chunk_id", "doc_id")


def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "graph_nodes").select("name").where("name is not null").distinct()
    return names.select("name", tx.split_identifier("name").alias("words"))


def token_savings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.groupBy("project").agg(F.sum(tx.token_estimate("text")).alias("tokens"), F.count("*").alias("docs"))


def _vectors(spark: SparkSession, sf: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    ask = rows.orderBy("vec_id").limit(n).select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows, ask


def _every_hundredth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole query set: every row whose id is divisible by 100."""
    rows = table(spark, sf, "embeddings")
    ask = rows.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows, ask


def vector_knn(spark: SparkSession, sf: str, vectors=_vectors) -> DataFrame:
    rows, ask = vectors(spark, sf)
    return vector.knn(rows, "vec_id", "embedding", ask, 20)


def vector_knn_per_label(spark: SparkSession, sf: str, vectors=_vectors) -> DataFrame:
    rows, ask = vectors(spark, sf)
    return vector.knn(rows, "vec_id", "embedding", ask, 3, group="label")


def cross_project_search(spark: SparkSession, sf: str, vectors=_vectors) -> DataFrame:
    rows, ask = vectors(spark, sf)
    return search.multi_search(rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label"), ask, "label", 10)


def _rankings(spark: SparkSession, sf: str) -> list[DataFrame]:
    docs = table(spark, sf, "documents").withColumn("g", F.coalesce("project", F.lit("")))
    size = F.coalesce(F.length("text"), F.lit(0))
    return [
        fusion.ranked(docs.withColumn("score", size), "g", "doc_id"),
        fusion.ranked(docs.withColumn("score", -size), "g", "doc_id"),
        fusion.ranked(docs.withColumn("score", F.col("doc_id") % 97), "g", "doc_id"),
    ]


def rrf_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fused(_rankings(spark, sf), "g", "doc_id", 10)


def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    a, _, b = _rankings(spark, sf)
    return fusion.weighted_fusion(a, b, "g", "doc_id", F.col("doc_id") % 10 == 0)


def bucket_weight(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).select("chunk_id", "file_path")
    for name in ("code", "docs", "auto"):
        rows = rows.withColumn(name, F.round(fusion.bucket_weight("file_path", F.lit(name)), 6))
    return rows.drop("file_path")


def exact_boost_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).where("symbol_name is not null and symbol_name <> ''").withColumn("score", F.length(F.coalesce("text", F.lit(""))) * 0.001)
    asks = spark.createDataFrame(list(NAMES.items()), "query_id string, query string")
    at = rows.join(F.broadcast(asks), F.expr("contains(lower(symbol_name), lower(query))"))
    last = F.lower(F.element_at(F.split("symbol_name", r"::|\."), -1))
    at = fusion.exact_boost(at, "query_id", "chunk_id", F.contains(last, F.lower("query")), "file_path")
    return fusion.best_per(at, ["query_id", "file_path", "symbol_name"], "chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "boosted")


def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    asks = spark.createDataFrame(list(NAMES.items()), "query_id string, phrase string")
    return chunk_index(spark, sf).containing(asks, "grams", ["symbol_name", "text"]).drop("within")


def full_text_search(spark: SparkSession, sf: str) -> DataFrame:
    return inverted.full_text_search(chunk_index(spark, sf), NAMES | {"n4": "stored offsets"}, 10)


def mmr_rerank(spark: SparkSession, sf: str, vectors=_vectors) -> DataFrame:
    rows, ask = vectors(spark, sf)
    near = vector.knn(rows, "vec_id", "embedding", ask, 30).join(rows.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return fusion.mmr(near.withColumn("score", 1 - F.col("distance")).select("query_id", "vec_id", "score", "vector"), "query_id", "vec_id", 10)


def context_search(spark: SparkSession, sf: str, vectors=_vectors) -> DataFrame:
    rows, ask = vectors(spark, sf)
    rows = rows.withColumn("text", F.concat(F.lit("row "), F.col("vec_id") % 50))
    asks = ask.withColumn("query_text", F.concat(F.lit("row "), F.col("query_id").cast("bigint") % 50))
    return vector.context_search(rows, "vec_id", "embedding", "text", asks, 10)


def score_floor(spark: SparkSession, sf: str, vectors=_vectors) -> DataFrame:
    rows, ask = vectors(spark, sf)
    near = vector.knn(rows, "vec_id", "embedding", ask, 50).withColumn("score", F.round(1 - F.col("distance"), 6))
    return fusion.score_floor(near, "query_id").select("query_id", "vec_id", "score", F.round(fusion.min_max("score", "query_id"), 6).alias("relevance"))


def query_kinds(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "graph_nodes").where("name <> ''").select(F.concat_ws(" ", F.lower("label"), "name").alias("query")).distinct()
    return names.select("query", tx.intent("query").alias("intent"), tx.complexity("query").alias("complexity"), tx.is_identifier("query").alias("identifier"))


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of the first three files, by path."""
    guard = table(spark, sf, "index_guard").where("size(vector) = 64").groupBy("file_path").agg(F.min_by("vector", "id").alias("vector")).orderBy("file_path").limit(3)
    return guard.select(F.concat(F.lit("q"), F.row_number().over(W.orderBy("file_path"))).alias("query_id"), F.col("vector").alias("query_vector"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(chunk_index(spark, sf), {k: QUESTIONS[k] for k in ("q1", "q2", "q3")}, _query_vectors(spark, sf), trace=True)


def deep_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.deep_search(document_index(spark, sf), "graph loader limit")


def decomposed_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.decomposed_search(document_index(spark, sf), "vector store limit and dependency cache; nightly reindex")


def updated_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same questions after every tenth document changed its text and every tenth other one was removed."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    path = f"{session_dir(spark)}/index-{uuid.uuid4().hex}"
    index = inverted.InvertedIndex.build(docs, path, "chunk_id", {"text": inverted.Field("words", ("text",))}, ["text"])
    index.add(docs.where("chunk_id % 10 = 3").withColumn("text", F.concat(F.lit("nightly limit of the vector "), F.coalesce("text", F.lit("")))))
    index.remove(docs.where("chunk_id % 10 = 4"))
    return index.lexical(lexical.query_terms(spark, QUESTIONS), "text", 20).withColumnRenamed("chunk_id", "doc_id")


def vector_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector of index_guard whose place by id is divisible by 100 asks the stored index of all of them."""
    rows = table(spark, sf, "index_guard")
    vec = counting_rows(rows, "id", micros_of(rows, "indexed_at"), vector=F.col("vector")).where("size(vector) = 64 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < 1e30)")
    index = VectorIndex.build(vec, f"{session_dir(spark)}/vectors-{uuid.uuid4().hex}", "id", "vector")
    return index.search(vec.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 10)


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, identifier_split, token_savings, vector_knn, vector_knn_per_label, cross_project_search, rrf_three_way, weighted_fusion, bucket_weight, exact_boost_dedupe,
        substring_search, full_text_search, mmr_rerank, context_search, score_floor, query_kinds, hybrid_search, deep_search, decomposed_search, updated_search, vector_index_search,
    )
}

#: The searches over the whole query set, registered as ``<name>_set``.
SEARCHES = (vector_knn, vector_knn_per_label, cross_project_search, mmr_rerank, context_search, score_floor)
QUERIES |= {f"{f.__name__}_set": partial(f, vectors=_every_hundredth) for f in SEARCHES}

_ASK = "ask AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 5)"
_ASK_SET = "ask AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)"
_DIST = "round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6)"
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in QUESTIONS.items())
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items())


def _topk_sql(values: str, k: int, documents: str = "") -> str:
    return f"""
    WITH {documents} asks(query_id, q) AS (VALUES {values}),
    terms AS (SELECT DISTINCT query_id, t AS term FROM asks, unnest({TOKENS.format(c="q")}) AS u(t) WHERE t <> ''),
    post AS (SELECT doc_id, t AS term, count(*) AS tf FROM documents, unnest({TOKENS.format(c="text")}) AS u(t) WHERE text IS NOT NULL GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(tf * ln((n.n - df + 0.5) / (df + 0.5) + 1)), 6) AS score FROM terms JOIN post USING (term) JOIN df USING (term), n GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= {k}"""


_RANKS = """rows AS (SELECT coalesce(project, '') AS g, doc_id, coalesce(length(text), 0) AS size FROM documents),
  ra AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY size DESC, doc_id) AS rank FROM rows),
  rb AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY -size DESC, doc_id) AS rank FROM rows),
  rc AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id % 97 DESC, doc_id) AS rank FROM rows)"""

_WORDS = r"string_split_regex(regexp_replace(regexp_replace(regexp_replace(name, '::|->|\.|_', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '\s+')"

#: The words that share a stem with a word of the questions of full_text_search, spelled out.
_FORMS = [
    ("n1", "merg(e|es|ed|ing)"), ("n1", "rank(s|ed|ing|ings)?"), ("n2", "filter(s|ed|ing|ings)?"), ("n3", "batch(es|ed|ing)?"), ("n3", "digest(s|ed|ing)?"),
    ("n4", "stor(e|es|ed|ing)"), ("n4", "offset(s|ted|ting)?"),
]


def _bm25_sql(tier: str, text: str) -> str:
    """CTEs that end in ``tier`` (query_id, chunk_id, rank)."""
    return f"""{tier}_t AS (SELECT chunk_id, t FROM w, unnest({TOKENS.format(c=text)}) AS u(t) WHERE t <> ''),
    {tier}_d AS (SELECT chunk_id, count(*) AS dl FROM {tier}_t GROUP BY ALL), {tier}_n AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM {tier}_d),
    {tier}_f AS (SELECT query_id, form, chunk_id, count(*) AS tf FROM {tier}_t JOIN forms ON regexp_full_match(t, form) GROUP BY ALL),
    {tier}_df AS (SELECT query_id, form, count(*) AS df FROM {tier}_f GROUP BY ALL),
    {tier}_s AS (SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 9) AS score
      FROM {tier}_f JOIN {tier}_df USING (query_id, form) JOIN {tier}_d USING (chunk_id), {tier}_n GROUP BY ALL),
    {tier} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {tier}_s)"""


_FUSED = """t AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({lists}) GROUP BY ALL),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM t) SELECT * FROM o WHERE rank <= 10"""
_ASKED = _NAMES + ", ('n4', 'stored offsets')"
_PHRASE = "row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM w, asks WHERE contains(lower({hay}), lower(phrase))"

ORACLES = {
    "full_text_search": f"""WITH {CHUNKS_SQL}, w AS (SELECT * FROM c WHERE text IS NOT NULL), asks(query_id, phrase) AS (VALUES {_ASKED}), forms(query_id, form) AS (VALUES {", ".join(map(str, _FORMS))}),
    names AS (SELECT chunk_id, {_WORDS.replace("name", "symbol_name")} AS x FROM w WHERE symbol_name IS NOT NULL),
    {_bm25_sql("a", "nm").replace("FROM w,", "FROM (SELECT chunk_id, array_to_string(list_concat(x, [lower(y) FOR y IN x IF lower(y) <> y]), ' ') AS nm FROM names) AS w,")},
    {_bm25_sql("d", "docstring")},
    b AS (SELECT query_id, chunk_id, {_PHRASE.format(hay="concat_ws(chr(10), symbol_name, text)")}), e AS (SELECT query_id, chunk_id, {_PHRASE.format(hay="text")}),
    {_FUSED.format(lists="FROM a UNION ALL FROM b UNION ALL FROM e UNION ALL FROM d")}""",
    "decomposed_search": f"""WITH x AS ({_topk_sql("('1', 'vector store limit'), ('2', 'dependency cache'), ('3', 'nightly reindex')", 20)}),
    y AS (SELECT 'all' AS query_id, doc_id AS chunk_id, rank FROM x), {_FUSED.format(lists="FROM y")}""".replace("SELECT * FROM o", "SELECT chunk_id, score, rank FROM o"),
    "lexical_topk": _topk_sql(_VALUES, 20),
    "updated_search": _topk_sql(_VALUES, 20, """documents AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'nightly limit of the vector ' || coalesce(text, '') ELSE text END AS text
        FROM main.documents WHERE doc_id % 10 <> 4),"""),
    "identifier_split": f"""SELECT name, array_to_string(list_concat(w, [lower(x) FOR x IN w IF lower(x) <> x]), ' ') AS words
        FROM (SELECT name, [x FOR x IN {_WORDS} IF x <> ''] AS w FROM (SELECT DISTINCT name FROM graph_nodes WHERE name IS NOT NULL))""",
    "token_savings": "SELECT project, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY project",
    "vector_knn": f"""WITH {_ASK}, s AS (SELECT query_id, vec_id, {_DIST} AS distance FROM embeddings, ask),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""",
    "vector_knn_per_label": f"""WITH {_ASK}, s AS (SELECT query_id, label, vec_id, {_DIST} AS distance FROM embeddings, ask),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
    "cross_project_search": f"""WITH {_ASK}, s AS (SELECT query_id, label, vec_id, {_DIST} AS distance FROM embeddings, ask),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM s),
        t AS (SELECT query_id, vec_id AS chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r WHERE rank <= 10 GROUP BY ALL),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM t) SELECT * FROM o WHERE rank <= 10""",
    "rrf_three_way": f"""WITH {_RANKS}, t AS (SELECT g, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM ra UNION ALL FROM rb UNION ALL FROM rc) GROUP BY ALL),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM t) SELECT * FROM o WHERE rank <= 10""",
    "weighted_fusion": f"""WITH {_RANKS}, a AS (SELECT g, doc_id, 1 - (rank - 1) / count(*) OVER (PARTITION BY g) AS a FROM ra), b AS (SELECT g, doc_id, 1 - (rank - 1) / count(*) OVER (PARTITION BY g) AS b FROM rc)
        SELECT g, doc_id, round((0.3::DOUBLE * a + 0.7::DOUBLE * coalesce(b, 0)) * CASE WHEN doc_id % 10 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM a LEFT JOIN b USING (g, doc_id)""",
    "bucket_weight": f"""WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, lower(regexp_extract(file_path, '[^/\\\\](\\.[^./\\\\]*)$', 1)) AS ext FROM c),
        k AS (SELECT chunk_id, CASE WHEN ext IN ('.py','.rs','.js','.ts','.go','.cpp','.c','.h','.hpp','.java','.json','.toml','.yaml','.yml') THEN 'code' WHEN ext IN ('.md','.txt','.rst','.log') THEN 'docs' END AS kind FROM x)
        SELECT chunk_id, CAST(CASE kind WHEN 'code' THEN 1.2 WHEN 'docs' THEN 0.4 ELSE 1 END AS DOUBLE) AS code, CAST(CASE kind WHEN 'code' THEN 0.8 WHEN 'docs' THEN 0.6 ELSE 1 END AS DOUBLE) AS docs,
          CAST(CASE kind WHEN 'docs' THEN 0.5 ELSE 1 END AS DOUBLE) AS auto FROM k""",
    "exact_boost_dedupe": f"""WITH {CHUNKS_SQL}, asks(query_id, query) AS (VALUES {_NAMES}),
        s AS (SELECT query_id, chunk_id, file_path, symbol_name, length(coalesce(text, '')) * 0.001::DOUBLE AS score,
            contains(lower(string_split_regex(symbol_name, '::|\\.')[-1]), lower(query)) AND NOT regexp_matches(lower(file_path), '\\.(md|markdown|rst|txt|ipynb)$') AS boosted
          FROM c, asks WHERE symbol_name IS NOT NULL AND symbol_name <> '' AND contains(lower(symbol_name), lower(query))),
        b AS (SELECT query_id, chunk_id, file_path, symbol_name, CASE WHEN boosted THEN score * 100.0::DOUBLE ELSE score END AS score, boosted FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, symbol_name ORDER BY score DESC, chunk_id) AS rn FROM b)
        SELECT query_id, chunk_id, round(score, 6) AS score, boosted FROM r WHERE rn = 1""",
    "substring_search": f"""WITH {CHUNKS_SQL}, asks(query_id, phrase) AS (VALUES {_NAMES})
        SELECT query_id, chunk_id FROM c, asks WHERE contains(lower(concat_ws(chr(10), symbol_name, text)), lower(phrase))""",
    "context_search": f"""WITH {_ASK}, s AS (SELECT query_id, vec_id, 'row ' || (vec_id % 50) AS text, {_DIST} AS distance FROM embeddings, ask WHERE vec_id % 50 <> CAST(query_id AS BIGINT) % 50),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY distance, vec_id) AS rn FROM s),
        r AS (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM h WHERE rn = 1) SELECT * FROM r WHERE rank <= 10""",
    "score_floor": f"""WITH {_ASK}, s AS (SELECT query_id, vec_id, {_DIST} AS distance FROM embeddings, ask),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s), t AS (SELECT query_id, vec_id, round(1 - distance, 6) AS score FROM r WHERE rank <= 50),
        f AS (SELECT *, count(*) FILTER (score >= 0.3) OVER (PARTITION BY query_id) AS n FROM t), k AS (SELECT query_id, vec_id, score FROM f WHERE score >= 0.3 OR n = 0)
        SELECT query_id, vec_id, score, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1.0), 6) AS relevance FROM k WINDOW w AS (PARTITION BY query_id)""",
}

ORACLES |= {f"{f.__name__}_set": ORACLES[f.__name__].replace(_ASK, _ASK_SET) for f in SEARCHES if f.__name__ in ORACLES}
