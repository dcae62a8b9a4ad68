"""What surrounds a symbol, a file or a search result: neighbours, related tests, suggestions, stamps, drift of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.operators.chunking import instruction_risks, module_of
from lodeworks.operators.graph import bfs, impact, links, of_type


def find_nodes(nodes: DataFrame, label: str | None = None, name_part: str | None = None, file_path: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Nodes by label (any letter case), part of the name and path, in order of name and id."""
    at = nodes
    if label is not None:
        at = at.where(F.lower("label") == label.lower())
    if name_part is not None:
        at = at.where(F.contains(F.lower("name"), F.lit(name_part.lower())))
    if file_path is not None:
        at = at.where(F.col("file_path") == file_path)
    return at.orderBy("name", "id").offset(offset).limit(limit)


def symbol_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees, in_file): how many symbols call each function or method, are called by it, and share its file."""
    code = nodes.where(F.lower("label").isin("function", "method"))
    calls = of_type(edges, "CALLS").where("source_id <> target_id").select("source_id", "target_id").distinct()
    known = nodes.select("id")
    calls = calls.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    up = calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    down = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    files = nodes.where("file_path <> ''").groupBy("file_path").agg((F.count("*") - 1).alias("in_file"))
    return code.select("id", "file_path").join(up, "id", "left").join(down, "id", "left").join(files, "file_path", "left").fillna(0, ["callers", "callees", "in_file"]).select("id", "callers", "callees", "in_file")


def symbols_in_file(nodes: DataFrame, file_path: str) -> DataFrame:
    """Symbols of one file in order of their line."""
    line = F.coalesce(F.get_json_object("properties", "$.line").cast("int"), F.lit(0))
    return nodes.where(F.col("file_path") == file_path).select("id", "name", "label", line.alias("line")).orderBy("line", "name", "id")


def call_chain(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "outgoing", max_depth: int = 3) -> DataFrame:
    """(start, node, name, depth): what the symbols of a name call, or what calls them, by depth."""
    starts = nodes.where(F.col("name") == name).select(F.col("id").alias("start"))
    reached = bfs(links(of_type(edges, "CALLS"), direction), starts, max_depth).select("start", "node", "depth")
    return reached.join(nodes.select(F.col("id").alias("node"), "name"), "node").select("start", "node", "name", "depth")


def related_tests(files: DataFrame) -> DataFrame:
    """(file_path, test): tests named after a file: test_<stem>..., <stem>_test or <stem>.test.

    files: (file_path). The stem of a test, less its marks, is compared as a whole and by its leading words, so
    the join is on names and not on all pairs.
    """
    at = files.where("file_path is not null").select("file_path").distinct().withColumn("stem", F.lower(module_of("file_path")))
    bare = F.regexp_replace("stem", r"^tests?_|[._-](?:tests?|spec)$", "")
    tests = at.where(bare != F.col("stem")).select(F.col("file_path").alias("test"), F.split(bare, "_").alias("w"))
    heads = tests.select("test", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.array_join(F.slice("w", 1, n), "_"))).alias("stem")).where("stem <> ''").distinct()
    sources = at.where((bare == F.col("stem")) & (F.col("stem") != ""))
    return sources.join(heads, "stem").select("file_path", "test").distinct()


def feature_report(nodes: DataFrame, edges: DataFrame, starts: DataFrame, tests: DataFrame, bugs: DataFrame, max_depth: int = 2) -> DataFrame:
    """One row per start: :func:`impact`, the tests of its file and the bug fixes in it.

    tests: (file_path, test); bugs: (file_path, bugs).
    """
    at = nodes.select(F.col("id").alias("start"), "name", "file_path").join(starts.select("start").distinct(), "start", "left_semi")
    covered = tests.groupBy("file_path").agg(F.count("*").alias("tests"))
    return (
        at.join(impact(nodes, edges, starts, max_depth), "start").join(covered, "file_path", "left").join(bugs.select("file_path", "bugs"), "file_path", "left").fillna(0, ["tests", "bugs"])
        .select("start", "name", "direct_callers", "transitive_callers", "direct_callees", "files", "risk", "level", "tests", "bugs")
    )


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, functions, without_callers, calls_out) of each file."""
    code = nodes.where(F.lower("label").isin("function", "method") & (F.col("file_path") != ""))
    calls = of_type(edges, "CALLS")
    called = calls.select(F.col("target_id").alias("id")).distinct().withColumn("called", F.lit(True))
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out"))
    at = code.join(called, "id", "left").join(out, "id", "left")
    return at.groupBy("file_path").agg(F.count("*").alias("functions"), F.count_if(F.col("called").isNull()).alias("without_callers"), F.coalesce(F.sum("out"), F.lit(0)).alias("calls_out"))


def real_result(text: str, file_path: str) -> Column:
    """Whether a row of a result says anything: a path and text beyond blanks."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False)) & F.coalesce(F.trim(file_path) != "", F.lit(False))


def stamped(results: DataFrame, file_path: str, text: str) -> DataFrame:
    """Adds trust (by the kind of file) and risks (instructions in the text) to search results."""
    path = F.lower(F.replace(F.col(file_path), F.lit("\\"), F.lit("/")))
    vendored = path.rlike(r"(?:^|/)(?:vendor|node_modules|third_party|site-packages)/")
    trust = F.when(vendored, "external").when(path.rlike(r"\.(?:md|rst|txt)$"), "docs").when(path.rlike(r"\.[a-z0-9]+$"), "code").otherwise("unknown")
    return results.withColumn("trust", F.coalesce(trust, F.lit("unknown"))).withColumn("risks", instruction_risks(text))


def nearest_names(lost: DataFrame, names: DataFrame, k: int = 1, most: int = 3) -> DataFrame:
    """(lost, name, distance): the nearest known names of lost ones within ``most`` edits and a quarter of the lost name.

    lost, names: (name). Of a name cut into d + 1 parts, d edits leave one part as it is and move it by d characters at
    most: parts and places are the join key, so distances are taken within like names alone. Names of
    fewer than four characters get no suggestion.
    """
    want = lost.where(F.length("name") >= 4).select(F.col("name").alias("lost"), F.least(F.lit(most), F.floor(F.length("name") / 4).cast("int")).alias("d")).distinct()
    known = names.where("name is not null").select("name").distinct()
    size = F.floor(F.length("lost") / (F.col("d") + 1)).cast("int")
    left = want.withColumn("n", size).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    left = left.select("lost", "d", "n", (F.col("i") * F.col("n") + 1).alias("from"), F.expr("substring(lost, i * n + 1, n)").alias("part"))
    left = left.select("lost", "d", "n", "part", F.explode(F.expr("sequence(greatest(1, from - d), from + d)")).alias("at"))
    grams = known.join(F.broadcast(left.select("n").distinct()), F.length("name") >= F.col("n"))  # one row a part length, at most a quarter of the longest name
    grams = grams.withColumn("at", F.explode(F.expr("sequence(1, length(name) - n + 1)"))).select("name", "n", "at", F.expr("substring(name, at, n)").alias("part"))
    pairs = left.join(grams, ["part", "n", "at"]).where(F.abs(F.length("name") - F.length("lost")) <= F.col("d")).select("lost", "name", "d").distinct()
    near = pairs.withColumn("distance", F.levenshtein("lost", "name")).where("distance <= d").drop("d")
    order = W.partitionBy("lost").orderBy("distance", "name")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def drifted(anchors: DataFrame, hashes: DataFrame, width: int = 8) -> DataFrame:
    """(doc, symbol, noted, now): references whose noted hash is no longer the beginning of the symbol's.

    anchors: (doc, symbol, hash); hashes: (symbol, hash), one row per symbol.
    """
    now = hashes.select("symbol", F.col("hash").alias("h"))
    return anchors.join(now, "symbol").where(F.left("h", F.lit(width)) != F.left("hash", F.lit(width))).select("doc", "symbol", F.left("hash", F.lit(width)).alias("noted"), F.left("h", F.lit(width)).alias("now"))


def keyword_fallback(rows: DataFrame, key: str, text: str, query: str, limit: int = 20) -> DataFrame:
    """(key, hits): rows with any word of the query of more than two letters, those with most first."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 2]
    if not words:
        return rows.select(key, F.lit(0).alias("hits")).limit(0)
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return rows.where(F.col(text).isNotNull()).select(key, hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key).limit(limit)


def relation_summary(relations: DataFrame) -> DataFrame:
    """(kind, relations, files, weight) of relations (file_a, file_b, kind, weight)."""
    ends = relations.select("kind", F.explode(F.array("file_a", "file_b")).alias("f")).groupBy("kind").agg(F.count_distinct("f").alias("files"))
    return relations.groupBy("kind").agg(F.count("*").alias("relations"), F.round(F.sum("weight"), 6).alias("weight")).join(ends, "kind").select("kind", "relations", "files", "weight")


def subquery_relations(hits: DataFrame) -> DataFrame:
    """(query_a, query_b, shared): sub-queries that found the same files (R29). hits: (query_id, file_path); queries are few, so a file has few of them."""
    own = hits.where("file_path is not null").select("query_id", "file_path").distinct()
    a, b = own.select(F.col("query_id").alias("query_a"), "file_path"), own.select(F.col("query_id").alias("query_b"), "file_path")
    return a.join(b, "file_path").where("query_a < query_b").groupBy("query_a", "query_b").agg(F.count("*").alias("shared"))


def children(chunks: DataFrame, parent: str) -> DataFrame:
    """Rows of one parent."""
    return chunks.where(F.col("parent_id") == parent)
