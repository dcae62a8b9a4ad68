"""Queries of chunking, extraction and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.common import table
from lodeworks.operators import chunking as ch
from lodeworks.operators import duplicates as du
from lodeworks.operators import memory as mem
from lodeworks.queries.base import CHUNKS_SQL, FILES_SQL, chunks, guard_files


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def char_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ch.char_windows(_docs(spark, sf), "doc_id", "text").select("doc_id", "chunk", "start", F.length("text").alias("chars"), F.md5("text").alias("hash"))


def line_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ch.line_windows(guard_files(spark, sf), "file_path", "text").select("file_path", "chunk", "line_start", "line_end", F.md5("text").alias("hash"))


def section_split(spark: SparkSession, sf: str) -> DataFrame:
    return ch.sections(_docs(spark, sf), "doc_id", "text").withColumn("title", F.coalesce("title", F.lit("")))


def code_references(spark: SparkSession, sf: str) -> DataFrame:
    return ch.code_references(_docs(spark, sf), "doc_id", "text")


def broken_references(spark: SparkSession, sf: str) -> DataFrame:
    """References in documents that no symbol's name matches."""
    refs = ch.code_references(_docs(spark, sf), "doc_id", "text")
    names = table(spark, sf, "graph_nodes").where("name <> ''").select(F.col("name").alias("last")).distinct()
    return refs.withColumn("last", F.element_at(F.split("reference", r"\.|::"), -1)).join(names, "last", "left_anti").select("doc_id", "reference")


def version_strings(spark: SparkSession, sf: str) -> DataFrame:
    return ch.versions(_docs(spark, sf), "doc_id", "text")


def anchor_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the files that a document names are in the index."""
    anchors = ch.claim_anchors(_docs(spark, sf), "doc_id", "text").where("kind = 'file'")
    present = ch.fingerprint(guard_files(spark, sf), "file_path", "text").where("kind = 'file'")
    return mem.verdicts(anchors, present, "doc_id")


def imports_found(spark: SparkSession, sf: str) -> DataFrame:
    return ch.imports_by_pattern(guard_files(spark, sf), "file_path", "text")


def symbols_found(spark: SparkSession, sf: str) -> DataFrame:
    return ch.symbols_by_pattern(guard_files(spark, sf), "file_path", "text")


def python_facts(spark: SparkSession, sf: str) -> DataFrame:
    return ch.code_facts(guard_files(spark, sf), "file_path", "text")


def python_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ch.python_chunks(guard_files(spark, sf), "file_path", "text").drop("full")


def symbol_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return ch.symbol_hashes(guard_files(spark, sf).where("file_path like '%.py'"), "file_path", "text")


def structural_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ch.structural_counts(guard_files(spark, sf), "file_path", "text")


def code_health(spark: SparkSession, sf: str) -> DataFrame:
    at = ch.code_health(guard_files(spark, sf).where("file_path not like '%.md'"), "file_path", "text")
    return at.withColumn("complexity", F.col("complexity").cast("bigint")).drop("depth")


def instruction_risks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.array_join(ch.instruction_risks("text"), ",").alias("risks"))
    return rows.where("risks <> ''")


def path_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).select("chunk_id", "file_path", "symbol_name")
    return ch.chunk_metadata(rows, "file_path", "symbol_name").select("chunk_id", "layer", "module_name", "is_public", "parent_id")


def chunk_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", ch.summaries(None, "symbol_name", "symbol_kind", "docstring", "text").alias("summary"))


def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    return du.exact_groups(_docs(spark, sf), "doc_id", "text")


def near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return du.near_duplicates(_docs(spark, sf), "doc_id", "text")


def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Links between the representatives of different texts."""
    docs = _docs(spark, sf).where("text is not null")
    reps = docs.groupBy(F.array_join(du.words("text"), " ").alias("w")).agg(F.min("doc_id").alias("k")).where("w <> ''")
    return du.similarity_join(reps.select("k", du.shingle_set("w").alias("f")), "k", "f", 0.8)


def code_copies(spark: SparkSession, sf: str) -> DataFrame:
    return du.symbol_copies(chunks(spark, sf).where("lower(symbol_kind) in ('function', 'method', 'function_definition')"), "chunk_id", "text")


def _function_rows(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).where("lower(trim(symbol_kind)) in ('function', 'method', 'function_definition', 'method_definition', 'function_part', 'constructor')")


def code_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Links between functions alike up to names, one function of each class of :func:`code_classes` taking part."""
    return du.symbol_duplicates(_function_rows(spark, sf), "chunk_id", "text")


def code_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every function: which function represents it in :func:`code_near_copies`."""
    return du.symbol_classes(_function_rows(spark, sf), "chunk_id", "text")


def contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share runs of eight words with glossaries."""
    return _held_out(spark, sf, F.lower("source").rlike("^glossary"))


def review_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share runs of eight words with review comments, however their source is spelled."""
    return _held_out(spark, sf, F.regexp_replace(F.lower(F.trim("source")), r"[-\s]+", "_") == "review_comment")


def _held_out(spark: SparkSession, sf: str, condition: Column) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").withColumn("held", F.coalesce(condition, F.lit(False)))
    held = docs.where("held").select(F.col("doc_id").alias("item_id"), "text")
    return du.contamination(docs.where("not held").select("doc_id", "text"), "doc_id", "text", held, "item_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        char_windows, line_windows, section_split, code_references, broken_references, version_strings, anchor_verdicts, imports_found, symbols_found, python_facts, python_chunks, symbol_hashes,
        structural_counts, code_health, instruction_risks, path_metadata, chunk_summaries, exact_dups, near_dups, near_dup_pairs, code_copies, code_near_copies, code_classes, contamination, review_contamination,
    )
}

_SPLIT = r"string_split_regex(lower(text), '[^\p{L}\p{N}_]+')"
_REFS = r"""r AS (SELECT DISTINCT doc_id, regexp_replace(x, '\(.*\)$', '') AS reference FROM (
    SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?(```|$)', ' ', 'g'), '`([^`\n]+)`', 1)) AS x FROM documents)),
  f AS (SELECT * FROM r WHERE regexp_matches(reference, '^[A-Za-z_][\w]*(?:(?:\.|::)[A-Za-z_]\w*)*$') AND length(reference) >= 3
    AND NOT regexp_matches(reference, '(?i)^(true|false|none|null|self|this|int|str|bool|float|list|dict|string|void|any)$'))"""

ORACLES = {
    "char_windows": """WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents WHERE length(text) > 0)
        SELECT doc_id, CAST(s // 800 AS INTEGER) AS chunk, CAST(s AS INTEGER) AS start, CAST(length(substring(text, s + 1, 1000)) AS INTEGER) AS chars, md5(substring(text, s + 1, 1000)) AS hash FROM w""",
    "line_windows": f"""WITH {FILES_SQL}, l AS (SELECT file_path, string_split(text, chr(10)) AS l FROM g WHERE length(text) > 0),
        w AS (SELECT file_path, l, unnest(list_filter(range(0, len(l), 40), lambda i: i = 0 OR i < len(l) - 16)) AS s FROM l)
        SELECT file_path, CAST(s // 40 AS INTEGER) AS chunk, CAST(s + 1 AS INTEGER) AS line_start, CAST(least(s + 56, len(l)) AS INTEGER) AS line_end, md5(array_to_string(l[s + 1 : s + 56], chr(10))) AS hash FROM w""",
    "section_split": """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(replace(text, chr(13), ''), chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence, sum(CAST(regexp_matches(line, '^\\s*(```|~~~)') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS n FROM l),
        s AS (SELECT *, CAST(sum(CASE WHEN (n - CAST(fence AS INTEGER)) % 2 = 0 AND regexp_matches(line, '^#{1,6}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section FROM f)
        SELECT doc_id, section, CASE WHEN section > 0 THEN trim(regexp_replace(arg_min(line, no), '^#{1,6}\\s+', '')) ELSE '' END AS title, CAST(min(no) AS INTEGER) AS line_start, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY doc_id, section""",
    "code_references": f"WITH {_REFS} SELECT doc_id, reference FROM f",
    "broken_references": f"WITH {_REFS} SELECT doc_id, reference FROM f WHERE string_split_regex(reference, '\\.|::')[-1] NOT IN (SELECT name FROM graph_nodes WHERE name <> '')",
    "version_strings": r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?(```|$)', ' ', 'g'), '\bv?(\d+\.\d+\.\d+)\b', 1)) AS version FROM documents""",
    "path_metadata": rf"""WITH {CHUNKS_SQL}, p AS (SELECT chunk_id, file_path, '/' || lower(replace(file_path, chr(92), '/')) AS p, replace(file_path, chr(92), '/') AS q, string_split_regex(coalesce(symbol_name, ''), '\.|::')[-1] AS bare FROM c)
        SELECT chunk_id, CASE WHEN regexp_matches(p, '/tests?/|/test_[^/]*$|_test\.[a-z]+$') THEN 'tests' WHEN regexp_matches(p, '/docs?/|\.(md|rst)$') THEN 'docs' WHEN contains(p, '/scripts/') THEN 'scripts' WHEN contains(p, '/mcp/tools/') THEN 'mcp_tools'
            WHEN contains(p, '/mcp/') THEN 'mcp' WHEN contains(p, '/core/') THEN 'core' WHEN regexp_matches(p, '/utils?/') THEN 'utils' ELSE 'root' END AS layer,
          regexp_extract(q, '([^/]*?)(?:\.[^./]*)?$', 1) AS module_name, NOT starts_with(bare, '_') AS is_public, md5(file_path) AS parent_id FROM p""",
    "exact_dups": """WITH h AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), g AS (SELECT text, min(doc_id) AS "group", count(*) AS copies FROM h GROUP BY text HAVING count(*) > 1)
        SELECT doc_id, "group", copies FROM h JOIN g USING (text)""",
    "near_dup_pairs": f"""WITH w AS (SELECT doc_id, list_filter({_SPLIT}, lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), u AS (SELECT min(doc_id) AS k, w FROM w WHERE len(w) > 0 GROUP BY w),
        s AS (SELECT DISTINCT k, unnest([array_to_string(w[i + 1 : i + 5], ' ') FOR i IN range(0, greatest(len(w) - 5, 0) + 1)]) AS x FROM u), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
        p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY ALL)
        SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE round(c / (x.n + y.n - c), 6) >= 0.8""",
    "contamination": f"""WITH w AS (SELECT doc_id, coalesce(starts_with(lower(source), 'glossary'), false) AS held, list_filter({_SPLIT}, lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, held, unnest([array_to_string(w[i + 1 : i + 8], ' ') FOR i IN range(0, greatest(len(w) - 8, 0) + 1)]) AS x FROM w WHERE len(w) > 0)
        SELECT a.doc_id, b.doc_id AS item_id, count(*) AS common FROM s a JOIN s b ON a.x = b.x WHERE NOT a.held AND b.held GROUP BY ALL""",
}


ORACLES["review_contamination"] = ORACLES["contamination"].replace("starts_with(lower(source), 'glossary')", r"regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') = 'review_comment'")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_EXT = r"lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1))"
_FILE_ANCHOR = r"\b([\w./-]+\.(?:py|js|ts|go|rs|java|md|toml|json|ya?ml|cfg|ini|sh))\b"

ORACLES |= {
    "imports_found": f"WITH {FILES_SQL}, x AS ("
    + " UNION ALL ".join(
        f"SELECT file_path AS path, unnest(list_concat(regexp_extract_all(text, {_quoted(p)}, 1), regexp_extract_all(text, {_quoted(p)}, 2))) AS import FROM g WHERE text IS NOT NULL AND {_EXT} = '{k}'" for k, p in ch.IMPORT_PATTERNS.items()
    )
    + ") SELECT DISTINCT path, import FROM x WHERE import <> ''",
    "symbols_found": f"WITH {FILES_SQL}, x AS ("
    + " UNION ALL ".join(f"SELECT file_path AS path, unnest(regexp_extract_all(text, {_quoted(p)}, 1)) AS symbol FROM g WHERE text IS NOT NULL AND {_EXT} = '{k}'" for k, p in ch.SYMBOL_PATTERNS.items())
    + ") SELECT DISTINCT path, symbol FROM x",
    "structural_counts": f"WITH {FILES_SQL}, x AS ("
    + " UNION ALL ".join(f"SELECT file_path AS path, '{k}' AS pattern, CAST(len(regexp_extract_all(text, {_quoted(p)})) AS INTEGER) AS n FROM g WHERE text IS NOT NULL" for k, p in ch.PATTERNS.items())
    + ") SELECT * FROM x WHERE n > 0",
    "chunk_summaries": f"""WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, trim(string_split(trim(coalesce(docstring, '')), chr(10))[1]) AS d, concat_ws(' ', lower(coalesce(symbol_kind, '')), nullif(symbol_name, '')) AS k, coalesce(symbol_name, '') AS nm,
          trim(string_split(coalesce(text, ''), chr(10))[1]) AS t FROM c) SELECT chunk_id, left(CASE WHEN d <> '' THEN d WHEN nm <> '' THEN k ELSE t END, 200) AS summary FROM s""",
    "anchor_verdicts": f"""WITH {FILES_SQL}, a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_quoted(_FILE_ANCHOR)}, 1)) AS anchor FROM documents WHERE text IS NOT NULL),
        p AS (SELECT file_path AS anchor FROM g UNION SELECT regexp_extract(file_path, '([^/\\\\]+)$', 1) FROM g), f AS (SELECT doc_id, count(*) FILTER (anchor IN (SELECT anchor FROM p)) AS found, count(*) AS anchors FROM a GROUP BY doc_id)
        SELECT *, CASE WHEN found = anchors THEN 'FOUND' WHEN found = 0 THEN 'NOT_FOUND' ELSE 'INCONCLUSIVE' END AS verdict FROM f""",
}
