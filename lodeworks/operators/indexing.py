"""Keeping an index in step with the files: guards, upserts, pruning, drift, retention, schema changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.common import remove_path
from lodeworks.operators.inverted import InvertedIndex

MAX_FILE = 1 << 20
SAFE_SHARE = 0.5
#: Folders that hold no sources, and extensions that are indexed.
SYSTEM_DIRS = [".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".idea", ".vscode", "target"]
EXTENSIONS = ["py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "c", "h", "cpp", "hpp", "cs", "rb", "php", "md", "rst", "txt", "json", "toml", "yaml", "yml", "ipynb"]


def safe_to_index(path: str, length: str) -> Column:
    """Files by extension, folder, name and size."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    ext = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    folder = "|".join(re.escape(d) for d in SYSTEM_DIRS)
    return ext.isin(EXTENSIONS) & ~p.rlike(r"\.min\.[a-z]+$") & ~p.rlike(rf"(?:^|/)(?:{folder})/") & (F.col(length) <= MAX_FILE)


def looks_binary(content: str) -> Column:
    """A zero byte among the first 1024, or a first line of over 500 characters (S3). content: BINARY."""
    head = F.substring(content, 1, 1024)
    zero = F.contains(F.hex(head), F.lit("00")) & F.regexp_like(F.hex(head), F.lit("^(?:..)*00"))
    line = F.element_at(F.split(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\n"), 1)
    return zero | (F.length(line) > 500)


def gitignore_regex(pattern: str) -> str | None:
    """Regular expression of one ignore pattern over paths with forward slashes; comments and blank lines give None."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out = ""
    i = 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: str, patterns: list[str]) -> Column:
    regexes = [r for r in map(gitignore_regex, patterns) if r]
    return F.col(path).rlike("|".join(f"(?:{r})" for r in regexes)) if regexes else F.lit(False)


#: Upper half of Latin-1 and what Windows-1251 has there; 0x98 is not defined and left out.
_UPPER = bytes(b for b in range(0x80, 0x100) if b != 0x98)
_WINDOWS_1251 = (_UPPER.decode("latin-1"), _UPPER.decode("cp1251"))


def decoded(content: str) -> Column:
    """Text of bytes: by byte order mark, else UTF-8, else Windows-1251 where it has Cyrillic letters, else Latin-1."""
    c = F.col(content)
    h = F.hex(F.substring(c, 1, 3))
    utf8 = F.try_validate_utf8(c.cast("string"))
    latin = F.decode(c, "ISO-8859-1")
    cyr = F.translate(latin, *_WINDOWS_1251)
    return (
        F.when(h == "EFBBBF", F.expr(f"decode(substring({content}, 4), 'UTF-8')"))
        .when(F.startswith(h, F.lit("FFFE")), F.decode(c, "UTF-16"))
        .when(F.startswith(h, F.lit("FEFF")), F.decode(c, "UTF-16"))
        .when(utf8.isNotNull(), utf8)
        .when(cyr.rlike(r"[А-Яа-яЁё]{2}"), cyr)
        .otherwise(latin)
    )


def has_code(text: str | Column) -> Column:
    """Whether any line is neither blank nor a comment."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.exists(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#|//|/\*|\*|--|\"\"\"|''')")), F.lit(False))


def content_hash(text: str | Column) -> Column:
    """The one hash of a text that every component compares."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def changed_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files (file_path, file_hash, ...) whose hash the index does not hold."""
    return files.join(index.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti")


def upsert_by_file(index: DataFrame, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The index with all rows of the given files replaced (S13, S14, Z17). keys: (file_path), by default those of ``rows``."""
    files = (rows if keys is None else keys).select("file_path").distinct()
    return index.join(files, "file_path", "left_anti").unionByName(rows, allowMissingColumns=True)


def prune(index: DataFrame, disk: DataFrame, safe_share: float = SAFE_SHARE) -> DataFrame:
    """The index without files that are gone from disk (S15, U2); refuses if more than ``safe_share`` of its files would go."""
    files = index.select("file_path").distinct()
    row = files.join(disk.select("file_path").distinct().withColumn("d", F.lit(1)), "file_path", "left").agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("gone")).first()
    if row["n"] and row["gone"] / row["n"] > safe_share:
        raise ValueError(f"{row['gone']} of {row['n']} files would be pruned; refusing")
    return index.join(disk.select("file_path").distinct(), "file_path", "left_semi")


def clean_path(path: str | Column) -> Column:
    """A path with forward slashes and without a leading ``./``."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def moved(index: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows of moved files under their new path, with the module and layer that follow from it; all else stays.

    moves: (old_path, new_path). Paths are compared with forward slashes and without a leading ``./``;
    new paths come out in that form. Of several moves of one file the smallest new path counts.
    """
    from lodeworks.operators.chunking import layer_of, module_of

    to = moves.where("old_path is not null and new_path is not null").groupBy(clean_path("old_path").alias("_old")).agg(F.min(clean_path("new_path")).alias("_new"))
    at = index.join(to, clean_path("file_path") == F.col("_old"), "left")
    hit = F.col("_new").isNotNull()
    made = {"file_path": F.col("_new"), "module_name": module_of(F.col("_new")), "layer": layer_of(F.col("_new"))}
    return at.select(*[F.when(hit, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in index.columns])


def without_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index without the rows of the given files (S16). files: (file_path)."""
    return index.join(files.select("file_path").distinct(), "file_path", "left_anti")


def apply_file_moves(chunks: DataFrame, nodes: DataFrame, full_text: InvertedIndex | None, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves files in every layer: chunk rows, graph nodes, and the stored full-text index where one is given.

    Returns the moved chunks and nodes; rows of the full-text index are replaced under their keys, so no text is embedded again.
    """
    if full_text is not None:
        rows = full_text.docs()
        after = moved(rows, moves)
        changed = after.join(rows.select(full_text.key, F.col("file_path").alias("_before")), full_text.key).where(~F.col("file_path").eqNullSafe(F.col("_before"))).drop("_before")
        full_text.add(changed)
    return moved(chunks, moves), moved(nodes, moves)


def drift(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(file_path, state): missing, orphan, stale or fresh, comparing the same hash (J19, Z13). Both: (file_path, file_hash), one row per file."""
    d = disk.select("file_path", F.col("file_hash").alias("dh"), F.lit(True).alias("on_disk"))
    i = index.select("file_path", F.col("file_hash").alias("ih"), F.lit(True).alias("indexed"))
    state = F.when(F.col("indexed").isNull(), "missing").when(F.col("on_disk").isNull(), "orphan").when(F.col("dh").eqNullSafe(F.col("ih")), "fresh").otherwise("stale")
    return d.join(i, "file_path", "full").select("file_path", state.alias("state"))


def staleness(index: DataFrame, indexed_us: Column, as_of_us: int) -> DataFrame:
    """One row: seconds since the latest indexing and a band."""
    out = index.agg(F.max(indexed_us).alias("m")).select(((F.lit(as_of_us) - F.col("m")) / 1e6).alias("age"))
    return out.withColumn("band", F.when(F.col("age").isNull(), "empty").when(F.col("age") > 3600, "old").when(F.col("age") > 600, "aging").otherwise("fresh"))


def retained(artifacts: DataFrame, kind: str, ts: str, as_of: str, days: dict[str, int]) -> DataFrame:
    """Artifacts young enough for their kind; kinds without a limit stay."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for p in days.items() for x in p]), F.col(kind))
    return artifacts.where(limit.isNull() | (F.datediff(F.lit(as_of).cast("timestamp"), F.col(ts)) <= limit))


def with_schema(df: DataFrame, wanted: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The frame with exactly the wanted columns; missing ones get their default or null."""
    defaults = defaults or {}
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def schema_problems(df: DataFrame, wanted: T.StructType) -> list[str]:
    """What the frame lacks."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"{f.name} is missing" if f.name not in have else f"{f.name} is {have[f.name].simpleString()}" for f in wanted.fields if have.get(f.name) != f.dataType]


def swap_table(df: DataFrame, base: str) -> str:
    """Writes a new version beside the old ones and points to it last, so a failed write leaves the old table in place.

    Returns the version's folder. Readers use :func:`current_table`.
    """
    spark = df.sparkSession
    known = _versions(spark, base)
    at = f"{base}/v{(max(known) if known else 0) + 1:06d}"
    df.write.parquet(at)
    return at


def _versions(spark, base: str) -> list[int]:
    """Versions whose write is complete: they bear the committer's mark."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if re.fullmatch(r"v\d{6}", name) and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def current_table(spark, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/v{max(_versions(spark, base)):06d}")


def drop_old_versions(spark, base: str, keep: int = 2) -> None:
    for v in _versions(spark, base)[:-keep]:
        remove_path(spark, f"{base}/v{v:06d}")


def health_rollup(checks: DataFrame) -> DataFrame:
    """One row over (component, severity, message): the worst severity decides."""
    out = checks.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("checks"))
    return out.withColumn("state", F.when(F.col("critical") > 0, "critical").when(F.col("warnings") > 0, "degraded").otherwise("healthy"))


def time_range(rows: DataFrame, us: Column, since_us: int | None = None, before_us: int | None = None) -> DataFrame:
    """Rows within inclusive bounds; rows without time are out (F16)."""
    out = rows.where(us.isNotNull())
    if since_us is not None:
        out = out.where(us >= since_us)
    return out if before_us is None else out.where(us <= before_us)
