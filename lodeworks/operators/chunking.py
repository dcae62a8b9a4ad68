"""Text and source files to rows: chunkers, extractors, metadata."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_windows(docs: DataFrame, key: str, text: str, size: int = 56, overlap: int = 16) -> DataFrame:
    """(key, chunk, line_start, line_end, text): windows of lines; the last reaches the end."""
    step = size - overlap
    lines = docs.where(F.length(text) > 0).select(key, F.split(text, "\n").alias("l"))
    starts = F.expr(f"filter(sequence(0, size(l) - 1, {step}), i -> i = 0 or i < size(l) - {overlap})")
    at = lines.select(key, "l", F.posexplode(starts).alias("chunk", "i"))
    end = F.least(F.col("i") + size, F.size("l"))
    return at.select(key, "chunk", (F.col("i") + 1).alias("line_start"), end.alias("line_end"), F.array_join(F.slice("l", F.col("i") + 1, F.lit(size)), "\n").alias("text"))


def char_windows(docs: DataFrame, key: str, text: str, width: int = 1000, step: int = 800) -> DataFrame:
    """(key, chunk, start, text): windows of characters."""
    at = docs.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.posexplode(F.expr(f"sequence(0, length({text}) - 1, {step})")).alias("chunk", "start"))
    return at.select(key, "chunk", "start", F.substring("_t", F.col("start") + 1, F.lit(width)).alias("text"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, title, line_start, lines, chars): Markdown split at headings outside fences.

    Lines stay inside the row: running sums go over the array, so documents are not shuffled by line.
    """
    lines = docs.where(F.col(text).isNotNull()).select(key, F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n").alias("l"))
    # state: (in fence, number of headings so far, section of each line)
    walk = F.expr(r"""aggregate(l, named_struct('fence', false, 'n', 0, 'at', cast(array() as array<int>)),
        (s, x) -> named_struct(
            'fence', if(x rlike '^\\s*(```|~~~)', not s.fence, s.fence),
            'n', s.n + if(not s.fence and x rlike '^#{1,6}\\s', 1, 0),
            'at', concat(s.at, array(s.n + if(not s.fence and x rlike '^#{1,6}\\s', 1, 0)))),
        s -> s.at)""")
    rows = lines.select(key, F.explode(F.arrays_zip(F.col("l").alias("line"), walk.alias("section"), F.sequence(F.lit(1), F.size("l")).alias("no"))).alias("z")).select(key, "z.line", "z.section", "z.no")
    title = F.trim(F.regexp_replace(F.min_by("line", "no"), r"^#{1,6}\s+", ""))
    return rows.groupBy(key, "section").agg(
        F.when(F.col("section") > 0, title).alias("title"), F.min("no").alias("line_start"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")
    )


def notebook_cells(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, cell, kind, text) of notebooks; broken JSON gives none."""
    schema = "cells array<struct<cell_type:string,source:array<string>>>"
    cells = files.select(key, F.posexplode(F.from_json(content, schema)["cells"]).alias("cell", "c"))
    return cells.select(key, "cell", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("text"))


def layer_of(path: str | Column) -> Column:
    """Layer by the parts of a path."""
    p = F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/")))
    p = F.concat(F.lit("/"), p)
    out = F.when(p.rlike(r"/tests?/|/test_[^/]*$|_test\.[a-z]+$"), "tests").when(p.rlike(r"/docs?/|\.(md|rst)$"), "docs").when(p.rlike("/scripts/"), "scripts")
    return out.when(p.rlike("/mcp/tools/"), "mcp_tools").when(p.rlike("/mcp/"), "mcp").when(p.rlike("/core/"), "core").when(p.rlike("/utils?/"), "utils").otherwise("root")


def module_of(path: str | Column) -> Column:
    """File name without extension."""
    p = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    return F.regexp_extract(p, r"([^/]*?)(?:\.[^./]*)?$", 1)


def chunk_metadata(chunks: DataFrame, path: str, name: str) -> DataFrame:
    """Adds layer, module_name, is_public and parent_id, the md5 of the path."""
    bare = F.element_at(F.split(F.coalesce(name, F.lit("")), r"\.|::"), -1)
    return chunks.withColumns({"layer": layer_of(path), "module_name": module_of(path), "is_public": ~F.startswith(bare, F.lit("_")), "parent_id": F.md5(path)})


# ---- Python sources by syntax tree --------------------------------------------


def _callee(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts)) or None


class _Facts(ast.NodeVisitor):
    """Definitions, calls, assignments, imports, decorators and overrides of one module."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str | None, int, int, str | None]] = []
        self.scope: list[str] = []
        self.conditions: list[str] = []
        self.bases: dict[str, list[str]] = {}
        self.methods: dict[str, set[str]] = {}

    def here(self) -> str:
        return ".".join(self.scope)

    def add(self, fact: str, name: str, target: str | None, node: ast.AST) -> None:
        self.rows.append((fact, name, target, node.lineno, getattr(node, "end_lineno", node.lineno), " and ".join(self.conditions) or None))

    def _define(self, node, kind: str) -> None:
        name = ".".join([*self.scope, node.name])
        self.add("define", name, kind, node)
        for d in node.decorator_list:
            called = _callee(d.func if isinstance(d, ast.Call) else d)
            if called:
                self.add("decorate", name, called, d)
        self.scope.append(node.name)
        saved, self.conditions = self.conditions, []
        for child in node.body:
            self.visit(child)
        self.conditions = saved
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        inside = self.scope and self.here() in self.methods
        if inside:
            self.methods[self.here()].add(node.name)
        self._define(node, "method" if inside else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        name = ".".join([*self.scope, node.name])
        self.methods[name] = set()
        self.bases[name] = [b for b in map(_callee, node.bases) if b]
        self._define(node, "class")

    def visit_If(self, node) -> None:
        self.visit(node.test)
        test = ast.unparse(node.test)
        for part, text in ((node.body, test), (node.orelse, f"not ({test})")):
            self.conditions.append(text)
            for child in part:
                self.visit(child)
            self.conditions.pop()

    def visit_Call(self, node) -> None:
        name = _callee(node.func)
        if name:
            self.add("call", self.here(), name, node)
        self.generic_visit(node)

    def _assign(self, targets: list[ast.AST], value: ast.AST | None, node: ast.AST) -> None:
        if value is not None:
            sources = sorted({n.id for n in ast.walk(value) if isinstance(n, ast.Name)})
            for t in targets:
                for leaf in ast.walk(t):
                    if isinstance(leaf, ast.Name):
                        for s in sources or [None]:
                            self.add("assign", ".".join([*self.scope, leaf.id]), s, node)
        self.generic_visit(node)

    def visit_Assign(self, node) -> None:
        self._assign(node.targets, node.value, node)

    def visit_AnnAssign(self, node) -> None:
        self._assign([node.target], node.value, node)

    def visit_AugAssign(self, node) -> None:
        self._assign([node.target], node.value, node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, a.name, node)

    def visit_ImportFrom(self, node) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", a.asname or a.name, f"{base}.{a.name}".replace("..", ".") if base.strip(".") else f"{base}{a.name}", node)

    def overrides(self) -> None:
        for cls, bases in self.bases.items():
            for base in bases:
                for m in sorted(self.methods[cls] & self.methods.get(base, set())):
                    self.rows.append(("override", f"{cls}.{m}", f"{base}.{m}", 0, 0, None))


def python_facts(text: str | None) -> list[tuple[str, str, str | None, int, int, str | None]]:
    """(fact, name, target, line_start, line_end, condition); none for text that does not parse."""
    if not text:
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    v = _Facts()
    v.visit(tree)
    v.overrides()
    return v.rows


def code_facts(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, fact, name, target, line_start, line_end, condition) of Python files.

    Facts: define, call, assign, import, decorate, override.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in python_facts(t)]
            yield pd.DataFrame(rows, columns=["path", "fact", "name", "target", "line_start", "line_end", "condition"])

    own = files.where(F.col(path).rlike(r"(?i)\.pyi?$") & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    return own.mapInPandas(run, "path string, fact string, name string, target string, line_start int, line_end int, condition string")


def python_chunks(files: DataFrame, path: str, text: str, body_lines: int = 3) -> DataFrame:
    """(path, name, kind, line_start, line_end, compact, full): one chunk per function or class; compact is the head and the first lines of the body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                lines = (t or "").split("\n")
                for fact, name, kind, a, b, _ in python_facts(t):
                    if fact == "define":
                        rows.append((p, name, kind, a, b, "\n".join(lines[a - 1 : min(b, a + body_lines)]), "\n".join(lines[a - 1 : b])))
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line_start", "line_end", "compact", "full"])

    own = files.where(F.col(path).rlike(r"(?i)\.pyi?$") & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    return own.mapInPandas(run, "path string, name string, kind string, line_start int, line_end int, compact string, full string")


# ---- extraction by pattern -----------------------------------------------------

IMPORT_PATTERNS = {
    "py": r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))",
    "js": r"""(?m)(?:\bfrom[ \t]+|\bimport[ \t]+|\brequire\([ \t]*)['"]([^'"\n]+)['"]()""",
    "ts": r"""(?m)(?:\bfrom[ \t]+|\bimport[ \t]+|\brequire\([ \t]*)['"]([^'"\n]+)['"]()""",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)()",
    "go": r'(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([\w./-]+)"()[ \t\r]*$',
    "rs": r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)()",
}
SYMBOL_PATTERNS = {
    "py": r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)",
    "js": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function|class)[ \t]+(\w+)",
    "ts": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function|class|interface|type|enum)[ \t]+(\w+)",
    "java": r"(?m)^[ \t]*(?:public[ \t]+|final[ \t]+|abstract[ \t]+)*(?:class|interface|enum|record)[ \t]+(\w+)",
    "go": r"(?m)^(?:func(?:[ \t]*\([^)\n]*\))?|type)[ \t]+(\w+)",
    "rs": r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?[ \t]+)?(?:fn|struct|enum|trait|mod)[ \t]+(\w+)",
}


def suffix(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def imports_by_pattern(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, import) distinct, in any language of IMPORT_PATTERNS."""
    out = None
    for ext, p in IMPORT_PATTERNS.items():
        own = files.where(suffix(path) == ext)
        found = F.concat(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)))
        part = own.select(F.col(path).alias("path"), F.explode(F.filter(found, lambda x: x != "")).alias("import"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def symbols_by_pattern(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, symbol) distinct."""
    out = None
    for ext, p in SYMBOL_PATTERNS.items():
        part = files.where(suffix(path) == ext).select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("symbol"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def symbol_and_docstring(text: str | Column) -> tuple[Column, Column]:
    """First defined name and first docstring of a chunk's text, or '' (P14)."""
    c = F.col(text) if isinstance(text, str) else text
    name = F.regexp_extract(c, r"(?:def|class|function|func|fn|interface|struct|enum|trait)[ \t]+(?:\([^)\n]*\)[ \t]*)?([A-Za-z_]\w*)", 1)
    triple = F.regexp_extract(c, r'(?s)"""(.*?)"""', 1)
    block = F.regexp_extract(c, r"(?s)/\*\*(.*?)\*/", 1)
    return name, F.trim(F.when(triple != "", triple).otherwise(block))


def without_fences(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, r"(?s)(```|~~~).*?(\1|$)", " ")


def code_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reference): names in backticks that look like code."""
    raw = F.explode(F.regexp_extract_all(without_fences(text), F.lit(r"`([^`\n]+)`"), F.lit(1))).alias("reference")
    refs = docs.select(key, raw).withColumn("reference", F.regexp_replace("reference", r"\(.*\)$", ""))
    fine = F.col("reference").rlike(r"^[A-Za-z_][\w]*(?:(?:\.|::)[A-Za-z_]\w*)*$") & (F.length("reference") >= 3) & ~F.col("reference").rlike(r"(?i)^(true|false|none|null|self|this|int|str|bool|float|list|dict|string|void|any)$")
    return refs.where(fine).distinct()


def versions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, version) outside fences."""
    return docs.select(key, F.explode(F.regexp_extract_all(without_fences(text), F.lit(r"\bv?(\d+\.\d+\.\d+)\b"), F.lit(1))).alias("version")).distinct()


def claim_anchors(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, anchor): files, imports, environment keys and packages a note relies on (P20)."""
    kinds = {
        "file": r"\b([\w./-]+\.(?:py|js|ts|go|rs|java|md|toml|json|ya?ml|cfg|ini|sh))\b",
        "import": r"\b(?:import|from)\s+([A-Za-z_][\w.]*)",
        "env": r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b",
        "package": r"\b(?:pip install|npm install|cargo add|go get)\s+([A-Za-z0-9_.@/-]+)",
    }

    def of(kind: str):
        return lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor"))

    parts = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), of(k)) for k, p in kinds.items()]
    return notes.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*parts)).alias("a")).select(key, "a.kind", "a.anchor").distinct()


def fingerprint(files: DataFrame, path: str, text: str) -> DataFrame:
    """(kind, anchor) of what a code base holds: files, imports, environment keys."""
    own = files.select(F.lit("file").alias("kind"), F.col(path).alias("anchor"))
    short = files.select(F.lit("file").alias("kind"), F.regexp_extract(path, r"([^/\\]+)$", 1).alias("anchor"))
    imported = imports_by_pattern(files, path, text).select(F.lit("import").alias("kind"), F.col("import").alias("anchor"))
    env = files.select(F.lit("env").alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"), F.lit(1))).alias("anchor"))
    return own.union(short).union(imported).union(env).distinct()


def packages(manifests: DataFrame, path: str, text: str) -> DataFrame:
    """(path, package): requirements files line by line, project tables by their quoted entries."""
    lines = manifests.where(F.col(path).rlike(r"requirements[\w.-]*\.txt$")).select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*([A-Za-z0-9][\w.-]*)"), F.lit(1))).alias("package"))
    quoted = manifests.where(F.endswith(path, F.lit("pyproject.toml"))).select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*[\"']([A-Za-z0-9][\w.-]*)[^\"'\n]*[\"'],?[ \t]*$"), F.lit(1))).alias("package"))
    return lines.unionByName(quoted).withColumn("package", F.lower("package")).distinct()


def summaries(chunks: DataFrame, name: str, kind: str, docstring: str, text: str) -> Column:
    """One line about a chunk: first line of its docstring, else kind and name, else its first line."""
    first = F.trim(F.element_at(F.split(F.trim(F.coalesce(docstring, F.lit(""))), "\n"), 1))
    named = F.concat_ws(" ", F.lower(F.coalesce(kind, F.lit(""))), F.nullif(F.col(name), F.lit("")))
    return F.left(F.when(first != "", first).when(F.coalesce(name, F.lit("")) != "", named).otherwise(F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), "\n"), 1))), F.lit(200))


#: Signs of instructions hidden in text, by category.
INSTRUCTION_PATTERNS = {
    "role_hijack": [
        r"ignore (all )?(previous|prior|earlier) (instructions|commands|prompts|rules)",
        r"disregard (all )?(previous|prior|earlier) (instructions|commands|rules)",
        r"you are (now )?(an? )?(ai|assistant|agent|coder|expert)[^\n]{0,40}(without|that must)",
        r"act as (if you were|an? )?(an? )?(ai|assistant|agent|shell)",
        r"system prompt",
    ],
    "imperative": [
        r"^run (the )?(following )?(command|script|code)",
        r"^execute (the |this )?(following |script |command)",
        r"^do not (tell|mention|reveal|say|inform|report)",
        r"^never (tell|mention|reveal|say|inform)",
        r"^delete (the )?(file|files|directory|repo)",
        r"^remove (the )?(file|files)",
        r"^send (the )?(content|file|data|token)",
        r"^exfiltrate",
    ],
    "shell": [r"\brm -rf\b", r"\bcurl (http|ftp)", r"\bwget (http|ftp)", r"\bsudo \w+", r"\bchmod 777\b", r"\bgit clone (http|ftp|ssh)", r"\b(powershell|cmd\.exe|bash -c)\b"],
    "secrets": [
        r"api[_-]?key\s*=\s*['\"][A-Za-z0-9]{16,}",
        r"password\s*=\s*['\"][^'\"]{8,}",
        r"token\s*=\s*['\"][A-Za-z0-9._-]{16,}",
        r"secret\s*=\s*['\"][A-Za-z0-9]{16,}",
    ],
}


def instruction_risks(text: str | Column) -> Column:
    """Categories of hidden instructions in a text, over the whole of it."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    flags = [F.when(c.rlike("(?im)(?:" + "|".join(ps) + ")"), k) for k, ps in INSTRUCTION_PATTERNS.items()]
    return F.array_compact(F.array(*flags))


def symbol_hashes(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, symbol, line, hash): sha-256 of each Python definition up to the next line of no deeper indent.

    The search for that line stays inside the row, over the array of lines.
    """
    lines = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n").alias("l"))
    at = lines.select("path", "l", F.posexplode("l").alias("i", "x")).where(F.col("x").rlike(r"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+\w+"))
    at = at.withColumn("indent", F.length(F.regexp_extract("x", r"^([ \t]*)", 1))).withColumn("symbol", F.regexp_extract("x", r"(?:def|class)[ \t]+(\w+)", 1))
    rest = F.expr("slice(l, i + 2, greatest(size(l) - i - 1, 0))")
    stop = F.expr(r"array_position(transform(rest, y -> length(trim(y)) > 0 and length(regexp_extract(y, '^([ \\t]*)', 1)) <= indent), true)")
    at = at.withColumn("rest", rest).withColumn("n", stop)
    body = F.expr("concat(array(x), if(n > 0, slice(rest, 1, cast(n as int) - 1), rest))")
    return at.select("path", "symbol", (F.col("i") + 1).alias("line"), F.sha2(F.rtrim(F.array_join(body, "\n")), 256).alias("hash"))


PATTERNS = {
    "async_function": r"(?m)^[ \t]*async[ \t]+(?:def|function|fn)\b",
    "bare_except": r"(?m)^[ \t]*except[ \t]*:",
    "broad_except": r"(?m)^[ \t]*except[ \t]+(?:Base)?Exception\b",
    "class": r"(?m)^[ \t]*(?:export[ \t]+|public[ \t]+|abstract[ \t]+|final[ \t]+)*class[ \t]+\w+",
    "comprehension": r"[\[({][^\[\](){}\n]+\bfor\b[^\[\](){}\n]+\bin\b[^\[\](){}\n]+[\])}]",
    "decorated": r"(?m)^[ \t]*@\w[\w.]*(?:\([^)\n]*\))?[ \t\r]*\n[ \t]*(?:async[ \t]+)?(?:def|class)\b",
    "function": r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|func|fn|function)[ \t]+\w+",
    "global": r"(?m)^[ \t]*(?:global|nonlocal)[ \t]+\w+",
    "lambda": r"\blambda\b[^:\n]*:|=>",
    "print": r"\b(?:print|println!|console\.log|fmt\.Print\w*|System\.out\.print\w*)\(",
    "raise": r"(?m)^[ \t]*(?:raise|throw)\b",
    "todo": r"\b(?:TODO|FIXME|XXX)\b",
    "with": r"(?m)^[ \t]*(?:async[ \t]+)?with\b[^\n]*:",
}


def structural_counts(files: DataFrame, path: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(path, pattern, n) of named structural patterns, or own ones, that occur."""
    ps = patterns or PATTERNS
    counts = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for k, p in ps.items()])
    return files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.explode(counts).alias("c")).select("path", "c.pattern", "c.n").where("n > 0")


def rerank_scores(replies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, score) from replies of a scoring model.

    JSON objects with index and score are read wherever they stand; scores are clamped to 0..1; null, negative
    and fractional indexes are left out; a reply that scores one index twice gives nothing.
    """
    found = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    rows = replies.select(key, F.explode(found).alias("j")).select(key, F.get_json_object("j", "$.index").try_cast("double").alias("i"), F.get_json_object("j", "$.score").try_cast("double").alias("s"))
    fine = rows.where("i is not null and s is not null and not isnan(s) and abs(s) < double('infinity') and i >= 0 and i = floor(i)")
    twice = fine.groupBy(key, "i").count().where("count > 1").select(key).distinct()
    return fine.join(twice, key, "left_anti").select(key, F.col("i").cast("int").alias("index"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))).alias("score"))


def code_health(files: DataFrame, path: str, text: str, churn: DataFrame | None = None, partners: DataFrame | None = None) -> DataFrame:
    """(path, lines, complexity, depth, bare_excepts, score, band).

    churn: (path, commits); partners: (path, partners); both optional. Each of six marks takes off a bounded amount of ten.
    """
    words = ["if ", "elif ", "else:", "for ", "while ", "and ", "or ", "except", "finally:", "with ", "assert ", "case ", "match "]
    c = F.lit(1)
    for w in words:
        c = c + F.regexp_count(F.col(text), F.lit(w))
    ls = F.split(text, "\n")
    depth = F.coalesce(F.array_max(F.transform(ls, lambda x: F.when((F.trim(x) != "") & ~x.rlike(r"^\s*(#|//|/\*|\*|'''|\"\"\")"), F.floor((F.length(x) - F.length(F.ltrim(x))) / 4)).otherwise(0))), F.lit(0))
    lines = F.size(ls) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)
    bare = F.regexp_count(F.col(text), F.lit(r"except\s*:\s*\n\s*(pass|\.\.\.)")) + F.regexp_count(F.col(text), F.lit(r"except\s+Exception\s*:\s*\n\s*(pass|\.\.\.)"))
    m = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), lines.alias("lines"), c.alias("complexity"), depth.cast("int").alias("depth"), bare.alias("bare_excepts"))
    m = m.join(churn.select("path", "commits"), "path", "left") if churn is not None else m.withColumn("commits", F.lit(0))
    m = m.join(partners.select("path", "partners"), "path", "left") if partners is not None else m.withColumn("partners", F.lit(0))
    m = m.fillna(0, ["commits", "partners"])

    def off(cond: Column, amount: Column, cap: float) -> Column:
        return F.when(cond, F.least(F.lit(cap), amount)).otherwise(0.0)

    total = (
        off(F.col("lines") > 500, (F.col("lines") - 500) / 1000 * 1.5, 1.5) + off(F.col("complexity") > 15, (F.col("complexity") - 15) / 30 * 1.5, 1.5) + off(F.col("depth") >= 4, (F.col("depth") - 3) * 0.5, 1.5)
        + off(F.col("commits") >= 5, F.col("commits") / 20 * 2.0, 2.0) + off(F.col("partners") >= 5, F.col("partners") / 15 * 2.0, 2.0) + off(F.col("bare_excepts") > 0, F.col("bare_excepts") * 0.1, 0.5)
    )
    score = F.round(F.greatest(F.lit(1.0), 10.0 - total), 1)
    return m.withColumn("score", score).withColumn("band", F.when(F.col("score") >= 8.0, "healthy").when(F.col("score") >= 4.0, "warning").otherwise("alert")).drop("commits", "partners")


def live_slice(files: DataFrame, path: str, text: str, wanted: DataFrame) -> DataFrame:
    """(path, line, text): lines start..end of wanted (path, start, end) ranges."""
    own = files.select(F.col(path).alias("path"), F.col(text).alias("_t")).join(wanted, "path")
    return own.select("path", "start", "end", F.posexplode(F.split("_t", "\n")).alias("i", "text")).where("i + 1 between start and end").select("path", (F.col("i") + 1).alias("line"), "text")


def running_section(lines: DataFrame, key: str, order: str, is_fence: Column, is_heading: Column) -> DataFrame:
    """Section number of lines that are rows already: fence parity and headings as running sums."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    fenced = lines.withColumn("_f", F.sum(is_fence.cast("int")).over(w) % 2)
    return fenced.withColumn("section", F.sum((is_heading & (F.col("_f") == 0)).cast("int")).over(w)).drop("_f")
