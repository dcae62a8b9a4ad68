"""Text expressions: tokens, identifiers, token estimates, intent and complexity of queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits at anything that is no letter, digit or underscore of any script; empty tokens are kept.
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"

#: Synonyms by which a query is widened.
SYNONYMS = {
    "auth": ["authentication", "login", "authorize"],
    "login": ["auth", "signin", "authenticate"],
    "config": ["configuration", "settings", "options"],
    "error": ["exception", "failure", "bug"],
    "create": ["add", "insert", "new"],
    "delete": ["remove", "destroy", "clear"],
    "update": ["edit", "modify", "change"],
    "get": ["fetch", "retrieve", "read"],
    "find": ["search", "locate", "lookup"],
    "query": ["search", "request", "lookup"],
    "filter": ["where", "condition", "predicate"],
    "sort": ["order", "arrange", "rank"],
    "list": ["all", "enumerate", "collect"],
    "function": ["method", "fn", "def", "procedure"],
    "class": ["type", "struct", "object"],
    "import": ["include", "require", "using"],
    "export": ["expose", "publish", "re-export"],
    "callback": ["handler", "listener", "hook"],
    "event": ["signal", "notification", "trigger"],
    "stream": ["channel", "pipe", "queue"],
    "cache": ["buffer", "temporary", "memoize"],
    "pool": ["connection-pool", "reuse", "recycle"],
    "thread": ["goroutine", "task", "concurrent"],
    "database": ["db", "storage", "persistence"],
    "table": ["collection", "entity", "relation"],
    "schema": ["structure", "blueprint", "model"],
    "field": ["column", "property", "attribute"],
    "index": ["key", "lookup", "catalog"],
    "migrate": ["schema-change", "version", "evolve"],
    "serialize": ["marshal", "encode", "pack"],
    "parse": ["compile", "tokenize", "deserialize"],
    "request": ["http-call", "api-call", "invoke"],
    "response": ["reply", "result", "answer"],
    "socket": ["connection", "endpoint", "port"],
    "route": ["endpoint", "path", "url"],
    "middleware": ["interceptor", "filter", "plugin"],
    "render": ["display", "draw", "paint"],
    "click": ["press", "tap", "select"],
    "focus": ["highlight", "select", "active"],
}

#: Signals of what a query looks for.
CODE_SIGNALS = [
    r"\bdef\b", r"\bclass\b", r"\bfunc\b", r"\bfn\b", r"\bimport\b", r"\bfrom\b", r"\breturn\b", r"\basync\b", r"\bawait\b", r"\btype\b", r"\binterface\b", r"\bimpl\b",
    r"\benum\b", r"\bstruct\b", r"\bconst\b", r"\blet\b", r"\bvar\b", r"\bλ\b", r"\blambda\b", r"^def ", r"^class ", r"^async def ", r"::", r"->",
]
DOCS_SIGNALS = [
    r"\bdoc\b", r"\bdocs\b", r"\breadme\b", r"\bhelp\b", r"\bguide\b", r"\btutorial\b", r"\bexample\b", r"\busage\b", r"\binstall\b", r"\bhow to\b", r"\bwhat is\b",
    r"\.md$", r"\.rst$", r"readme", r"changelog", r"license",
]
ARCH_SIGNALS = [
    r"\barch\b", r"\barchitecture\b", r"\blayer\b", r"\bmodule\b", r"\bcomponent\b", r"\bdependency\b", r"\bcoupling\b", r"\bdiagram\b", r"\bflow\b", r"\bpattern\b",
    r"\bdesign\b", r"\bstructure\b",
]


def tokens(text: str | Column) -> Column:
    """Lower-case tokens of a text (R1); null gives null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(c), TOKEN_SPLIT)


def split_identifier(name: str | Column) -> Column:
    """Words of an identifier of any case style, then their lower-case forms where those differ."""
    c = F.col(name) if isinstance(name, str) else name
    spaced = F.regexp_replace(c, r"::|->|\.|_", " ")
    spaced = F.regexp_replace(spaced, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    lower = F.filter(words, lambda w: F.lower(w) != w)
    return F.array_join(F.concat(words, F.transform(lower, F.lower)), " ")


def token_estimate(text: str | Column) -> Column:
    """A quarter of the characters, one at least."""
    c = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def expand_query(query: str, most: int = 3) -> list[str]:
    """The query and variants with one word replaced by a synonym, at most ``most`` in all (R2)."""
    out = [query]
    options = [(w, s) for w in query.lower().split() for s in SYNONYMS.get(w, [])[: most - 1]]
    for word, synonym in options:
        variant = query.replace(word, synonym, 1)
        if variant not in out and len(out) < most:
            out.append(variant)
    return out


def intent(query: str | Column) -> Column:
    """``code``, ``docs`` or ``auto`` by the signals in a query."""
    q = F.lower(F.col(query) if isinstance(query, str) else query)

    def hits(signals: list[str]) -> Column:
        total = F.lit(0)
        for p in signals:
            total = total + F.coalesce(q.rlike(p), F.lit(False)).cast("int")
        return total

    code, docs, arch = hits(CODE_SIGNALS), hits(DOCS_SIGNALS), hits(ARCH_SIGNALS)
    return F.when((arch >= code) & (arch >= docs) & (arch >= 2), "docs").when(code > docs, "code").when(docs > code, "docs").otherwise("auto")


def complexity(query: str | Column) -> Column:
    """``simple`` for a name or two words, ``complex`` for questions over several things, else ``medium``."""
    q = F.trim(F.lower(F.col(query) if isinstance(query, str) else query))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    asks = q.rlike(r"^(how|why|what|where|which|when|explain|compare|describe)\b").cast("int")
    several = q.rlike(r"\b(and|or|versus|vs|between|then)\b|[,;]").cast("int")
    return F.when(words <= 2, "simple").when((words >= 8) | (asks + several >= 2), "complex").otherwise("medium")


def is_identifier(query: str | Column) -> Column:
    """One word in identifier style."""
    c = F.col(query) if isinstance(query, str) else query
    return F.trim(c).rlike(r"^[A-Za-z_][A-Za-z0-9_]{1,63}$")


def mentions(query: str | Column) -> tuple[Column, Column]:
    """(query without mentions, mentioned names) of "text @a @b" (P23)."""
    c = F.col(query) if isinstance(query, str) else query
    names = F.regexp_extract_all(c, F.lit(r"@([\w.-]+)"), 1)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"@[\w.-]+", " "), r"\s+", " ")), names


def decompose(query: str, most: int = 4) -> list[str]:
    """Sub-queries by rule: split at conjunctions and list marks, repeats dropped; the query itself if nothing splits."""
    parts = [p.strip(" ?.,;") for p in re.split(r"\s+(?:and|or|then|versus|vs\.?)\s+|[;,]\s+|\?\s+", query)]
    parts = [p for p in dict.fromkeys(parts) if len(p) > 2]
    return parts[:most] if len(parts) > 1 else [query]


#: Words that say nothing about a text.
STOP_WORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from as into through during before after above below between out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just because but and or if while return def class import from self none true false pass that this it its what which who whom".split()
)


def key_terms(text: str | Column) -> Column:
    """Identifier-like words of four letters or more that are no stop words."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9]*(?:_[a-z0-9]+)*)"), 1)
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
