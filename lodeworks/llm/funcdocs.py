"""Functions paired with their documentation: code-description pairs from index rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.codeparse import functions, language_of

MIN_WORDS = 5
MIN_CJK = 10

_FENCE = re.compile(r"^\s*[rRbBuU]{0,2}(\"\"\"|''')|(\"\"\"|''')\s*$")
_MARK = re.compile(r"^\s*(?:/\*+!?|\*/|\*(?!\*)|//[/!]*|#(?=#*\s|[^!\[\w]|$)|--)[ \t]?")
_TAG = re.compile(r"^\s*(?:[@\\]\w+|:\w+[^:]*:|\{@\w+\})")
_SECTION = re.compile(
    r"^\s*(?:#{1,4}\s*)?(?:args?|arguments|param(?:eter)?s?|returns?|raises?|throws?|yields?|errors?|panics|safety|examples?|attributes|keyword args|see also|notes?|warnings?|todo)\s*:?\s*$",
    re.I,
)
_INLINE_SECTION = re.compile(r"^\s*(?:args?|arguments|parameters|params|returns|raises|throws|yields)\s*:\s*\S", re.I)
#: Markers of open tasks. Lower case counts only with a bracket or colon: "todo" is a word of Spanish and Portuguese.
_TODO = re.compile(r"(?:^|(?<=[\s.!?。！？;,(]))(?:(?:TODO|FIXME|XXX|TBD|WIP|HACK)\b|(?:todo|fixme|xxx|tbd|wip|hack)\s*[(:]|^(?:[Pp]laceholder|PLACEHOLDER|Todo|Fixme)\b)")
#: Beginnings of notes that only tools read.
_TOOL = re.compile(
    r"^\s*(?:noqa|nolint|nosec|noinspection|type:\s*ignore|pylint\s*:|pyright\s*:|mypy\s*:|flake8\s*:|ruff\s*:|isort\s*:|fmt\s*:|yapf\s*:|pragma\b|coverage\s*:|eslint\b|tslint\b|jshint\b|jslint\b|prettier-ignore|istanbul\b|c8\b|@ts-|ts-(?:ignore|nocheck|expect-error)|webpack\w*\s*:|sourcemappingurl|#\s*(?:end)?region\b|(?-i:(?:end)?region)(?:\s+[\w-]+){0,2}\s*$|go:\w+|\+build\b|clippy\b|rustfmt\b|checkstyle\b|nopmd\b|spotbugs\b|sonar\b|@?suppress(?:warnings?|lint|message)?\s*[:(\[\"]|suppresswarnings\b|suppress[-_]\w+\s*$|suppress\s+(?:checkstyle|cpd|pmd|lint)\s*$|language=|-\*-|vim?:|generated (?:by|from|with|using)\b|code generated\b|machine generated\b|output of `|this (?:file|code) (?:was|is) (?:automatically )?generated\b|auto-?generated\b|do not (?:edit|modify)\b)",
    re.I,
)
_LICENCE = re.compile(r"\b(?:licen[sc]ed? (?:under|to)|copyright|\(c\) \d|all rights reserved|spdx-|(?:see|refer to|consult) (?:the |our |its )?(?:\w+ )?licen[sc]e (?:file|terms)|(?:subject to|(?:governed|covered|bound) by|(?:re)?distributed|released|made available) [^.]*\blicen[sc]e (?:file|terms)|licen[sc]e that can be found in|permission is hereby granted)\b|©|自动生成|请勿(?:手动)?修改|(?:создан|сгенерирован)\S* автоматически|automatisch erzeugt", re.I)
#: What may follow a request to write something without making it a description.
_NO_MORE = (
    r"(?:[\s,;:.!-]+(?:here|later|soon|now|please|before (?:the |next |this )*(?:release|merge|merging|review|commit)|(?:for|to|of|about|in) (?:(?:this|the) (?:function|method)|it)"
    r"|(?:explaining |describing |about |on )?what (?:it|this)(?: function| method)? does|(?:when|once) (?:done|ready|finished|stable)"
    r"|with (?:a |an |the |your )?(?:real|proper|actual|own|better|meaningful)(?: (?:one|text|description|documentation|docs|comment))?|and tests?))*[\s.!…)\]]*"
)
_EMPTY_PROMISE = re.compile(
    r"^(?:(?:no|missing) (?:documentation|description|docs|docstring|comment)s?\b.*|(?:documentation|description|docs|docstring|comment)s? (?:is |are )?(?:missing|goes? here|to be|will be|pending|not available|comes? later|follows?)\b.*"
    r"|(?:add|fill in|write|insert|put|replace|complete|revisit) (?:the |a |an |this |some |your )?(?:documentation|description|docs|docstring|comment|text)s?" + _NO_MORE + r"|.*\bto be (?:filled in|written|documented|added|completed)\b.*|not (?:yet )?documented\b.*|lorem ipsum\b.*"
    r"|(?:документаци|описани)\S* (?:будет|отсутств|нет|скоро|появится).*|(?:добавить|дописать|заполнить|написать) (?:документаци|описани|комментари)\S*.*|нет (?:документаци|описани)\S*.*|описание (?:функции )?отсутствует.*"
    r"|(?:документаці|опис)\S* (?:буде|відсутн|немає).*|(?:dokumentation|beschreibung) (?:fehlt|folgt|wird)\b.*|(?:documentación|descripción) (?:pendiente|falta|se añadirá)\b.*|(?:documentation|description) (?:manquante|à venir|à compléter)\b.*|(?:documentação|descrição) (?:pendente|em falta|será)\b.*"
    r"|.*(?:待补充|待完善|暂无(?:文档|说明|描述|注释)|稍后补充|文档缺失|以后再写|待添加).*)$",
    re.I | re.S,
)
_CODE = re.compile(
    r"^\s*(?:(?:let|var|const|return|import|from|package|use|mut|final|auto|int|String|else|elif|if|for|while|switch|print|await|async|func|def|fn)\b.*[;:{}()=]\s*$"
    r"|[\w.\[\]()<>&*]+(?:\s*,\s*[\w.\[\]]+)*\s*(?::=|[-+*/|&]?=(?!=))\s*\S.*|[\w.]+\([^)]*\)\s*[;{]?\s*|.*[;{}]\s*|[)}\]]+;?\s*)$"
)
_WORD = re.compile(r"[^\W\d_][\w’'-]*")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
#: Words that add nothing to a name.
_FILLER = frozenset(
    "a an the this that it is are was does do doing done to for of and or in on with by from function func method procedure routine helper class constructor implementation implements implement performs perform executes execute runs run handles handle handler returns return gets get sets set called named name simply just new one here see calls call above below internal use used uses utility wrapper".split()
)
_TRUE_DATE = re.compile(r"^\s*(?:created|modified|updated|changed|author|since|version|last (?:edit|change|update)d?|date)\b[\s:]*(?:on |by |at |in )?[\w.@-]*\s*\d[\d.:/-]*\s*$", re.I)


def plain(doc: str | None) -> str:
    """A comment or docstring without its markers and common indent."""
    if not doc:
        return ""
    text = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    text = _FENCE.sub("", _FENCE.sub("", text))
    raw = text.lstrip().startswith(("/*", "//", "#", "*", "--"))
    lines = []
    for line in text.split("\n"):
        bare = _MARK.sub("", line, count=1) if raw else line
        bare = bare.rstrip()
        lines.append(bare[:-1].rstrip("*").rstrip() if bare.endswith("*/") else bare)
    indents = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
    cut = min(indents, default=0)
    return "\n".join([lines[0].strip(), *(x[cut:] for x in lines[1:])]).strip()


def description(doc: str | None) -> str:
    """What the documentation says in prose: no tags, parameter lists, tool notes, licences, code or open tasks."""
    out: list[str] = []
    section: int | None = None
    for line in plain(doc).split("\n"):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if not bare:
            if out and out[-1]:
                out.append("")
            continue
        if _SECTION.match(bare) or re.fullmatch(r"[-=~_*.]{3,}", bare):
            section = 10**6 if bare.startswith("#") else indent
            continue
        if section is not None:
            if section == 10**6 or indent > section or re.match(r"[-*]\s|`?\w+`?\s*(?:\([^)]*\))?\s*:", bare):
                continue
            section = None
        if _TAG.match(bare):
            section = indent if bare[0] in "@:\\" else None
            continue
        if _INLINE_SECTION.match(bare) or _TOOL.match(bare) or _LICENCE.search(bare) or _TRUE_DATE.match(bare) or _EMPTY_PROMISE.match(bare):
            continue
        if not _CJK.search(bare) and _CODE.match(bare):
            continue
        task = _TODO.search(bare)
        if task:
            bare = bare[: task.start()].strip()
            if not bare:
                continue
        out.append(bare)
    return "\n".join(out).strip()


def name_words(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", r"\1\3 \2\4", name)
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+|\s+", spaced) if w]


def telling(doc: str | None, name: str) -> bool:
    """Whether a documentation says something: enough words of prose beyond the name."""
    text = description(doc)
    if len(_CJK.findall(text)) >= MIN_CJK:
        return True
    words = _WORD.findall(text)
    if len(words) < MIN_WORDS:
        return False
    own = set(name_words(name)) | {name.lower()}
    rest = [w for word in words for w in name_words(word) or [word.lower()] if w not in own and w not in _FILLER and w.rstrip("s") not in own]
    return bool(rest)


_FUNCTION_KINDS = ("function", "method", "function_definition", "method_definition", "function_part", "constructor")
_NO_CASE = ("class", "section")


def pairs_of(path: str | None, name: str | None, kind: str | None, docstring: str | None, text: str | None) -> list[tuple[str, str, str, int, int]]:
    """(symbol_name, description, code, line_start, line_end), lines 1-based within the text."""
    lang = language_of(path)
    kind = (kind or "").strip().lower()
    if kind in _NO_CASE or not text:
        return []
    found = functions(text, lang)
    flat = text.replace("\r\n", "\n").replace("\r", "\n")
    wanted = re.split(r"\.|::|#|->", (name or "").strip())[-1].strip()
    out = []
    # the docstring column belongs to the row's own function: the one of its name, else the outermost first
    own = next((f for f in found if f.name == wanted), found[0] if found else None) if kind in _FUNCTION_KINDS else None
    for f in found:
        docs = ([docstring] if f is own and docstring else []) + f.docs
        best = next((d for d in docs if telling(d, f.name)), None)
        if best is None:
            continue
        top = flat.count("\n", 0, f.start) + 1
        out.append((f.name, description(best), flat[f.start : f.end], top, top + flat.count("\n", f.start, f.end)))
    return out


_COLS = ["key", "symbol_name", "description", "code", "line_start", "line_end"]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, path, name, kind, doc, text in zip(*(pdf[c] for c in ("key", "path", "name", "kind", "doc", "text")), strict=True):
            rows.extend((key, *p) for p in pairs_of(path, name, kind, doc, text))
        yield pd.DataFrame(rows, columns=_COLS)


def code_pairs(df: DataFrame, key: str, path: str, name: str, kind: str, docstring: str, text: str) -> DataFrame:
    """Code-description pairs of index rows: key, symbol_name, description, code, line_start, line_end.

    One row per function or method whose code stands in the text and whose
    documentation, from the docstring column of a function row or from the text, is not trivial (see
    :func:`telling`). Classes and sections, null or empty texts and unknown
    languages give none; repeated rows give repeated pairs; other columns are ignored.
    """
    used = {"key": key, "path": path, "name": name, "kind": kind, "doc": docstring, "text": text}
    rows = df.where(F.col(text).isNotNull() & (F.length(text) > 0) & ~F.coalesce(F.lower(F.trim(kind)), F.lit("")).isin(*_NO_CASE))
    return rows.select(*[F.col(c).cast("string").alias(n) for n, c in used.items()]).mapInPandas(_extract, "key string, symbol_name string, description string, code string, line_start int, line_end int")
