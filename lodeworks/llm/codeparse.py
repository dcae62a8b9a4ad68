"""Small syntax trees of source fragments: functions, their ranges and attached comments.

Python is parsed by the standard library where the fragment allows it, indented methods too. Other
languages go through the parser of :mod:`lodeworks.llm.syntax`. Python fragments that begin or end in the middle of something
go through a lexer that blanks strings and comments; each function header becomes a
node with its range, its body and the comments attached to it.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from lodeworks.llm.syntax import Parser

LANGUAGES = {
    "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js",
    "go": "go", "rs": "rust", "java": "java",
}


def language_of(path: str | None) -> str | None:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return LANGUAGES.get(name.rsplit(".", 1)[-1]) if "." in name else None


@dataclass
class Function:
    """One function node: char range, 0-based, of declaration and body; docs as written, outermost first."""

    name: str
    start: int
    end: int
    docs: list[str] = field(default_factory=list)
    depth: int = 0


_STRING = {
    "js": r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?",
    "go": r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'|`[^`]*`?",
    "rust": r"r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n]{1,10}?|[^'\\\n])'",
    "java": r"\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^'\n]{0,8}|[^'\\\n])'",
    "python": r"[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)",
}
_COMMENT = {k: r"//[^\n]*|/\*.*?(?:\*/|\Z)" for k in ("js", "go", "rust", "java")} | {"python": r"#[^\n]*"}
_LEX = {k: re.compile(rf"(?P<comment>{_COMMENT[k]})|(?P<string>{_STRING[k]})", re.S) for k in _STRING}
_NOT_NL = re.compile(r"[^\n]")


def _lex(text: str, lang: str) -> tuple[str, list[tuple[int, int]], dict[int, int]]:
    """Text with strings and comments blanked; spans of comments; starts to ends of strings."""
    out, comments, strings, at = [], [], {}, 0
    for m in _LEX[lang].finditer(text):
        out.append(text[at : m.start()])
        out.append(_NOT_NL.sub(" ", m.group()))
        at = m.end()
        if m.lastgroup == "comment" or m.group("comment") is not None:
            comments.append(m.span())
        else:
            strings[m.start()] = m.end()
    out.append(text[at:])
    return "".join(out), comments, strings


_PYTHON_HEADER = re.compile(rf"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>[^\W\d]\w*)[ \t]*(?=[(\[])", re.M)
_OPEN, _CLOSE = "([{", ")]}"


def _brackets(masked: str) -> dict[int, int]:
    """Position of each opening bracket to that of its closing one; unclosed ones end with the text."""
    pairs, stack = {}, []
    left = dict.fromkeys(_OPEN, 0)
    for m in re.finditer(r"[()\[\]{}]", masked):
        c = m.group()
        if c in _OPEN:
            stack.append(m.start())
            left[c] += 1
            continue
        want = _OPEN[_CLOSE.index(c)]
        # a stray closing bracket of a cut fragment closes nothing; a real one closes all that stand open inside
        while left[want]:
            p = stack.pop()
            pairs[p] = m.start()
            left[masked[p]] -= 1
            if masked[p] == want:
                break
    for p in stack:
        pairs[p] = len(masked)
    return pairs


_ANNOTATION = re.compile(r"\s*(?:@[\w.]+.*|#!?\[.*\]?|export(?:\s+default)?|template\s*<.*>|\)\s*)\s*$")


class _Comments:
    """Looks up the comments that touch a place."""

    def __init__(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.text, self.spans = text, spans
        self.starts = [a for a, _ in spans]

    def above(self, start: int) -> str:
        """The comment directly above the line of ``start``; annotations may stand between."""
        text = self.text
        at = start
        while at > 0 and text[at - 1] in " \t":
            at -= 1
        if at > 0 and text[at - 1] != "\n":
            return ""  # something else stands before it on its line
        got: list[str] = []
        while at > 0:
            prev = text.rfind("\n", 0, at - 1) + 1
            line = text[prev : at - 1]
            k = bisect_right(self.starts, at - 1) - 1
            if k >= 0 and self.spans[k][1] in (at - 1, at - 2) or (k >= 0 and self.spans[k][0] < at - 1 <= self.spans[k][1]):
                a, b = self.spans[k]
                own = text.rfind("\n", 0, a) + 1
                if text[own:a].strip():
                    break  # a remark behind code of the line above
                body = text[a:b]
                if got and (body.startswith("/*") or got[0].startswith("/*")):
                    break
                got.insert(0, body)
                if body.startswith("/*"):
                    at = own
                    break
                at = own
            elif line.strip() and _ANNOTATION.match(line) and not got:
                at = prev
            else:
                break
        return "\n".join(got)

    def head(self, start: int) -> str:
        """The comments with which a body begins."""
        got, at = [], start
        k = bisect_right(self.starts, start - 1)
        while k < len(self.spans):
            a, b = self.spans[k]
            between = self.text[at:a]
            if between.strip() or (got and between.count("\n") > 1):
                break
            got.append(self.text[a:b])
            if self.text[a:b].startswith("/*"):
                break
            at, k = b, k + 1
        return "\n".join(got)


def _braced(text: str, lang: str) -> list[Function]:
    """The function nodes of the text's tree with the comments above them and at the head of their bodies."""
    masked, spans, _ = _lex(text, lang)
    comments = _Comments(text, spans)
    out = []
    for node in Parser(masked, lang).tree().walk():
        if node.kind == "function":
            docs = [comments.above(node.start), comments.head(node.body) if node.body >= 0 else ""]
            out.append(Function(node.name, node.start, node.end, [d for d in docs if d]))
    return _nested(out)


def _nested(found: list[Function]) -> list[Function]:
    found.sort(key=lambda f: (f.start, -f.end))
    stack: list[Function] = []
    for f in found:
        while stack and stack[-1].end <= f.start:
            stack.pop()
        f.depth = len(stack)
        stack.append(f)
    return found


def _dedented(text: str) -> tuple[str, int]:
    """Fragments of methods begin indented: the text without its first line's indent, where all lines have it, and that indent's bytes."""
    first = re.match(r"[ \t]+(?=\S)", text)
    if not first:
        return text, 0
    lead = first.group()
    lines = text.split("\n")
    if all(not x.strip() or x.startswith(lead) for x in lines):
        return "\n".join(x[len(lead) :] for x in lines), len(lead)
    return text, 0


def _python(text: str) -> list[Function]:
    masked, spans, strings = _lex(text, "python")
    comments = _Comments(text, spans)
    flat, lead = _dedented(text)
    try:
        tree = ast.parse(flat)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    if tree is not None:
        return _python_tree(tree, text, comments, lead)
    # a fragment: headers, and the string or comment that follows each
    out = []
    pairs = _brackets(masked)
    for m in _PYTHON_HEADER.finditer(masked):
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        indent = start - m.start()
        paren = masked.find("(", m.end())
        close = pairs.get(paren, len(masked)) if paren >= 0 else len(masked)
        colon = masked.find(":", close)
        colon = len(masked) if colon < 0 else colon
        docs = [comments.above(start)]
        at = re.compile(r"[ \t\r\n]*").match(text, min(colon + 1, len(text))).end()
        if at in strings:
            docs.append(text[at : strings[at]])
        else:
            docs.append(comments.head(colon + 1))
            # comments may stand before the docstring
            after = re.compile(r"\s*").match(masked, min(colon + 1, len(masked))).end()
            if after in strings:
                docs.append(text[after : strings[after]])
        end = len(text)
        for line in re.finditer(r"^([ \t]*)\S", masked[colon:], re.M):
            if line.start() > 0 and len(line.group(1)) <= indent:
                end = colon + line.start()
                break
        out.append(Function(m.group("name"), start, end, [d for d in docs if d]))
    return _nested(out)


def _defined(tree: ast.AST) -> list[ast.FunctionDef | ast.AsyncFunctionDef]:
    """All function nodes; only statements are visited, for expressions hold none."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        for part in ("body", "orelse", "finalbody", "handlers", "cases"):
            for child in getattr(node, part, ()):
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                    out.append(child)
                stack.append(child)
    return out


def _python_tree(tree: ast.Module, text: str, comments: _Comments, lead: int = 0) -> list[Function]:
    """lead: the bytes by which every line of the text is further in than in the tree."""
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    lines = text.split("\n")

    def offset(line: int, col: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[: col + lead].decode(errors="ignore"))

    out = []
    for node in _defined(tree):
        start = offset(node.lineno, node.col_offset)
        top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        docs = [comments.above(starts[top - 1] + len(lines[top - 1]) - len(lines[top - 1].lstrip()))]
        if top < node.lineno:
            docs.append(comments.above(start))
        doc = ast.get_docstring(node, clean=True)
        if doc:
            docs.append(doc)
        first = node.body[0]
        colon = text.rfind(":", start, offset(first.lineno, first.col_offset))
        head = comments.head(colon + 1) if colon >= 0 else ""
        if not head and colon >= 0:
            # a comment between header and body makes rfind find a colon inside it: look at the line below the header
            head = comments.head(starts[min(node.lineno, len(starts) - 1)])
        docs.append(head)
        out.append(Function(node.name, start, offset(node.end_lineno, node.end_col_offset), [d for d in docs if d]))
    return _nested(out)


def functions(text: str | None, lang: str | None) -> list[Function]:
    """Functions and methods of a fragment in order of their start; none for null or empty text or an unknown language."""
    if not text or lang not in _LEX:
        return []
    # line ends count as one character from here on, so ranges are those of the text with \n
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _python(text) if lang == "python" else _braced(text, lang)
