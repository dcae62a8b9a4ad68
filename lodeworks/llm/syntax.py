"""Syntax trees of JavaScript, TypeScript, Go, Rust and Java sources and fragments.

A scanner gives tokens, brackets are matched, and at every place where a statement may begin the language's
grammar of declarations is tried: modifiers, annotations, generics, receiver, parameters, result and body are
consumed token by token. Function, class and block nodes are nested into one tree. Fragments that begin or end in the middle
of something give the nodes that are whole as far as the text goes: an unclosed bracket ends with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Node:
    """kind: file, function, class or block. ``body`` is the position behind the opening brace of a function, -1 without one."""

    kind: str
    name: str
    start: int
    end: int
    body: int = -1
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """The nodes below, in order of their start."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.children[::-1])


_TOKEN = re.compile(r"(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<nl>\n)|=>|->|::|[^\w\s]|[^\W\d]\w*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_CLASS_WORDS = {
    "js": {"class", "interface", "namespace", "enum"}, "go": {"struct", "interface"}, "rust": {"struct", "enum", "trait", "impl", "mod", "union"}, "java": {"class", "interface", "enum", "record"},
}
#: Words that open a statement or expression before "(" where a header has no introducing keyword; others of the languages' words may name methods.
_RESERVED = {
    "js": {"if", "for", "while", "switch", "catch", "with", "function", "case"},
    "java": {"if", "for", "while", "switch", "catch", "try", "return", "new", "else", "do", "throw", "super", "this", "synchronized", "case", "assert", "void", "import", "class"},
}
#: Legal names of JS methods that also stand before "(" in expressions; an arrow may follow there.
_BEFORE_ARROW = {"return", "throw", "await", "yield", "typeof", "void", "delete", "new", "else", "do", "in", "of", "super"}
_JS_MODIFIERS = {"public", "private", "protected", "static", "async", "override", "readonly", "abstract", "get", "set"}
_JAVA_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp"}
_NO_TYPE = {"return", "new", "else", "throw", "case", "package", "import", "assert"}
_RUST_QUALIFIERS = {"default", "const", "async", "unsafe", "extern"}


class Parser:
    """``masked`` is the text with comments and strings blanked, line ends kept."""

    def __init__(self, masked: str, lang: str) -> None:
        self.lang, self.length = lang, len(masked)
        self.words: list[str] = []
        self.at: list[int] = []
        #: whether a token is the first of its line
        self.first: list[bool] = []
        #: whether a word that may be a name, and not a bracket or sign
        self.named: list[bool] = []
        fresh = True
        for m in _TOKEN.finditer(masked):
            kind = m.lastgroup
            if kind == "nl":
                fresh = True
                continue
            self.words.append(m.group())
            self.at.append(m.start())
            self.first.append(fresh)
            self.named.append(kind == "word")
            fresh = False
        self.n = len(self.words)
        self.closing = self._brackets()
        #: where the name of the last declaration has been read
        self.header = 0

    def _brackets(self) -> dict[int, int]:
        """Token of each opening bracket to that of its closing one, or to ``n`` where none is left."""
        pairs: dict[int, int] = {}
        stack: list[int] = []
        left = dict.fromkeys(_OPEN, 0)
        for i, w in enumerate(self.words):
            if w in _OPEN:
                stack.append(i)
                left[w] += 1
            elif w in _CLOSE:
                # a stray closing bracket of a fragment closes nothing; a real one closes all that stand open inside
                want = _CLOSE[w]
                while left[want]:
                    p = stack.pop()
                    pairs[p] = i
                    left[self.words[p]] -= 1
                    if self.words[p] == want:
                        break
        for p in stack:
            pairs[p] = self.n
        return pairs

    # ---- helpers over tokens: each takes a token number and gives the next one ----

    def word(self, i: int) -> str:
        return self.words[i] if i < self.n else ""

    def name(self, i: int) -> str | None:
        return self.words[i] if i < self.n and self.named[i] else None

    def behind(self, i: int) -> int:
        """Behind the bracket that opens at token i."""
        return self.closing[i] + 1

    def position(self, i: int) -> int:
        return self.at[i] if i < self.n else self.length

    def end_of(self, i: int) -> int:
        """Position behind the bracket that opens at token i."""
        close = self.closing[i]
        return self.at[close] + 1 if close < self.n else self.length

    def generics(self, i: int) -> int:
        """Behind ``<...>`` at token i; i itself if it does not close before a brace or semicolon."""
        if self.word(i) != "<":
            return i
        depth, k = 0, i
        while k < self.n and self.words[k] not in "{;}":
            w = self.words[k]
            if w in _OPEN:
                k = self.behind(k)
                continue
            depth += (w == "<") - (w == ">")
            k += 1
            if depth == 0:
                return k
        return i

    def to_body(self, i: int) -> int:
        """The token of the brace or semicolon that follows a header; types in braces are passed over."""
        while i < self.n and self.words[i] not in ("{", ";"):
            i += 1
            if self.word(i) == "{" and self.lang == "go" and self.words[i - 1] in ("interface", "struct"):
                i = self.behind(i)
        return i

    # ---- declarations -----------------------------------------------------------

    def _function(self, i: int, name: str, close: int) -> Node:
        """A function whose header starts at token i and whose parameters close at token ``close``."""
        k = i
        while k < close and k < self.n and self.words[k] != name:
            k += 1
        self.header = self.position(k) + 1
        body = self.to_body(min(close + 1, self.n))
        if self.word(body) == "{":
            return Node("function", name, self.at[i], self.end_of(body), self.at[body] + 1)
        return Node("function", name, self.at[i], min(self.position(body) + 1, self.length))

    def go(self, i: int) -> Node | None:
        if self.words[i] != "func":
            return None
        k = self.behind(i + 1) if self.word(i + 1) == "(" else i + 1
        name = self.name(k)
        k += 1
        if self.word(k) == "[":
            k = self.behind(k)
        return self._function(i, name, self.closing[k]) if name and self.word(k) == "(" else None

    def rust(self, i: int) -> Node | None:
        k = i
        if self.words[k] == "pub":
            k = self.behind(k + 1) if self.word(k + 1) == "(" else k + 1
        while self.word(k) in _RUST_QUALIFIERS:
            k += 1
        name = self.name(k + 1)
        if self.word(k) != "fn" or not name:
            return None
        k = self.generics(k + 2)
        while k < self.n and self.words[k] not in "({;":
            k += 1
        return self._function(i, name, self.closing[k] if self.word(k) == "(" else k - 1)

    def java(self, i: int) -> Node | None:
        k, words = i, set()
        while True:
            w = self.word(k)
            if w == "@" and self.word(k + 1) != "interface":
                k += 2
                while self.word(k) == ".":
                    k += 2
                k = self.behind(k) if self.word(k) == "(" else k
            elif w in _JAVA_MODIFIERS:
                words.add(w)
                k += 1
            elif w == "<" and self.generics(k) > k:
                k = self.generics(k)
            else:
                break
        kind = self.name(k)
        if not kind:
            return None
        k += 1
        if self.word(k) == "(":
            name, kind = kind, None
        else:
            while self.word(k) == "." and self.name(k + 1):
                k += 2
            k = self.generics(k)
            while self.word(k) == "[" and self.word(k + 1) == "]":
                k += 2
            name = self.name(k)
            k += 1
            if not name or self.word(k) != "(":
                return None
        if name in _RESERVED["java"]:
            return None
        close = self.closing[k]
        body = self.to_body(min(close + 1, self.n))
        rest = self.word(close + 1) if close + 1 < body else ""
        if rest not in ("", "throws", "["):
            return None
        opened = self.word(body) == "{"
        if kind is None or kind in _NO_TYPE:
            if not (opened and words & {"public", "private", "protected"} and rest != "["):
                return None
        elif not (opened or close >= self.n or self.word(body) == ";" and words & {"abstract", "native"}):
            return None
        return self._function(i, name, close)

    def js(self, i: int) -> Node | None:
        return self._js_function(i) or self._js_variable(i) or self._js_method(i)

    def _js_function(self, i: int) -> Node | None:
        k = i
        if self.words[k] == "export":
            k += 2 if self.word(k + 1) == "default" else 1
        k += self.word(k) == "async"
        if self.word(k) != "function":
            return None
        k += 2 if self.word(k + 1) == "*" else 1
        name = self.name(k)
        k = self.generics(k + 1)
        return self._function(i, name, self.closing[k]) if name and self.word(k) == "(" else None

    def _js_variable(self, i: int) -> Node | None:
        k = i + (self.words[i] == "export")
        if self.word(k) not in ("const", "let", "var"):
            return None
        name = self.name(k + 1)
        k += 2
        if name and self.word(k) == ":":
            while k < self.n and self.words[k] not in ("=", ";"):
                k = self.behind(k) if self.words[k] in _OPEN else k + 1
        if not name or self.word(k) != "=":
            return None
        k += 1
        k += self.word(k) == "async"
        if self.word(k) == "function":
            k += 2 if self.word(k + 1) == "*" else 1
            k += self.name(k) is not None
            return self._function(i, name, self.closing[k]) if self.word(k) == "(" else None
        k = self.generics(k)
        if self.name(k) and self.word(k + 1) == "=>":
            arrow = k + 1
        elif self.word(k) == "(":
            arrow = self.behind(k)
            if self.word(arrow) == ":":
                while arrow < self.n and self.words[arrow] not in ("=>", "=", ";", "{", "}"):
                    arrow = self.behind(arrow) if self.words[arrow] in "([" else arrow + 1
            if self.word(arrow) != "=>":
                return None
        else:
            return None
        self.header = self.at[arrow]
        if self.word(arrow + 1) == "{":
            return Node("function", name, self.at[i], self.end_of(arrow + 1), self.at[arrow + 1] + 1)
        # the body is an expression: it ends with its line, brackets passed over
        k = arrow + 1
        while k < self.n and self.words[k] not in ";})]" and not (k > arrow + 1 and self.first[k]):
            k = self.behind(k) if self.words[k] in _OPEN else k + 1
        last = min(k, self.n) - 1
        return Node("function", name, self.at[i], min(self.at[last] + len(self.words[last]), self.length))

    def _js_method(self, i: int) -> Node | None:
        k = i
        while self.word(k) in _JS_MODIFIERS and self.word(k + 1) not in ("(", "<"):
            k += 1
        k += self.word(k) == "*"
        k += self.word(k) == "#"
        name = self.name(k)
        if not name or k == i and name in _RESERVED["js"]:
            return None
        k = self.generics(k + 1)
        if self.word(k) != "(":
            return None
        close = self.closing[k]
        body = self.to_body(min(close + 1, self.n))
        if self.word(body) != "{":
            return None
        if close + 1 < body and (self.word(close + 1) != ":" or name in _BEFORE_ARROW and self.words[body - 1] == "=>"):
            return None
        return self._function(i, name, close)

    # ---- the tree ---------------------------------------------------------------

    def tree(self) -> Node:
        """The file's node with all others below it, nested by their ranges."""
        root = Node("file", "", 0, self.length)
        declared = getattr(self, self.lang)
        classes = _CLASS_WORDS[self.lang]
        nodes: list[Node] = []
        bodies: set[int] = set()
        header = 0
        for i, w in enumerate(self.words):
            # a header may go over several lines: nothing begins before its name is read
            if self.at[i] >= header and (self.first[i] or self.lang == "js" and self.words[i - 1] in (";", "}")):
                node = declared(i)
                if node is not None:
                    nodes.append(node)
                    bodies.add(node.body)
                    header = self.header
            if w in classes and self.named[i]:
                brace = self.to_body(i)
                if self.word(brace) == "{" and self.at[brace] + 1 not in bodies:
                    bodies.add(self.at[brace] + 1)
                    nodes.append(Node("class", self.name(i + 1) or "", self.at[i], self.end_of(brace), self.at[brace] + 1))
            elif w == "{" and self.at[i] + 1 not in bodies:
                nodes.append(Node("block", "", self.at[i], self.end_of(i), self.at[i] + 1))
        nodes.sort(key=lambda x: (x.start, -x.end))
        stack = [root]
        for node in nodes:
            while stack[-1].end <= node.start and len(stack) > 1:
                stack.pop()
            stack[-1].children.append(node)
            stack.append(node)
        return root
