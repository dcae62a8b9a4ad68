"""A subset of the Cypher query language, planned directly onto DataFrames.

    query := (["OPTIONAL"] "MATCH" path ("," path)*)+ ["WHERE" expr] "RETURN" ["DISTINCT"] item ("," item)*
             ["ORDER" "BY" item ["ASC"|"DESC"] ("," ...)*] ["SKIP" n] ["LIMIT" n]
    path  := node (rel node)*            node := "(" [var] (":" Label)* ["{" key ":" literal ("," ...)* "}"] ")"
    rel   := ["<"] "-" ["[" [var] [":" TYPE ("|" TYPE)*] ["*" [min] ".." max] "]"] "-" [">"]

Labels and types compare in any letter case. Three-valued logic holds: a comparison with null is unknown. Unknown
labels and types are an error if a vocabulary is given. Undirected patterns are a union of both orientations, so their joins stay equi-joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CypherError(ValueError):
    """The query cannot be parsed or planned."""


# ---- words -------------------------------------------------------------------

_TOKEN = re.compile(
    r"\s+|//[^\n]*|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+(?:\.(?!\.)\d+)?)|(?P<word>`[^`]+`|[A-Za-z_]\w*)|(?P<op><>|!=|<=|>=|=~|\.\.|->|<-|[-=<>()\[\]{},.:*|+/%$])"
)
_KEYWORDS = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "DISTINCT", "ORDER", "BY", "ASC", "DESC", "SKIP", "LIMIT", "AND", "OR", "XOR", "NOT", "IN", "IS", "NULL", "CONTAINS", "STARTS", "ENDS", "WITH", "AS", "EXISTS", "TRUE", "FALSE"}


@dataclass
class Token:
    kind: str
    text: str


def lex(query: str) -> list[Token]:
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise CypherError(f"cannot read {query[at : at + 10]!r}")
        at = m.end()
        if m.lastgroup is None:
            continue
        text = m.group()
        if m.lastgroup == "word" and text.upper() in _KEYWORDS:
            out.append(Token(text.upper(), text))
        elif m.lastgroup == "word":
            out.append(Token("word", text.strip("`")))
        elif m.lastgroup == "str":
            out.append(Token("str", re.sub(r"\\(.)", r"\1", text[1:-1])))
        elif m.lastgroup == "num":
            out.append(Token("num", text))
        elif text in ("->", "<-"):
            out += [Token(c, c) for c in text]
        else:
            out.append(Token(text, text))
    return [*out, Token("end", "")]


# ---- tree --------------------------------------------------------------------


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    direction: str  # out, in, both
    low: int = 1
    high: int = 1


@dataclass
class Path:
    nodes: list[NodePattern]
    rels: list[RelPattern]


@dataclass
class Match:
    paths: list[Path]
    optional: bool


@dataclass
class Item:
    expr: Any
    name: str


@dataclass
class Query:
    matches: list[Match]
    where: Any = None
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None


MAX_HOPS = 10
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class Parser:
    def __init__(self, query: str) -> None:
        self.tokens = lex(query)
        self.at = 0

    def peek(self, *kinds: str) -> bool:
        return self.tokens[self.at].kind in kinds

    def take(self, *kinds: str) -> Token | None:
        if self.peek(*kinds):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, *kinds: str) -> Token:
        t = self.take(*kinds)
        if t is None:
            raise CypherError(f"expected {' or '.join(kinds)}, found {self.tokens[self.at].text or 'the end'!r}")
        return t

    def query(self) -> Query:
        q = Query([])
        while self.peek("MATCH", "OPTIONAL"):
            optional = self.take("OPTIONAL") is not None
            self.need("MATCH")
            paths = [self.path()]
            while self.take(","):
                paths.append(self.path())
            q.matches.append(Match(paths, optional))
        if not q.matches:
            raise CypherError("a query begins with MATCH")
        if self.take("WHERE"):
            q.where = self.disjunction()
        self.need("RETURN")
        q.distinct = self.take("DISTINCT") is not None
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.operand()
                down = self.take("ASC", "DESC")
                q.order.append((e, down is not None and down.kind == "DESC"))
                if not self.take(","):
                    break
        while t := self.take("SKIP", "LIMIT"):
            n = int(self.need("num").text)
            if t.kind == "SKIP":
                q.skip = n
            else:
                q.limit = n
        self.need("end")
        return q

    def path(self) -> Path:
        nodes, rels = [self.node()], []
        while self.peek("<", "-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Path(nodes, rels)

    def node(self) -> NodePattern:
        self.need("(")
        var = self.take("word")
        labels = []
        while self.take(":"):
            labels.append(self.need("word").text)
        props = {}
        if self.take("{"):
            while True:
                key = self.need("word").text
                self.need(":")
                props[key] = self.literal()
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return NodePattern(var.text if var else None, labels, props)

    def rel(self) -> RelPattern:
        left = self.take("<") is not None
        self.need("-")
        var, types, low, high = None, [], 1, 1
        if self.take("["):
            t = self.take("word")
            var = t.text if t else None
            if self.take(":"):
                types.append(self.need("word").text)
                while self.take("|"):
                    self.take(":")
                    types.append(self.need("word").text)
            if self.take("*"):
                first = self.take("num")
                if self.take(".."):
                    low = int(first.text) if first else 1
                    last = self.take("num")
                    if last is None:
                        raise CypherError("a path of unbounded length: give it an upper bound")
                    high = int(last.text)
                elif first:
                    low = high = int(first.text)
                else:
                    raise CypherError("a path of unbounded length: give it an upper bound")
                if not 1 <= low <= high <= MAX_HOPS:
                    raise CypherError(f"path lengths go from 1 to {MAX_HOPS}")
            self.need("]")
        self.need("-")
        right = self.take(">") is not None
        if var and (low, high) != (1, 1):
            raise CypherError("a path of several hops has no single edge to name")
        return RelPattern(var, types, "both" if left == right else "in" if left else "out", low, high)

    def disjunction(self) -> Any:
        e = self.exclusive()
        while self.take("OR"):
            e = ("or", e, self.exclusive())
        return e

    def exclusive(self) -> Any:
        e = self.conjunction()
        while self.take("XOR"):
            e = ("xor", e, self.conjunction())
        return e

    def conjunction(self) -> Any:
        e = self.negation()
        while self.take("AND"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> Any:
        if self.take("NOT"):
            return ("not", self.negation())
        return self.predicate()

    def predicate(self) -> Any:
        if self.take("EXISTS"):
            self.need("{")
            self.take("MATCH")
            p = self.path()
            self.need("}")
            return ("exists", p)
        if self.peek("(") and not self._is_pattern():
            self.need("(")
            e = self.disjunction()
            self.need(")")
            return e
        if self.peek("("):
            return ("exists", self.path())
        if self.peek("word") and self.tokens[self.at + 1].kind == ":":
            var = self.need("word").text
            self.need(":")
            return ("label", var, self.need("word").text)
        a = self.operand()
        if self.take("IS"):
            negated = self.take("NOT") is not None
            self.need("NULL")
            return ("not", ("null", a)) if negated else ("null", a)
        negated = self.take("NOT") is not None
        if self.take("IN"):
            self.need("[")
            values = [] if self.peek("]") else [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need("]")
            e: Any = ("in", a, values)
        elif self.take("CONTAINS"):
            e = ("contains", a, self.operand())
        elif self.take("STARTS"):
            self.need("WITH")
            e = ("starts", a, self.operand())
        elif self.take("ENDS"):
            self.need("WITH")
            e = ("ends", a, self.operand())
        else:
            op = self.need("=", "<>", "!=", "<", ">", "<=", ">=", "=~")
            e = ("cmp", op.kind, a, self.operand())
        return ("not", e) if negated else e

    def _is_pattern(self) -> bool:
        """Whether the bracket ahead opens a node pattern that a relation follows."""
        depth, i = 0, self.at
        while i < len(self.tokens):
            k = self.tokens[i].kind
            depth += (k == "(") - (k == ")")
            i += 1
            if depth == 0:
                break
        return self.tokens[i].kind in ("-", "<") and self.tokens[i + 1].kind in ("-", "[")

    def operand(self) -> Any:
        if self.peek("word") and self.tokens[self.at + 1].kind == "(":
            name = self.need("word").text.lower()
            if name not in _AGGREGATES:
                raise CypherError(f"unknown function {name}")
            self.need("(")
            distinct = self.take("DISTINCT") is not None
            arg = None if self.take("*") or self.peek(")") else self.operand()
            self.need(")")
            if arg is None and name != "count":
                raise CypherError(f"{name} needs an argument")
            return ("agg", name, distinct, arg)
        if self.peek("word"):
            var = self.need("word").text
            if self.take("."):
                return ("prop", var, self.need("word", *_KEYWORDS).text)
            return ("var", var)
        return ("lit", self.literal())

    def literal(self) -> Any:
        minus = self.take("-") is not None
        t = self.need("str", "num", "TRUE", "FALSE", "NULL")
        if t.kind == "str":
            return t.text
        if t.kind == "num":
            n = float(t.text) if "." in t.text else int(t.text)
            return -n if minus else n
        return {"TRUE": True, "FALSE": False, "NULL": None}[t.kind]

    def item(self) -> Item:
        start = self.at
        e = self.operand()
        text = "".join(t.text for t in self.tokens[start : self.at])
        alias = self.need("word").text if self.take("AS") else None
        return Item(e, alias or text)


def parse(query: str) -> Query:
    return Parser(query).query()


# ---- plan --------------------------------------------------------------------

_NODE = ["id", "name", "label", "qualified_name", "file_path", "properties"]
_EDGE = ["id", "type", "weight", "properties"]


class Planner:
    def __init__(self, nodes: DataFrame, edges: DataFrame, labels: set[str] | None, types: set[str] | None) -> None:
        self.nodes = nodes.select(*_NODE)
        self.edges = edges.where("source_id is not null and target_id is not null").select(*_EDGE, "source_id", "target_id")
        self.labels = {x.lower() for x in labels} if labels is not None else None
        self.types = {x.lower() for x in types} if types is not None else None
        self.kinds: dict[str, str] = {}
        self.hidden = 0

    def _anonymous(self) -> str:
        self.hidden += 1
        return f"#{self.hidden}"

    def _check(self, path: Path, optional: bool) -> None:
        if optional:
            return
        for n in path.nodes:
            for x in n.labels:
                if self.labels is not None and x.lower() not in self.labels:
                    raise CypherError(f"unknown label {x}")
        for r in path.rels:
            for x in r.types:
                if self.types is not None and x.lower() not in self.types:
                    raise CypherError(f"unknown relation type {x}")

    def _node_frame(self, n: NodePattern, var: str) -> DataFrame:
        df = self.nodes
        if n.labels:
            df = df.where(F.lower("label").isin([x.lower() for x in n.labels]))
        for key, value in n.props.items():
            c = F.col(key) if key in _NODE else F.get_json_object("properties", f"$.{key}")
            df = df.where(c.isNull() if value is None else c == F.lit(value if key in _NODE else str(value).lower() if isinstance(value, bool) else str(value)))
        return df.select(*[F.col(c).alias(f"{var}.{c}") for c in _NODE])

    def _hops(self, r: RelPattern) -> DataFrame:
        """(_s, _t, edge columns) of one relation pattern; several hops are unrolled, no edge twice in a path."""
        e = self.edges
        if r.types:
            e = e.where(F.lower("type").isin([x.lower() for x in r.types]))
        out = e.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"), *_EDGE)
        back = e.select(F.col("target_id").alias("_s"), F.col("source_id").alias("_t"), *_EDGE)
        if r.direction == "out":
            step = out
        elif r.direction == "in":
            step = back
        else:
            step = out.unionByName(back.where("_s <> _t"))
        if (r.low, r.high) == (1, 1):
            return step
        one = step.select("_s", "_t", F.array("id").alias("_ids"))
        grown, keep = one, []
        for n in range(1, r.high + 1):
            if n > 1:
                nxt = step.select(F.col("_s").alias("_m"), F.col("_t").alias("_n"), F.col("id").alias("_id"))
                grown = grown.join(nxt, F.col("_t") == F.col("_m")).where(F.expr("not array_contains(_ids, _id)")).select("_s", F.col("_n").alias("_t"), F.concat("_ids", F.array("_id")).alias("_ids"))
            if n >= r.low:
                keep.append(grown.select("_s", "_t"))
        df = keep[0]
        for k in keep[1:]:
            df = df.unionByName(k)
        return df.select("_s", "_t", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("properties"))

    def _bind(self, var: str, kind: str) -> None:
        if self.kinds.setdefault(var, kind) != kind:
            raise CypherError(f"{var} names both a node and an edge")

    def _path(self, path: Path) -> tuple[DataFrame, list[str], list[str]]:
        """Rows of one path, the node variables and the edge variables in it."""
        node_vars, edge_vars = [], []
        df = None
        edge_ids: list[str] = []
        for k, n in enumerate(path.nodes):
            var = n.var or self._anonymous()
            self._bind(var, "node")
            if k == 0:
                df = self._node_frame(n, var)
            else:
                r = path.rels[k - 1]
                e = r.var or self._anonymous()
                self._bind(e, "edge")
                hop = self._hops(r)
                hop = hop.select(F.col("_s").alias(f"{e}._s"), F.col("_t").alias(f"{e}._t"), *[F.col(c).alias(f"{e}.{c}") for c in _EDGE])
                df = df.join(hop, df[f"`{node_vars[-1]}.id`"] == hop[f"`{e}._s`"])
                if var in node_vars:
                    target = self._node_frame(n, var).select(F.col(f"`{var}.id`").alias("_again"))
                    df = df.where(F.col(f"`{e}._t`") == F.col(f"`{var}.id`")).join(target, F.col(f"`{var}.id`") == F.col("_again"), "left_semi")
                else:
                    target = self._node_frame(n, var)
                    df = df.join(target, df[f"`{e}._t`"] == target[f"`{var}.id`"])
                df = df.drop(f"{e}._s", f"{e}._t")
                if (r.low, r.high) == (1, 1):
                    # one path uses an edge once
                    for other in edge_ids:
                        df = df.where(F.col(f"`{other}.id`") != F.col(f"`{e}.id`"))
                    edge_ids.append(e)
                edge_vars.append(e)
            if var not in node_vars:
                node_vars.append(var)
            elif k:
                node_vars.append(node_vars.pop(node_vars.index(var)))
        return df, node_vars, edge_vars

    def _join(self, left: DataFrame | None, right: DataFrame, bound: set[str], own: list[str], how: str) -> DataFrame:
        if left is None:
            return right
        shared = [v for v in own if v in bound]
        if not shared:
            if how == "left":
                return left.join(right, F.lit(True), "left")
            return left.crossJoin(right)
        ids = [f"{v}.id" for v in shared]
        drop = [c for c in right.columns if c.rsplit(".", 1)[0] in shared and c not in ids]
        right = right.drop(*drop)
        for k, c in enumerate(ids):
            right = right.withColumnRenamed(c, f"_k{k}")
        cond = None
        for k, c in enumerate(ids):
            one = F.col(f"`{c}`") == F.col(f"_k{k}")
            cond = one if cond is None else cond & one
        return left.join(right, cond, how).drop(*[f"_k{k}" for k in range(len(ids))])

    def rows(self, q: Query) -> DataFrame:
        df, bound = None, set()
        for m in q.matches:
            part, own = None, []
            for p in m.paths:
                self._check(p, m.optional)
                f, nv, ev = self._path(p)
                vars_ = [*nv, *ev]
                part = self._join(part, f, set(own), vars_, "inner")
                own += [v for v in vars_ if v not in own]
            df = self._join(df, part, bound, own, "left" if m.optional and df is not None else "inner")
            bound |= set(own)
        if q.where is not None:
            df = self._where(df, q.where)
        return df

    # expressions

    def value(self, e: Any) -> Column:
        if e[0] == "lit":
            return F.lit(e[1])
        if e[0] == "var":
            self._known(e[1])
            return F.col(f"`{e[1]}.id`")
        if e[0] == "prop":
            _, var, prop = e
            self._known(var)
            native = _NODE if self.kinds[var] == "node" else _EDGE
            if prop in native:
                return F.col(f"`{var}.{prop}`")
            return F.get_json_object(F.col(f"`{var}.properties`"), f"$.{prop}")
        raise CypherError("an aggregate stands where a value is needed")

    def _known(self, var: str) -> None:
        if var not in self.kinds:
            raise CypherError(f"unknown variable {var}")

    def _pair(self, a: Any, b: Any) -> tuple[Column, Column]:
        """JSON properties are strings: compared with a number they are cast, null where that fails."""
        x, y = self.value(a), self.value(b)

        def is_json(e: Any) -> bool:
            return e[0] == "prop" and e[2] not in (_NODE if self.kinds[e[1]] == "node" else _EDGE)

        def numeric(e: Any) -> bool:
            return e[0] == "lit" and isinstance(e[1], int | float) and not isinstance(e[1], bool)

        if is_json(a) and numeric(b):
            x = x.try_cast("double")
        if is_json(b) and numeric(a):
            y = y.try_cast("double")
        if is_json(a) and b[0] == "lit" and isinstance(b[1], bool):
            x = x.try_cast("boolean")
        return x, y

    def condition(self, e: Any) -> Column:
        kind = e[0]
        if kind == "or":
            return self.condition(e[1]) | self.condition(e[2])
        if kind == "and":
            return self.condition(e[1]) & self.condition(e[2])
        if kind == "xor":
            return self.condition(e[1]) != self.condition(e[2])
        if kind == "not":
            return ~self.condition(e[1])
        if kind == "null":
            return self.value(e[1]).isNull()
        if kind == "label":
            self._known(e[1])
            return F.lower(F.col(f"`{e[1]}.label`")) == e[2].lower()
        if kind == "in":
            parts = [self._pair(e[1], ("lit", v)) for v in e[2]]
            out = F.lit(False)
            for x, y in parts:
                out = out | (x == y)
            return out
        if kind in ("contains", "starts", "ends"):
            f = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[kind]
            return f(self.value(e[1]), self.value(e[2]))
        if kind == "cmp":
            x, y = self._pair(e[2], e[3])
            op = e[1]
            if op == "=~":
                return F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$")))
            return {"=": x == y, "<>": x != y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if kind == "flag":
            return F.col(e[1])
        raise CypherError("not a condition")

    def _where(self, df: DataFrame, e: Any) -> DataFrame:
        """Conjuncts apply one by one; EXISTS there is a semi or anti join, deeper inside it becomes a flag from an outer join."""
        if isinstance(e, tuple) and e[0] == "and":
            return self._where(self._where(df, e[1]), e[2])
        if e[0] == "exists" or (e[0] == "not" and e[1][0] == "exists"):
            path = e[1] if e[0] == "exists" else e[1][1]
            keys, cond = self._exists(df, path, "_x")
            return df.join(keys, cond, "left_semi" if e[0] == "exists" else "left_anti")
        flags: list[str] = []

        def lifted(x: Any) -> Any:
            nonlocal df
            if isinstance(x, tuple) and x and x[0] == "exists":
                name = f"_f{len(flags)}"
                flags.append(name)
                keys, cond = self._exists(df, x[1], f"_x{len(flags)}")
                df = df.join(keys.withColumn(name, F.lit(True)), cond, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(*keys.columns)
                return ("flag", name)
            if isinstance(x, tuple) and x and x[0] in ("or", "and", "not", "xor"):
                return (x[0], *[lifted(y) for y in x[1:]])
            return x

        e = lifted(e)
        return df.where(self.condition(e)).drop(*flags)

    def _exists(self, df: DataFrame, path: Path, prefix: str) -> tuple[DataFrame, Column]:
        self._check(path, False)
        outer = dict(self.kinds)
        inner = Planner(self.nodes, self.edges, None, None)
        rows, nv, ev = inner._path(path)
        shared = [v for v in [*nv, *ev] if v in outer]
        if not shared:
            raise CypherError("EXISTS needs a variable of the outer pattern")
        keys = rows.select(*[F.col(f"`{v}.id`").alias(f"{prefix}{k}") for k, v in enumerate(shared)]).distinct()
        cond = None
        for k, v in enumerate(shared):
            one = F.col(f"`{v}.id`") == F.col(f"{prefix}{k}")
            cond = one if cond is None else cond & one
        return keys, cond

    def aggregate(self, e: Any) -> Column:
        _, name, distinct, arg = e
        if arg is None:
            return F.count(F.lit(1))
        c = self.value(arg)
        if name in ("sum", "avg") and arg[0] == "prop":
            c = c.try_cast("double") if arg[2] not in ("id", "weight") else c
        if distinct:
            return {"count": F.count_distinct, "sum": F.sum_distinct, "collect": F.collect_set}[name](c)
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}[name](c)

    def projected(self, df: DataFrame, q: Query) -> DataFrame:
        names = [i.name for i in q.items]
        if len(set(names)) < len(names):
            raise CypherError("two columns have one name")
        spread: list[Item] = []
        for i in q.items:
            # a whole node or edge comes out as its columns
            if i.expr[0] == "var":
                self._known(i.expr[1])
                native = _NODE if self.kinds[i.expr[1]] == "node" else _EDGE
                spread += [Item(("prop", i.expr[1], c), f"{i.name}.{c}") for c in native]
            else:
                spread.append(i)
        aggs = [i for i in spread if i.expr[0] == "agg"]
        by_text = {repr(i.expr): i.name for i in spread}
        order = []
        extra: list[tuple[str, Any]] = []
        for n, (e, down) in enumerate(q.order):
            if e[0] == "var" and e[1] in names:
                col = e[1]
            elif repr(e) in by_text:
                col = by_text[repr(e)]
            else:
                col = f"_o{n}"
                extra.append((col, e))
            order.append((col, down))
        if aggs or any(e[0] == "agg" for _, e in extra):
            keys = [self.value(i.expr).alias(i.name) for i in spread if i.expr[0] != "agg"]
            cols = [self.aggregate(i.expr).alias(i.name) for i in aggs]
            for col, e in extra:
                if e[0] != "agg":
                    raise CypherError("ORDER BY after an aggregation needs a returned column")
                cols.append(self.aggregate(e).alias(col))
            out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*cols) if cols else df.select(*keys).distinct()
        else:
            out = df.select(*[self.value(i.expr).alias(i.name) for i in spread], *[self.value(e).alias(c) for c, e in extra])
        if q.distinct:
            if extra:
                raise CypherError("ORDER BY with DISTINCT needs a returned column")
            out = out.distinct()
        if order:
            out = out.orderBy(*[F.desc_nulls_last(f"`{c}`") if down else F.asc_nulls_first(f"`{c}`") for c, down in order])
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*[c for c, _ in extra])


def cypher(nodes: DataFrame, edges: DataFrame, query: str, labels: set[str] | None = None, types: set[str] | None = None) -> DataFrame:
    """The result of a query. ``labels`` and ``types`` are the vocabulary, if it is to be checked; OPTIONAL patterns are exempt from the check."""
    q = parse(query)
    planner = Planner(nodes, edges, labels, types)
    return planner.projected(planner.rows(q), q)
