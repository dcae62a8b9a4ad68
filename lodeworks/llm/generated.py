"""Generated, minified or vendored source files, and data stored as code.

A random forest sees the text without its notices: compression ratio, token
entropy, identifier lengths, comment density and how much of the text is
literals. It is trained on labels the text gives away itself: header notices of
generators and bundlers, which are blanked before the features are taken. The
forest decides; a notice is a label and no more. Vendored copies read like any hand-written file, so for them the path and identity of content decide.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut
from lodeworks.llm.codeparse import _LEX, language_of

_GEN_WORD = r"(?:auto[- ]?)?(?:machine[- ])?generated"
#: Notices of generators: who made the file, or that it must not be edited, as a statement about this file.
_GENERATED = re.compile(
    rf"@generated\b|<auto-?generated\b|^\W*(?:this (?:file|code|module|source) (?:is|was|has been) )?(?:automatically |auto-?)?{_GEN_WORD}(?: code| file| automatically)*(?: at build time)?(?: by| from| with| using|:| file\b)"
    r"|^\W*code generated by\b|^\W*autogenerated\b|^\W*machine generated\b|\bdo not (?:edit|modify)(?: this file| manually|\W*$)|\bmanual changes will be (?:lost|overwritten)\b|\bregenerate with\b|^\W*output of `[^`]+`|^\W*AUTO-GENERATED FILE\b"
    r"|自动生成|请勿(?:手动)?(?:修改|编辑)|(?:automatisch|maschinell) (?:erzeugt|generiert)|nicht von hand (?:ändern|bearbeiten)|(?:сгенерирован|создан)\S* автоматически|автоматически (?:сгенерирован|создан)\S*|не редакти\S+(?: вручную)?\W*$|згенерован\S* автоматично|автоматично (?:згенерован|створен)\S*"
    r"|généré (?:automatiquement|par)|ne pas (?:modifier|éditer)\W*$|generado (?:automáticamente|por)|no (?:editar|modificar)\W*$|gerado (?:automaticamente|por)|não (?:editar|modificar)\W*$",
    re.I | re.M,
)
#: Notices of bundlers and minifiers.
_BUNDLED = re.compile(r"^/\*!? ?[\w.-]+ (?:build |v)\d[\w.]* ?\*/|[#@] ?sourceMappingURL=|webpackBootstrap|^\W*(?:minified|bundled|compiled) (?:by|with|using)\b", re.I | re.M)
#: Notices of copies taken from elsewhere.
_VENDORED = re.compile(
    r"^\W*vendored from\b|^\W*upstream: ?\S+@|^\W*(?:this is )?a? ?(?:bundled|vendored|verbatim|unmodified|third[- ]party) copy of\b|^\W*(?:copied|imported|taken|adapted) (?:verbatim )?from (?:the )?(?:upstream|package|project|library|https?:)|^\W*! ?[\w.-]+ v\d[\w.]* \| \(c\)|\bcopy of the upstream package\b",
    re.I | re.M,
)
_GEN_NAME = re.compile(r"(?:_generated|\.generated|_gen|\.gen|_pb2(?:_grpc)?|\.pb|\.g|_autogen|-generated|\.designer|\.min|\.bundle|-min|\.chunk|\.packed)\.[a-z]+$", re.I)
_VENDOR_DIR = re.compile(
    r"(?:^|/)(?:vendor|_vendor|vendored|third[-_]?party|node_modules|bower_components|jspm_packages|external|externals|deps|godeps|site-packages|dist-packages|pods|carthage|contrib|[a-z][\w.]*(?:-[a-z][\w.]*)*-v?\d+\.\d+(?:\.\d+)?)/",
    re.I,
)
_BUILD_DIR = re.compile(r"(?:^|/)(?:dist|public|static|out|bundles?|wwwroot|htdocs)/(?:.*/)?[^/]+\.(?:js|mjs|cjs)$", re.I)

_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_IDENT = re.compile(r"[^\W\d]\w*")
_WORDS = re.compile(r"\w+")


def _shape(m: re.Match[str]) -> str:
    """A word with a digit loses its identity."""
    return "9" if any(c.isdigit() for c in m.group()) else m.group()



FEATURES = [
    "compression", "entropy", "entropy_rest", "ident_mean", "ident_short", "ident_long", "comment_density", "literal_share", "digit_share",
    "line_mean", "line_max", "space_share", "skeletons", "word_skeletons", "log_chars",
]


#: Comment and string syntax of languages beyond those of :mod:`codeparse`, by file ending.
_FAMILIES = {
    "hash": "sh bash zsh fish rb yml yaml toml ini cfg conf r pl pm ps1 mk cmake tf ex exs jl nim properties env dockerfile makefile",
    "slash": "c h cc cpp cxx hpp hh cs kt kts swift scala php css scss less dart proto groovy m mm zig sol jsonc vue svelte",
    "dash": "sql lua hs elm ada adb ads vhd",
    "angle": "html htm xml svg xhtml xsl xsd",
    "semicolon": "lisp el clj cljs scm asm s",
}
_SYNTAX = {
    "hash": r"(?<!\S)#[^\n]*", "slash": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "dash": r"--[^\n]*|/\*.*?(?:\*/|\Z)", "angle": r"<!--.*?(?:-->|\Z)", "semicolon": r";[^\n]*",
    "any": r"^[ \t]*(?:#|//|--|;)[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)",
}
_OTHER_LEX = {k: re.compile(rf"(?P<comment>{c})|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*')", re.S | re.M) for k, c in _SYNTAX.items()}
_FAMILY = {ending: name for name, endings in _FAMILIES.items() for ending in endings.split()}
_LICENCE = re.compile(r"\blicen[sc]e|copyright|all rights reserved|spdx-|\(c\)", re.I)


def lexer(path: str | None) -> re.Pattern[str]:
    """The lexer of the file's language; where the ending names none, one of the comment styles at line starts."""
    known = _LEX.get(language_of(path) or "")
    if known is not None:
        return known
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return _OTHER_LEX[_FAMILY.get(name.rsplit(".", 1)[-1], "any")]


@dataclass
class Reading:
    """What one pass of the lexer finds."""

    made: bool = False
    copied: bool = False
    #: the text without comments that bear a notice or a licence
    shown: str = ""
    #: ``shown`` without comments and strings
    bare: str = ""
    #: the whole text with comments as a space and strings as 0
    outline: str = ""
    comments: int = 0
    strings: int = 0


def read(path: str | None, text: str) -> Reading:
    """Notices, and the text without them, of a file.

    Only comments count, wherever they stand; a name that generators give counts as a notice too.
    """
    name = (path or "").replace("\\", "/")
    out = Reading(made=bool(_GEN_NAME.search(name)))
    shown, bare, outline, at = [], [], [], 0
    for m in lexer(path).finditer(text):
        a, b = m.span()
        between = text[at:a]
        at = b
        shown.append(between)
        bare.append(between)
        outline.append(between)
        comment = m.group("comment")
        if comment is None:
            out.strings += b - a
            shown.append(text[a:b])
            outline.append("0")
            continue
        outline.append(" ")
        lines = [x.strip() for x in comment.split("\n")]
        made = any(_GENERATED.search(x) or _BUNDLED.search(x) for x in lines)
        copied = any(_VENDORED.search(x) for x in lines)
        out.made, out.copied = out.made or made, out.copied or copied
        if not (made or copied or any(_LICENCE.search(x) for x in lines)):
            out.comments += b - a
            shown.append(comment)
    rest = text[at:]
    out.shown, out.bare, out.outline = "".join([*shown, rest]), "".join([*bare, rest]), "".join([*outline, rest])
    return out


def notices(path: str | None, text: str | None) -> tuple[bool, bool]:
    """(made, copied): whether notices in the text, or the name itself, say the file was made by a tool, or copied from elsewhere."""
    r = read(path, text or "")
    return r.made, r.copied


def features(path: str | None, text: str, reading: Reading | None = None) -> list[float]:
    """FEATURES of a text without its notices; an empty one has zeros."""
    r = reading or read(path, text)
    text, bare = r.shown.strip(), r.bare
    n = len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    tokens = Counter(_TOKEN.findall(bare))
    total = sum(tokens.values()) or 1
    entropy = -sum(c / total * math.log2(c / total) for c in tokens.values()) if tokens else 0.0
    # tokens that are words are the identifiers: their counts serve for the lengths too
    idents = [(len(t), c) for t, c in tokens.items() if _IDENT.match(t)]
    count = sum(c for _, c in idents) or 1
    digits = sum(c.isdigit() for c in bare)
    lines = [x for x in text.split("\n") if x.strip()]
    shapes = len({_WORDS.sub(_shape, x.strip()) for x in lines})
    words = len({_WORDS.sub("w", x.strip()) for x in lines})
    return [
        len(zlib.compress(raw, 6)) / len(raw), entropy, entropy / math.log2(total + 1),
        sum(k * c for k, c in idents) / count, sum(c for k, c in idents if k <= 2) / count, sum(c for k, c in idents if k >= 12) / count,
        r.comments / n, r.strings / n, digits / n, n / len(lines), float(max(map(len, lines))), sum(c.isspace() for c in text) / n,
        shapes / len(lines), words / len(lines), math.log10(n),
    ]


def by_path(path: str | None) -> tuple[bool, bool]:
    """(vendored, made): what the path alone says."""
    name = (path or "").replace("\\", "/")
    return bool(_VENDOR_DIR.search(name)), bool(_GEN_NAME.search(name) or _BUILD_DIR.search(name))


_DATA_TOKEN = re.compile(r"[\s,:;()\[\]{}+\\-]+|0[xX][0-9a-fA-F_]+|\d[\d._]*(?:[eE][+-]?\d+)?[uUlLfF]*|\b(?:null|nil|None|true|false|True|False|undefined|NaN)\b")


def is_constant(path: str | None, text: str, reading: Reading | None = None) -> bool:
    """Whether the code is one declaration of a literal and nothing else: data stored as code."""
    if language_of(path) is None or len(text) < 400:
        return False
    bare = (reading or read(path, text)).outline.strip()
    opened = re.search(r"[=(\[{]\s*(?=[\[({0-9-])|=\s*0|\{", bare)
    if not opened or opened.start() > 200 or "=" not in bare[: opened.end() + 1]:
        return False
    head, body = bare[: bare.index("=") + 1], bare[bare.index("=") + 1 :]
    # the type of a Go or Rust literal may stand between the sign and the bracket
    body = re.sub(r"^\s*&?\s*(?:(?:\[\])?[\w.]*\s*|new\s+\w+(?:\[\])*\s*)(?=[\[({])", "", body)
    return head.count("\n") < 4 and not re.search(r"[^\s]", _DATA_TOKEN.sub("", body))


TREES, DEPTH, BINS, FOLDS, SEED = 64, 9, 64, 5, 42
DOUBTFUL, THRESHOLD = 0.2, 0.5

_DESCRIBED = "file_path string, has_text boolean, made boolean, copied boolean, vendored boolean, made_path boolean, content string, x array<double>"


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, path, text in zip(pdf["key"], pdf["file_path"], pdf["text_full"], strict=True):
            r = read(path, text or "")
            made = r.made or is_constant(path, text or "", r)
            same = (text or "").replace("\r\n", "\n").strip()
            content = hashlib.sha1(same.encode()).hexdigest() if same else None
            rows.append((key, path, text is not None, made, r.copied, *by_path(path), content, features(path, text or "", r)))
        yield pd.DataFrame(rows, columns=["key", "file_path", "has_text", "made", "copied", "vendored", "made_path", "content", "x"])


def describe(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Notices, path and features of every row; texts themselves go no further than this."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(path).cast("string").alias("file_path"), F.col(text).cast("string").alias("text_full"))
    return rows.mapInPandas(_describe, f"key {kind}, {_DESCRIBED}")


def _edges(rows: DataFrame) -> list[list[float]]:
    """For each feature of all rows, the bounds between at most ``BINS`` bins of like number; values count with four digits."""
    x = F.col("x")
    scale = F.pow(F.lit(10.0), 3 - F.floor(F.log10("x")))
    each = rows.select(F.posexplode("x").alias("i", "x")).select("i", F.when(x > 0, F.round(x * scale) / scale).otherwise(x).alias("x")).groupBy("i", "x").agg(F.count("*").alias("n"))
    feature = W.partitionBy("i")
    upto = feature.orderBy("x")
    share = F.ceil(F.sum("n").over(upto) * BINS / F.sum("n").over(feature))
    cells = each.select("i", "x", F.when(F.count("*").over(feature) <= BINS, F.row_number().over(upto)).otherwise(share).alias("cell"))
    bounds = cells.select("i", ((F.lag("x").over(upto) + x) / 2).alias("e"), (F.lag("cell").over(upto) < F.col("cell")).alias("new")).where("new")
    out: list[list[float]] = [[] for _ in FEATURES]
    for r in bounds.orderBy("i", "e").collect():
        out[r["i"]].append(r["e"])
    return out


def _binned(edges: list[list[float]]):
    """The features as the numbers of their bins, so that the forest need not draw rows to find its splits."""

    @F.pandas_udf("array<double>")
    def bins(x: pd.Series) -> pd.Series:
        values = np.array(x.tolist(), dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(list(np.column_stack([np.searchsorted(e, values[:, i], side="right") for i, e in enumerate(edges)]).astype(float)))

    return bins("x")


def _grow(rows: DataFrame, n: int):
    """A forest of all of these n rows, the same wherever they lie."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    # Spark finds splits on a sample of the square of maxBins; at this number on all rows. There are BINS values only
    most = max(BINS, math.isqrt(n) + 1)
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, maxBins=most, seed=SEED)
    order = rows.repartition(min(200, math.ceil(n / 5000)), "h").sortWithinPartitions("h", "file_path", "x")
    # with its kind named, the label needs no pass of its own to count its values
    label = F.col("label").alias("label", metadata={"ml_attr": {"type": "binary"}})
    return forest.fit(order.select(label, array_to_vector("x").alias("v")))


def _grow_without_each(rows: DataFrame, pos: Counter, neg: Counter) -> list:
    """For each fold the forest of all other rows. pos, neg: rows of either label by fold.

    One after another: every level of a forest makes broadcasts, each of which begins with a buffer of
    ``spark.broadcast.blockSize`` (4 MB) in the driver, and those of several forests at once make its heap grow.
    """
    total = pos.total() + neg.total()
    return [_grow(rows.where(F.col("fold") != i), total - pos[i] - neg[i]) for i in range(FOLDS)]


def _scores(rows: DataFrame, models: list) -> DataFrame:
    """rows with ``each``: the scores of all models."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = rows.columns
    out = rows.withColumn("v", array_to_vector("x"))
    for i, model in enumerate(models):
        out = model.transform(out).withColumn(f"s{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return out.select(*kept, F.array(*[f"s{i}" for i in range(len(models))]).alias("each"))


def _counts(rows: DataFrame) -> tuple[Counter, Counter]:
    """Numbers of labelled and of other rows by fold."""
    pos, neg = Counter(), Counter()
    for r in rows.groupBy("label", "fold").agg(F.count("*").alias("n")).collect():
        (pos if r["label"] else neg)[r["fold"]] = r["n"]
    return pos, neg


def _fit(described: DataFrame):
    """(forest, threshold, bounds of bins), or None without both labels. All rows take part; only counts and bounds come to the driver.

    Not all generated files bear a notice, so the unlabelled rows hide some. First forests show them: each is
    trained without a fifth of the rows and scores that fifth, as a row that teaches that it is not generated scores low. The mean score of the labelled rows
    estimates what a generated file scores. Unlabelled rows that score more than ``DOUBTFUL`` of it teach nothing in the last forest, which judges.
    Its threshold is the one that errs least on all rows left, of both labels, each again under a forest that did not see it.
    """
    usable = described.where("has_text and not copied and not vendored and content is not null")
    # copies of a text lie in one fold, so that no forest knows what it scores
    fold = F.pmod(F.xxhash64("content"), F.lit(FOLDS))
    rows = usable.select(F.col("made").cast("double").alias("label"), "file_path", F.xxhash64("file_path").alias("h"), fold.alias("fold"), "x")
    pos, neg = _counts(rows)
    if min(pos.total(), neg.total()) < 2:
        return None
    edges = _edges(rows)
    rows = cut(rows.withColumn("x", _binned(edges)))
    enough = pos.total() >= 10 and all(min(pos.total() - pos[i], neg.total() - neg[i]) >= 2 for i in range(FOLDS))
    first = _grow_without_each(rows, pos, neg) if enough else [_grow(rows, pos.total() + neg.total())]
    own = F.get("each", F.col("fold") if enough else F.lit(0))
    scored = cut(_scores(rows, first).withColumn("score", own).drop("each"))
    # whole numbers, so that the order of the rows does not count
    usual = scored.where("label = 1").agg(F.sum(F.round(F.col("score") * 10**9).cast("bigint"))).first()[0] / 10**9 / pos.total()
    sure = scored.where((F.col("label") == 1) | (F.col("score") <= DOUBTFUL * usual)).drop("score")
    _, clear = _counts(sure)
    if clear.total() < 2:
        return _grow(rows, pos.total() + neg.total()), THRESHOLD, edges
    last = _grow(sure, pos.total() + clear.total())
    if not enough or any(clear.total() - clear[i] < 2 for i in range(FOLDS)):
        return last, THRESHOLD, edges
    blind = _grow_without_each(sure, pos, clear)
    judged = _scores(sure, blind).withColumn("score", F.get("each", "fold"))
    below = judged.groupBy("label").agg(*[F.sum((F.col("score") < t).cast("bigint")).alias(f"t{i}") for i, t in enumerate(GRID)]).collect()
    found = {r["label"]: [r[f"t{i}"] for i in range(len(GRID))] for r in below}
    return last, least_wrong(found[1.0], pos.total(), found[0.0], clear.total()), edges


#: Thresholds that come into question.
GRID = [0.2 + 0.01 * i for i in range(61)]


def least_wrong(missed: list[int], pos: int, passed: list[int], neg: int) -> float:
    """The threshold of ``GRID`` that misjudges the smallest share of either label; of equal ones the middle. missed, passed: how many of the pos and neg rows score less than each."""
    wrong = [m / pos + (neg - p) / neg for m, p in zip(missed, passed, strict=True)]
    best = [t for t, w in zip(GRID, wrong, strict=True) if w <= min(wrong) + 1e-12]
    return best[len(best) // 2]


def not_written_by_hand(described: DataFrame) -> DataFrame:
    """described (see :func:`describe`) with ``score`` and ``reason``, of the files that nobody wrote by hand.

    Reasons, first that holds: ``generated`` (the forest's score: notices and literals are labels, they decide nothing),
    ``vendored`` (by its path or a notice of its origin), ``copy`` (identical to a vendored file), and for files
    without text ``path``. Without both labels in the table there is no forest, and a notice decides.
    Prose never counts; a file of blank text is judged by its path as well. An empty
    table gives no rows; repeated rows repeat.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    code = cut(described.where(~F.coalesce(F.col("file_path").rlike(r"(?i)\.(?:md|markdown|mdx|rst|txt|adoc)$"), F.lit(False))))
    fitted = _fit(code)
    threshold = THRESHOLD
    if fitted is None:
        scored = code.withColumn("score", F.col("made").cast("double"))
    else:
        model, threshold, edges = fitted
        scored = model.transform(code.withColumn("v", array_to_vector(_binned(edges)))).withColumn("score", vector_to_array("probability")[1])
    origin = code.where("(vendored or copied) and content is not null").select("content").distinct().withColumn("known", F.lit(True))
    judged = scored.join(origin, "content", "left")
    reason = F.expr(f"""case
        when content is null then case when vendored then 'vendored' when made_path then 'path' end
        when score >= {threshold} then 'generated'
        when vendored or copied then 'vendored'
        when known then 'copy' end""")
    return judged.withColumn("reason", reason).where("reason is not null").select("key", "file_path", "score", "reason", "made")
