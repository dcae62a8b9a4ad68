"""Languages of documents and of the stretches within them.

One interpolated Kneser-Ney model over characters per language (and one for Russian and
Ukrainian in Latin letters), all kept in sorted arrays of packed n-grams. A sentence
gets the language of lowest length-normalised cross-entropy, unless that is above
what held-out sentences of the language reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.seeds import SEEDS

LANGUAGES = ["en", "ru", "uk", "de", "es", "pt", "fr", "zh"]
MODELS = [*LANGUAGES, "ru-latn", "uk-latn"]
ORDER = 5
MIN_WORDS, MIN_HAN = 6, 12
#: Bounds of the labelled sample that comes to the driver for training.
TRAIN_DOCS, TRAIN_DOC_CHARS, TRAIN_CHARS = 600, 20_000, 250_000
#: Held-out sentences that a model needs to be calibrated by them.
LEAST_HELD = 20
SEED = 42

#: Spellings of the languages' names and codes.
NAMES = {
    "en": "en eng english", "ru": "ru rus russian русский", "uk": "uk ukr ukrainian українська", "de": "de deu ger german deutsch", "es": "es spa spanish español castellano",
    "pt": "pt por portuguese português", "fr": "fr fra fre french français", "zh": "zh zho chi chinese cn mandarin 中文",
}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}


def named_language(label: Column) -> Column:
    """The language a label names in any spelling (code, region or script tag, three letters, name, any case), or null."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_.,;()/-]+)(?:$|[_-][a-z0-9_-]*$|\s*\(.*\)$)", 1)
    table = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    return F.when(head != "", F.try_element_at(table, head))


# ---- text to sentences -------------------------------------------------------

_EXT = r"(?:py|pyi|js|jsx|ts|tsx|mjs|go|rs|java|kt|c|h|cc|cpp|hpp|cs|rb|php|sh|bash|sql|json|ya?ml|toml|ini|cfg|md|rst|txt|csv|log|html?|css|xml|lock|parquet|db|so|dll|exe|zip|gz)"
#: What is no prose. Alternatives share their anchors, so most places of a text fail one test only; runs of
#: words that no alternative can touch match as ``plain`` and stay.
_MASK = re.compile(
    rf"""^(?: [ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t\r]*$|\Z)
        | [ \t]*\[?\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d\S*\]?[ \t]+\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b[^\n]*$
        | [^\n]*[;{{}}][ \t\r]*$| [ \t]*(?:def|class|func|fn|return|import|from|package|use|let|var|const|if|elif|else|for|while|with|try|except|catch|switch|assert|raise|async|await|pub|public|private|protected|static|export|@\w+)\b(?=[^\n]*(?:[()\[\]{{}}=]|::|->))[^\n]*$(?<![.!?。])
        | [ \t]*(?:(?:let|var|const|mut|auto|final|self\.|this\.)[ \t]*)*[\w.]+(?:\[[^\]\n]*\])?(?:[ \t]*,[ \t]*[\w.]+)*[ \t]*(?::[ \t]*[\w<>\[\], ]+)?[ \t]*(?::=|[-+*/|&^%]?=)(?!=)[^\n]*$
        | [ \t]*(?:await[ \t]+)?[\w.:]+!?\([^\n]*$(?<![.!?。])
        | [ \t]*(?:return|if|elif|else|for|while|with|try|except|catch|finally|case|switch|match|do|end|raise|throw|assert|pass|break|continue)\b(?:[^\n.!?。]*:|[ \t]*[\w.\[\]()]*)[ \t\r]*$)
    | (?P<plain>(?<!\w)(?:[^\W\d_][^\W\d_A-Z]*+[,;!?).:]?+[ ]++)++)
    | (?<!\w)(?=\w)(?: (?:https?|ftp|file|git|ssh)://\S+ | www\.\S+ | (?<![.+-])[\w.+-]{{1,64}}+@[\w.-]{{1,255}} | (?<![./\\-])(?=[\w/\\-]*+\.\w)[\w./\\-]*[\w-]\.{_EXT}(?::\d+)*\b
        | (?=[^\W_]*+_)\w*+ | [a-z]++[A-Z]\w* | [A-Z][a-z0-9]++[A-Z]\w* | \w++=\S+ | [^\W\d]*+\d(?:[\w.]*\w)? )
    | (?<![\w./\\-])[./\\-][\w./\\-]*[\w-]\.{_EXT}(?::\d+)*\b | --?[a-z][\w-]*
    | `[^`\n]*` | <[/!]?[A-Za-z][^<>\n]{{0,200}}> | \((?<=\]\()[^()\s]*\) | &\#?\w+;
    | «[^«»\n]{{1,40}}» | „[^„“”\n]{{1,40}}[“”] | “[^“”\n]{{1,40}}” | "[^"\n]{{1,40}}" | 「[^「」\n]{{1,40}}」 | ‘[^‘’\n]{{1,40}}’
    """,
    re.X | re.M | re.S,
)
#: Ends of sentences. All begin with one of few characters, so the scan skips from one to the next.
_BREAK = re.compile(
    r"[.!?…。！？\n|](?:(?<=[.!?…])(?<![.!?…][.!?…])[.!?…]*+[\"'”»)\]]*(?=\s|$)|(?<=[。！？])[”」』）)]*|(?<=\n)[^\S\n]*\n|(?<=\n)(?=[ \t]*(?:[-*+>#|•]|\d+[.)]|\[))|(?<=\|))"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")


def masked_text(text: str) -> str:
    """The text with all that is no prose blanked, line ends and offsets kept."""
    out, at = [], 0
    for m in _MASK.finditer(text):
        if m.lastgroup is None:
            a, b = m.span()
            gone = text[a:b]
            out += text[at:a], " " * (b - a) if "\n" not in gone else re.sub(r"[^\n]", " ", gone)
            at = b
    out.append(text[at:])
    return "".join(out)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, clean) of the sentences that are long enough to count.

    clean has names, code, log lines and quoted labels blanked. Six words are needed, or twelve
    Chinese characters. Offsets count code points of the text as it is.
    """
    masked = masked_text(text)
    out, at = [], 0
    for m in [*_BREAK.finditer(masked), None]:
        a, b = at, m.end() if m else len(masked)
        at = b
        part = masked[a:b]
        if len(part) < MIN_HAN or not part.strip():
            continue
        han = len(_HAN.findall(part)) if not part.isascii() else 0
        if han >= MIN_HAN or len(_WORD.findall(_HAN.sub(" ", part) if han else part)) >= MIN_WORDS:
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + len(part.rstrip()), part.strip()))
    return out


# ---- sentences to codes ------------------------------------------------------


def _code_table() -> np.ndarray:
    """Code of each character below U+10000: 0 for anything but letters, 1 for letters beyond the alphabets."""
    table = np.zeros(0x10000, dtype=np.uint8)
    cyrillic = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ"
    for i in range(0x10000):
        c = chr(i)
        if not (c.isalpha() or c in "'’ʼ"):
            continue
        low = c.lower()
        if low in cyrillic:
            table[i] = 30 + cyrillic.index(low)
        elif _HAN.match(c):
            table[i] = 70
        elif low in "'’ʼ":
            table[i] = 29
        elif "ß" == low:
            table[i] = 2 + ord("s") - 97
        else:
            base = unicodedata.normalize("NFD", low)[0]
            table[i] = 2 + ord(base) - 97 if "a" <= base <= "z" else 1
    return table


_CODES = _code_table()
_BITS = 7


def codes(text: str) -> np.ndarray:
    """Letters in lower case without accents of Latin letters; all else is one space. Starts and ends with a space."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _CODES[np.where(points < 0x10000, points, 0)]
    c = np.concatenate([[0], c, [0]]).astype(np.uint8)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def coded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one run of codes, each after order - 1 spaces; which codes count, and the text of each.

    The counting codes of a text are those of :func:`codes` but for the space at its start.
    """
    whole = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
    pad = " " * (order - 1)
    points = np.frombuffer("".join(pad + t + " " for t in whole).encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _CODES[np.where(points < 0x10000, points, 0)]
    lengths = np.array([len(t) + order for t in whole], dtype=np.int64)
    owner = np.repeat(np.arange(len(whole)), lengths)
    starts = np.cumsum(lengths) - lengths
    lead = np.zeros(len(c), dtype=bool)
    for k in range(order - 1):
        lead[starts + k] = True
    counts = c != 0
    counts[1:] |= c[:-1] != 0
    counts &= ~lead
    stays = counts | lead
    return c[stays], counts[stays], owner[stays]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams ending at each position, with spaces before the start."""
    key = np.zeros(len(c), dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = np.zeros(len(c), dtype=np.uint64)
        shifted[back:] = c[: len(c) - back] if back else c
        key = (key << np.uint64(_BITS)) | shifted
    return key


# ---- Kneser-Ney --------------------------------------------------------------


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted keys, and whether they are there."""
    if len(keys) == 0:
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """Interpolated Kneser-Ney over packed n-grams of one language."""

    def __init__(self, texts: list[np.ndarray], order: int = ORDER) -> None:
        self.order = order
        top = [grams(c, order)[1:] for c in texts if len(c) > 2]
        raw = np.concatenate(top) if top else np.zeros(0, dtype=np.uint64)
        self.levels = []
        keys, counts = np.unique(raw, return_counts=True)
        for n in range(order, 0, -1):
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            contexts, first = np.unique(keys >> np.uint64(_BITS), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, dtype=np.int64)
            kinds = np.diff(np.append(first, len(keys)))
            self.levels.append((keys, counts.astype(np.float64), d, contexts, total.astype(np.float64), kinds.astype(np.float64)))
            if n > 1:
                # the next level counts how many different characters stand before each shorter n-gram
                keys, counts = np.unique(keys & np.uint64((1 << (_BITS * (n - 1))) - 1), return_counts=True)

    def gamma(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """Weight that level n leaves to the level below in each context; 1 where the context is unknown."""
        _, _, d, known, total, kinds = self.levels[self.order - n]
        at, there = _find(known, contexts)
        out = np.ones(len(contexts))
        out[there] = d * kinds[at[there]] / total[at[there]]
        return out

    def prob(self, keys: np.ndarray, n: int) -> np.ndarray:
        """P(last | rest) of packed n-grams."""
        p = np.full(len(keys), 1.0 / 72) if n == 1 else self.prob(keys & np.uint64((1 << (_BITS * (n - 1))) - 1), n - 1)
        own, counts, d, known, total, _ = self.levels[self.order - n]
        context = keys >> np.uint64(_BITS)
        p = p * self.gamma(context, n)
        at, there = _find(own, keys)
        where, _ = _find(known, context[there])
        p[there] += np.maximum(counts[at[there]] - d, 0) / total[where]
        return p


class Scorer:
    """All languages at once: per level one sorted array of the n-grams any of them knows, with a row of log2 P."""

    def __init__(self, models: list[KneserNey]) -> None:
        self.order = models[0].order
        self.probs, self.gammas = [], []
        for n in range(self.order, 0, -1):
            level = self.order - n
            keys = np.unique(np.concatenate([m.levels[level][0] for m in models]))
            self.probs.append((keys, np.stack([np.log2(m.prob(keys, n)) for m in models], axis=1).astype(np.float32)))
            contexts = np.unique(np.concatenate([m.levels[level][3] for m in models]))
            self.gammas.append((contexts, np.stack([np.log2(m.gamma(contexts, n)) for m in models], axis=1).astype(np.float32)))

    def log2(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        known, table = self.probs[level]
        at, there = _find(known, keys)
        out = table[at] if len(known) else np.zeros((len(keys), table.shape[1]), dtype=np.float32)
        lost = np.nonzero(~there)[0]
        if len(lost):
            rare = keys[lost]
            n = self.order - level
            if n == 1:
                rest = np.full((len(rare), table.shape[1]), np.float32(np.log2(1.0 / 72)))
            else:
                rest = self.log2(rare & np.uint64((1 << (_BITS * (n - 1))) - 1), level + 1)
            contexts, weights = self.gammas[level]
            where, known_context = _find(contexts, rare >> np.uint64(_BITS))
            if len(contexts):
                rest = rest + np.where(known_context[:, None], weights[where], 0)
            out[lost] = rest
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character under each model, and the characters, of each text; 0 of both without letters."""
        width = len(self.probs[0][1][0]) if len(self.probs[0][1]) else len(MODELS)
        bits, sizes = np.zeros((len(texts), width)), np.zeros(len(texts), dtype=np.int64)
        c, kept, owner = coded(texts, self.order)
        take = np.nonzero(kept)[0]
        if not len(take):
            return bits, sizes
        # texts of one corpus repeat their n-grams: each is looked up once
        known, at = np.unique(grams(c, self.order)[take], return_inverse=True)
        rows, first = np.unique(owner[take], return_index=True)
        sizes[rows] = np.diff(np.append(first, len(take)))
        bits[rows] = -np.add.reduceat(self.log2(known)[at], first, axis=0) / sizes[rows, None]
        return bits, sizes


#: Common romanisations of Cyrillic letters, for the models of Latin script.
_ROMAN = [
    {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g"},
    {"ё": "e", "й": "i", "х": "kh", "ц": "c", "щ": "shch", "ю": "iu", "я": "ia", "ь": "'", "ї": "i", "є": "ie"},
    {"ё": "jo", "й": "j", "х": "h", "ц": "c", "щ": "shch", "ю": "ju", "я": "ja", "ь": "", "ї": "ji", "є": "je"},
]
_ROMAN_UK = {"г": "h", "и": "y"}


def romanised(text: str, scheme: int, ukrainian: bool) -> str:
    table = _ROMAN[0] | (_ROMAN[scheme] if scheme else {}) | (_ROMAN_UK if ukrainian else {})
    return "".join(table.get(c, c) for c in text.lower())


@dataclass
class LanguageModel:
    scorer: Scorer
    limits: np.ndarray
    slope: float

    def judge(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each sentence; the language is null where the best model's entropy is beyond its limit."""
        bits, sizes = self.scorer.entropies(texts)
        best, margin = _decided(bits, sizes)
        sure = 1.0 / (1.0 + np.exp2(-np.minimum(60.0, self.slope * margin)))
        fits = bits[np.arange(len(bits)), best] <= self.limits[best]
        return [(MODELS[m][:2] if ok and n else None, float(p)) for m, ok, n, p in zip(best, fits, sizes, sure, strict=True)]


_OWNER = np.array([LANGUAGES.index(m[:2]) for m in MODELS])


def _decided(bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best model of each row, and the bits by which the text as a whole is worse under the best model of another language."""
    best = bits.argmin(axis=1)
    rival = np.where(_OWNER[None, :] == _OWNER[best][:, None], np.inf, bits).min(axis=1) if len(bits) else np.zeros(0)
    return best, (rival - bits[np.arange(len(bits)), best]) * sizes


def _trained(by_lang: dict[str, list[str]]) -> Scorer:
    models = []
    for m in MODELS:
        texts = by_lang[m[:2]]
        if "-" in m:
            texts = [romanised(t, k % len(_ROMAN), m == "uk-latn") for k, t in enumerate(texts)]
            texts += [romanised(t, 0, m == "uk-latn") for t in by_lang[m[:2]]]
        if m == "de":
            texts = texts + [re.sub("[äöüÄÖÜ]", lambda c: {"ä": "ae", "ö": "oe", "ü": "ue"}[c.group().lower()], t) for t in texts[::3]]
        models.append(KneserNey([codes(t) for t in texts]))
    return Scorer(models)


def train(labelled: list[tuple[str, str]]) -> LanguageModel:
    """From (language, text) of a bounded sample whose labels may be wrong.

    The first models know only the seed sentences. Labelled sentences that the models put in the
    labelled language train the next ones, twice; every tenth is held out, and the limits
    of rejection come from those. Without labelled text the seeds alone decide.
    """
    seeds = {lang: [s for _, _, s in sentences(SEEDS[lang])] for lang in LANGUAGES}
    pool: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    sizes = dict.fromkeys(LANGUAGES, 0)
    for lang, text in labelled:
        for _, _, s in sentences(text):
            if sizes[lang] < 2 * TRAIN_CHARS:
                pool[lang].append(s)
                sizes[lang] += len(s)
    scorer = _trained(seeds)
    held_texts: dict[str, list[str]] = {}
    for _ in range(2):
        kept = {lang: list(seeds[lang]) for lang in LANGUAGES}
        held_texts = {m: [] for m in MODELS}
        for lang, texts in pool.items():
            bits, _ = scorer.entropies(texts)
            size = 0
            for k, (t, row) in enumerate(zip(texts, bits, strict=True)):
                m = MODELS[int(row.argmin())]
                if m != lang:
                    continue
                if k % 10 == 9:
                    held_texts[m].append(t)
                elif size < TRAIN_CHARS:
                    kept[lang].append(t)
                    size += len(t)
        scorer = _trained(kept)
        for lang in ("ru", "uk"):
            held_texts[f"{lang}-latn"] = [romanised(t, k % len(_ROMAN), lang == "uk") for k, t in enumerate(held_texts[lang])]
    # too few to calibrate by: what models of half of the seeds make of the other half stands in
    few = {m for m in MODELS if len(held_texts[m]) < LEAST_HELD}
    halves = _trained({lang: texts[::2] for lang, texts in seeds.items()})
    for m in few:
        rest = seeds[m[:2]][1::2]
        held_texts[m] = [romanised(t, k, m == "uk-latn") for t in rest for k in range(len(_ROMAN))] if "-" in m else rest
    return calibrated(scorer, held_texts, lambda m: halves if m in few else scorer)


def _shuffled(text: str, rnd: np.random.Generator) -> str:
    """The same letters and gaps in another order."""
    return "".join(text[i] for i in rnd.permutation(len(text)))


def _fragments(text: str, rnd: np.random.Generator) -> list[str]:
    """Runs of whole words of 1 to 6 words, in which languages are mistaken for each other."""
    words = text.split()
    out, at = [], 0
    while at < len(words):
        n = int(rnd.integers(1, 7))
        out.append(" ".join(words[at : at + n]))
        at += n
    return out


def calibrated(scorer: Scorer, held: dict[str, list[str]], measure: Callable[[str], Scorer]) -> LanguageModel:
    """Limits of rejection and slope of the confidence from held-out sentences of each model.

    The limit of a model lies halfway between what all but one in a thousand of its held-out sentences
    reach and what all but one in a thousand of the same letters in random order exceed (for Chinese, whose
    characters share one code, sentences of other languages). Where the two overlap the first holds. The slope
    is the one of highest likelihood for the logistic curve of a right answer over the margin in
    bits, on fragments of 1 to 6 words of the held-out sentences.
    """
    rnd = np.random.default_rng(SEED)
    limits = []
    for i, m in enumerate(MODELS):
        own = measure(m).entropies(held[m])[0][:, i]
        others = [t for o in MODELS if o[:2] != "zh" for t in held[o]] if m == "zh" else [_shuffled(t, rnd) for t in held[m]]
        noise = measure(m).entropies(others)[0][:, i]
        low, high = float(np.quantile(own, 0.999)), float(np.quantile(noise, 0.001))
        limits.append((low + high) / 2 if low < high else low)
    margins, right = [], []
    for m, texts in held.items():
        parts = [f for t in texts for f in _fragments(t, rnd)]
        bits, sizes = measure(m).entropies(parts)
        best, margin = _decided(bits, sizes)
        margins.append(margin[sizes > 0])
        right.append(_OWNER[best[sizes > 0]] == LANGUAGES.index(m[:2]))
    x, y = np.concatenate(margins), np.concatenate(right)
    return LanguageModel(scorer, np.array(limits), _slope(x, y))


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    """Maximum likelihood of P(right) = 1 / (1 + 2^(-slope x)); its one parameter is bracketed and bisected."""
    low, high = 1e-3, 10.0

    def rise(slope: float) -> float:
        p = 1.0 / (1.0 + np.exp2(-np.minimum(60.0, slope * x)))
        return float(((y - p) * x).sum())

    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if rise(middle) > 0 else (low, middle)
    return (low + high) / 2


def reliability(model: LanguageModel, labelled: list[tuple[str, str]], bins: int = 5) -> list[tuple[float, float, int]]:
    """(mean confidence, share that is right, number) of labelled fragments in bins of equal number, by rising confidence."""
    bits, sizes = model.scorer.entropies([t for _, t in labelled])
    best, margin = _decided(bits, sizes)
    sure = 1.0 / (1.0 + np.exp2(-np.minimum(60.0, model.slope * margin)))
    right = np.array([MODELS[m][:2] == lang for m, (lang, _) in zip(best, labelled, strict=True)])
    order = np.argsort(sure, kind="stable")
    return [(float(sure[b].mean()), float(right[b].mean()), len(b)) for b in np.array_split(order, bins) if len(b)]


# ---- over a corpus -----------------------------------------------------------


def fit(df: DataFrame, key: str, text: str, label: str, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Trains on at most ``train_docs`` labelled documents per language of 41 to ``TRAIN_DOC_CHARS`` characters, taken by the hash of their key.

    At most train_docs x TRAIN_DOC_CHARS characters a language come to the driver; a repeated key counts once.
    """
    from pyspark.sql import Window as W

    named = df.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.length(text).alias("n"), named_language(F.col(label)).alias("lang"), F.col(text).alias("t"))
    named = named.where(f"lang is not null and n > 40 and n <= {TRAIN_DOC_CHARS}")
    # the rank needs keys and labels only; texts are joined to the few that are taken
    pick = named.select("h", "k", "lang").withColumn("salt", F.pmod("h", F.lit(32)))
    per_salt = W.partitionBy("lang", "salt").orderBy("h", "k")
    pick = pick.withColumn("r", F.row_number().over(per_salt)).where(F.col("r") <= train_docs).select("lang", "h", "k").distinct()
    pick = pick.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "k"))).where(F.col("r") <= train_docs)
    texts = named.select("k", "lang", "t").join(F.broadcast(pick.select("k", "lang", "h")), ["k", "lang"])  # at most 8 x train_docs keys
    rows = texts.groupBy("h", "k", "lang").agg(F.max("t").alias("t")).collect()
    rows.sort(key=lambda r: (r["h"], str(r["k"]), r["lang"]))
    return train([(r["lang"], r["t"]) for r in rows])


_SEGMENT = "array<struct<start:int,end:int,lang:string,confidence:double>>"


def _segment_batch(batches: Iterator[pd.DataFrame], model) -> Iterator[pd.DataFrame]:
    m: LanguageModel = model.value
    for pdf in batches:
        texts, owner, spans = [], [], []
        out: list[list] = [[] for _ in range(len(pdf))]
        size = 0

        def flush() -> None:
            for (lang, sure), i, span in zip(m.judge(texts), owner, spans, strict=True):
                if lang is not None:
                    out[i].append((*span, lang, round(sure, 4)))
            texts.clear(), owner.clear(), spans.clear()

        for i, text in enumerate(pdf["text"]):
            for a, b, s in sentences(text) if text else ():
                texts.append(s)
                owner.append(i)
                spans.append((a, b))
                size += len(s)
                if size > 100_000:
                    flush()
                    size = 0
        flush()
        merged = [_merged(x) for x in out]
        yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "segments": merged})


def _merged(parts: list[tuple[int, int, str, float]]) -> list[dict]:
    """Neighbouring sentences of one language become one stretch; its confidence is the mean by length."""
    out: list[list] = []
    for a, b, lang, sure in parts:
        if out and out[-1][2] == lang:
            last = out[-1]
            last[3] += sure * (b - a)
            last[4] += b - a
            last[1] = b
        else:
            out.append([a, b, lang, sure * (b - a), b - a])
    return [{"start": a, "end": b, "lang": lang, "confidence": s / n} for a, b, lang, s, n in out]


def languages(df: DataFrame, key: str, text: str, label: str, model: LanguageModel) -> DataFrame:
    """(key, label, segments): the language ``label`` names, or null, and the stretches of the whole text with language and confidence.

    Null, empty and blank texts, and texts without a sentence of enough words, have no
    segments; repeated rows repeat; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), named_language(F.col(label)).alias("label"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(lambda it: _segment_batch(it, shared), f"key {kind}, label string, segments {_SEGMENT}")


def mislabelled(found: DataFrame) -> DataFrame:
    """(key, lang): of rows of :func:`languages` whose set of languages is not just the one their label names, one row per language."""
    langs = found.select("key", "label", F.array_sort(F.array_distinct(F.col("segments.lang"))).alias("langs"))
    wrong = langs.where((F.size("langs") > 0) & (F.col("label").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("label"))))
    return wrong.select("key", F.explode("langs").alias("lang"))


def document_language(found: DataFrame) -> DataFrame:
    """(key, lang, confidence, share): the language of most characters; without any, null and 0."""
    totals = found.select("key", F.expr("""transform(array_distinct(segments.lang), l -> named_struct(
        'chars', aggregate(filter(segments, s -> s.lang = l), 0, (n, s) -> n + s.`end` - s.start),
        'sum', aggregate(filter(segments, s -> s.lang = l), 0d, (n, s) -> n + (s.`end` - s.start) * s.confidence), 'lang', l))""").alias("t"))
    best = totals.select("key", F.expr("array_max(t)").alias("b"), F.expr("aggregate(t, 0, (n, x) -> n + x.chars)").alias("all"))
    return best.select("key", F.col("b.lang").alias("lang"), F.expr("round(coalesce(b.sum / b.chars * b.chars / all, 0), 4)").alias("confidence"), F.expr("round(coalesce(b.chars / all, 0), 4)").alias("share"))
