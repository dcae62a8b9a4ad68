import unicodedata

import numpy as np
import pytest

from lodeworks.llm import langid as L

HELD = {
    "en": "We would like to know whether the old bridge can still carry heavy loads in winter.",
    "ru": "Мы хотели бы узнать, выдержит ли старый мост тяжёлые грузы зимой без ремонта.",
    "uk": "Ми хотіли б дізнатися, чи витримає старий міст важкі вантажі взимку без ремонту.",
    "de": "Wir möchten gern wissen, ob die alte Brücke im Winter noch schwere Lasten tragen kann.",
    "es": "Nos gustaría saber si el puente viejo todavía puede soportar cargas pesadas en invierno.",
    "pt": "Gostaríamos de saber se a ponte velha ainda consegue suportar cargas pesadas no inverno.",
    "fr": "Nous aimerions savoir si le vieux pont peut encore porter de lourdes charges en hiver.",
    "zh": "我们想知道这座旧桥在冬天是否仍然能够承受很重的货物而不需要修理。",
}


@pytest.fixture(scope="module")
def model():
    return L.train([])


def test_probabilities_sum_to_one():
    m = L.KneserNey([L.codes("the cat sat on the mat and the rat ran"), L.codes("a cat")])
    for context in ("the c", "zzzz", "n the"):
        c = L.codes(context)[-5:-1] if len(context) >= 4 else L.codes(context)
        head = np.uint64(0)
        for x in c[-4:]:
            head = (head << np.uint64(7)) | np.uint64(x)
        keys = (head << np.uint64(7)) | np.arange(72, dtype=np.uint64)
        assert m.prob(keys, 5).sum() == pytest.approx(1.0, abs=1e-9)


def test_scorer_equals_the_models():
    texts = {k: [L.codes(v)] for k, v in HELD.items()}
    models = [L.KneserNey(texts[k]) for k in ("en", "de", "ru")]
    s = L.Scorer(models)
    keys = np.unique(np.concatenate([L.grams(L.codes("ein alter Weg, an old road, старый путь zqx"), 5), L.grams(texts["en"][0], 5)]))
    want = np.stack([np.log2(m.prob(keys, 5)) for m in models], axis=1)
    assert np.abs(s.log2(keys) - want).max() < 1e-4
    bits, sizes = s.entropies(["an old road", "x"])
    alone = np.stack([-np.log2(m.prob(L.grams(L.codes("an old road"), 5)[1:], 5)).mean() for m in models])
    assert np.abs(bits[0] - alone).max() < 1e-4 and sizes[0] == 12


@pytest.mark.parametrize("lang", list(HELD))
def test_held_out_sentences(model, lang):
    text = HELD[lang]
    variants = [text, text.upper(), unicodedata.normalize("NFD", text), "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if lang not in ("ru", "uk", "zh") else text]
    if lang in ("ru", "uk"):
        variants += [L.romanised(text, k, lang == "uk") for k in range(3)]
    assert [x[0] for x in model.judge([L.sentences(v)[0][2] for v in variants])] == [lang] * len(variants)
    assert all(0.5 <= x[1] <= 1 for x in model.judge(variants))


def test_noise_is_rejected(model):
    noise = ["qzx wvk jjq xxz kqw vvz qqk zzx", "ελληνικά γράμματα που κανείς εδώ δεν διαβάζει σωστά", "lkjh gfds poiu ytre mnbv cxza qwer"]
    assert [x[0] for x in model.judge(noise)] == [None] * 3


def test_sentences():
    text = (
        "## Title of it\n\nThe loader still keeps `some code that is long enough here` in memory. See «ein zwei drei vier fünf sechs».\n2025-01-01T00:00:00 [INFO] x: many words in a log line here\n"
        "```\nthis is fenced and has more than six words\n```\nfor item in rows:\n    total = sum(a, b, c, d, e, f)\nDies ist ein Satz\nder über zwei Zeilen geht. 索引服务会跳过大于千字节的源文件。短句。"
    )
    found = L.sentences(text)
    got = [" ".join(s.split()) for _, _, s in found]
    assert got[0] == "The loader still keeps in memory." and len(got) == 3
    assert any("Dies ist ein Satz" in s for s in got) and any(s.startswith("索引") for s in got)
    assert not any("fenced" in s or "log line" in s or "sechs" in s or "total" in s for s in got)
    for a, b, s in found:
        assert len(text[a:b]) == len(s)
    assert L.sentences("") == [] and L.sentences("one two three four five.") == [] and len(L.sentences("one two three four five six")) == 1
    assert L.sentences("update to 1.2.3 breaks all of the old readers")[0][2].count(".") == 0


def test_labels(spark):
    cases = {"en": "en", "en-US": "en", " EN": "en", "eng": "en", "English": "en", "pt_BR": "pt", "zh_Hans": "zh", "ger": "de", "UK": "uk", "xx": None, "": None, " ": None, "n/a": None, "?": None, "und": None, "code": None, "french": "fr"}
    df = spark.createDataFrame([*((k,) for k in cases), (None,)], "l string").select("l", L.named_language("l").alias("n"))
    assert {r.l: r.n for r in df.collect()} == cases | {None: None}


def test_operator(spark, model):
    rows = [
        (1, HELD["en"], "en", 0), (2, HELD["en"], "de", 0), (3, f"{HELD['en']} {HELD['fr']}", "en", 0), (4, HELD["ru"], None, 0), (5, None, "en", 0), (6, "", "de", 0), (7, "short text", "de", 0), (8, HELD["zh"] * 3, "Chinese", 0), (1, HELD["en"], "en", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, label int")
    found = L.languages(df, "doc_id", "text", "lang", model).cache()
    assert sorted((r.key, r.lang) for r in L.mislabelled(found).collect()) == [(2, "en"), (3, "en"), (3, "fr"), (4, "ru")]
    seg = {r.key: [(s.lang, s.start, s.end) for s in r.segments] for r in found.collect()}
    n = len(HELD["en"])
    assert seg[3] == [("en", 0, n), ("fr", n + 1, n + 1 + len(HELD["fr"]))] and seg[5] == seg[6] == seg[7] == []
    docs = {r.key: (r.lang, r.share) for r in L.document_language(found).collect()}
    assert docs[2] == ("en", 1.0) and docs[5] == (None, 0.0) and docs[8][0] == "zh"
    assert L.languages(df.limit(0), "doc_id", "text", "lang", model).count() == 0
    assert isinstance(L.fit(df.limit(0), "doc_id", "text", "lang"), L.LanguageModel)


def test_training_bears_wrong_labels(spark):
    wrong = [("de", HELD["en"]), ("en", HELD["ru"]), ("fr", HELD["zh"])] * 5
    m = L.train([("de", "Der Speicher behält eine alte Kopie der Zeilen bis zum nächsten Lauf.")] * 3 + wrong)
    assert [x[0] for x in m.judge([HELD["en"], HELD["ru"], HELD["zh"], HELD["de"]])] == ["en", "ru", "zh", "de"]
