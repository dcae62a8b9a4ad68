"""Texts that make careless patterns run for hours must not take more than a moment."""

import time

import pytest

from lodeworks.llm import codeparse, encode, funcdocs, generated, langid, split

N = 60_000
TEXTS = {
    "letters": "x" * N, "spaces": " " * N, "dots": "." * N + "x", "dashes": "-" * N, "slashes": "a/" * (N // 2), "open": "(" * N, "strays": "(" * (N // 2) + "]" * (N // 2), "digits": "7" * N, "han": "字" * N, "newlines": "\n" * N,
    "quotes": "\"'" * (N // 2), "stars": "*" * N, "minified": "function a(b){return b?1:2}if(a<b){c=d}" * (N // 40), "commas": "a," * (N // 2), "at": "a@" * (N // 2), "equals": "a=" * (N // 2), "dotted": "a.b" * (N // 3), "angles": "a<" * (N // 2),
    "comment": "/*" + " *" * (N // 2), "hashes": "# " * (N // 2), "lines": "# a b c d e f\n" * (N // 14), "brackets": "for (a) [b] (c) {d} = " * (N // 22) + ".", "crlf": "\r\n" * (N // 2), "backticks": "`" * N, "fences": "```\n" * (N // 4), "colons": "a: b " * (N // 5),
}


@pytest.mark.parametrize("name", TEXTS)
def test_moments(name):
    text = TEXTS[name]
    began = time.time()
    split.pieces(text)
    langid.sentences(text)
    for path in ("a.py", "a.js", "a.go", "a.rs", "a.java"):
        codeparse.functions(text, codeparse.language_of(path))
        generated.features(path, text)
        generated.notices(path, text)
        generated.is_constant(path, text)
    funcdocs.telling(text, "name")
    funcdocs.pairs_of("a.py", "f", "function", text, text)
    assert time.time() - began < 20, name


def test_encoding():
    import os

    path = f"{encode.TOKENIZER_DIR}/{encode.BYTE_BPE}"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    e = encode.encoder(path)
    for name, text in TEXTS.items():
        began = time.time()
        assert encode.encode_long(e, text).tolist() == e.ids(text).tolist(), name
        assert time.time() - began < 20, name
