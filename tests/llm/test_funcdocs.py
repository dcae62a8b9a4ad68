import pytest

from lodeworks.llm import codeparse, funcdocs


@pytest.mark.parametrize(
    ("doc", "name", "fine"),
    [
        ("Load the stored offsets per branch", "load_offsets", True), ("loads rows", "f", False), ("TODO", "f", False), ("TODO: write the documentation for this function later", "f", False),
        ("Read all rows of the table. TODO: negative sizes", "f", True), ("lee todo el archivo en la memoria", "f", True), ("Documentation missing, please add some text here", "f", False),
        ("This is the resolve layer method.", "resolve_layer", False), ("Function to align segment metric.", "alignSegmentMetric", False), ("pylint: disable=too-many-branches,too-many-locals and more words", "f", False),
        ("Licensed under the terms found in the LICENSE file of this project.", "f", False), ("rows = loadRows(path);\nrows.sort();", "f", False), ("Args:\n    rows: the rows to read now\n    limit: how many of them", "f", False),
        ("@param {Array} rows the many rows of it\n@returns {Array}", "f", False), ("Rebuild it all from disk.\n\nArgs:\n    rows: x", "f", True), ("索引服务会跳过大于千字节的源文件。", "f", True), ("待补充", "f", False), ("# Arguments", "f", False),
        ("документация будет добавлена позже, пока пусто", "f", False), ("Индексатор хранит устаревшую копию строк на диске", "f", True), ("", "f", False), (None, "f", False), ("......", "f", False), ("created 2025-03-04", "f", False),
        ('"""The call graph loader keeps an old copy."""', "f", True), ("{@inheritDoc}", "f", False), ("n/a", "f", False), ("Auto-generated method stub, to be filled in later", "f", False),
    ],
)
def test_what_says_something(doc, name, fine):
    assert funcdocs.telling(doc, name) is fine


PYTHON = '''
# Above a decorated one, directly and at length.
@cached
def first(a, b=(1, 2)):
    """TODO"""
    def inner():
        # Head of the inner body says things.
        return "def fake(): pass"
    return a

# not directly above, a blank line between

class K:
    async def second(self):
        r"""Second does this: read the rows of a table."""
'''
OTHERS = {
    "x.js": ("/**\n * Reads all rows of the table.\n * @param {x} y\n */\nexport default async function one(a) {\n  if (a) { return two(b); }\n}\n// Says what the arrow does here.\nconst three = async (a, b) => {\n  'function four() {}';\n};\nclass Q {\n  // Says what the method does here.\n  static async five(a: number): Promise<void> {\n    // rows\n  }\n}\n", ["one", "three", "five"]),
    "x.ts": ("watch(rows: Row[], limit) {\n  // Begins with a comment of five words.\n  for (const x of rows) { go(x); }\n  return rows;\n}\n", ["watch"]),
    "x.go": ("package a\n\n// Merge does this: merges both lists by weight.\nfunc (s *Store) Merge(rows []Row) []Row {\n\treturn f(`func Fake() {`)\n}\nfunc bare() {}\n", ["Merge"]),
    "x.rs": ("/// Walk the parent links of the tree.\n#[inline]\npub(crate) fn walk<'a>(x: &'a str) -> Vec<u8> {\n    let c = '{'; vec![]\n}\nfn plain();\n", ["walk"]),
    "X.java": ("/** Returns one page of the results. */\n@Override\n@Deprecated\npublic List<Map<String, Row>> page(List<Row> rows, int n) throws IOException {\n    if (rows == null) { return List.of(); }\n    return call(rows);\n}\n", ["page"]),
}


def found(path, text, name=None, kind="lines", doc=None):
    return [p[0] for p in funcdocs.pairs_of(path, name, kind, doc, text)]


def test_python_trees_and_fragments():
    assert found("a.py", PYTHON) == ["first", "inner", "second"]
    assert found("a.py", PYTHON + "\n  broken (") == ["first", "inner", "second"]
    assert found("a.py", PYTHON.replace("\n", "\r\n")) == ["first", "inner", "second"]
    assert found("a.py", "    def m(self):\n        '''Reads every row of the table.'''\n") == ["m"]
    assert found("a.py", 'def cut(a):\n    """Begins to say what it does but is cut') == ["cut"]


@pytest.mark.parametrize("path", OTHERS)
def test_other_languages(path):
    text, names = OTHERS[path]
    assert found(path, text) == names
    parsed = {f.name for f in codeparse.functions(text, codeparse.language_of(path))}
    assert set(names) <= parsed and not parsed & {"if", "for", "Fake", "fake", "four", "two", "go", "call", "f"}


def test_columns_and_kinds():
    code = "def f(a):\n    return a\n"
    assert found("a.py", code, "K.f", "Function", "Reads every row of the table") == ["f"]
    assert found("a.py", code, "f", "lines", "Reads every row of the table") == []
    assert found("a.py", code, "f", "class", "Reads every row of the table") == []
    assert found("a.md", "def f", "f", "section", "Reads every row of the table") == []
    assert found("a.py", None, "f", "function", "Reads every row of the table") == []
    assert found(None, code) == [] and found("a\\b\\.\\c.PY", code, "f", "method", "Reads every row of the table") == ["f"]
    pair = funcdocs.pairs_of("a.go", "Go", "function", None, "\n// Go does what five words say.\nfunc Go() {\n}\n")[0]
    assert pair == ("Go", "Go does what five words say.", "func Go() {\n}", 3, 4)


def test_operator(spark):
    rows = [("1", "a.py", "f", "function", "Reads every row of the table", "def f(): pass", "x"), ("2", "a.py", None, None, None, None, "x"), ("1", "a.py", "f", "function", "Reads every row of the table", "def f(): pass", "x"), ("3", "a.js", "", "lines", "", "(" * 20000, "x")]
    df = spark.createDataFrame(rows, "k string, p string, n string, kd string, d string, t string, symbol_name string")
    got = funcdocs.code_pairs(df, "k", "p", "n", "kd", "d", "t").collect()
    assert [(r.key, r.symbol_name, r.code) for r in got] == [("1", "f", "def f(): pass")] * 2
    assert funcdocs.code_pairs(df.limit(0), "k", "p", "n", "kd", "d", "t").count() == 0


@pytest.mark.parametrize(
    ("lang", "code", "names"),
    [
        ("rust", "impl A {\n    /// Makes one.\n    pub fn new(a: u8) -> Self {\n        A { a }\n    }\n    fn of() {}\n}\n", ["new", "of"]),
        ("go", "// new makes a store of the given size.\nfunc new(n int) *Store {\n\tif (n > 0) {\n\t\treturn nil\n\t}\n}\nfunc (s *Store) delete(k string) {\n}\n", ["new", "delete"]),
        ("java", "class A {\n    static A of(int a) {\n        if (a > 0) {\n            return new A(a);\n        } else if (a < 0) {\n        }\n        synchronized (this) {\n        }\n    }\n    void delete(String k) {\n    }\n}\n", ["of", "delete"]),
        ("js", "class A {\n  delete(k) {\n    if (k) {\n    }\n    for (const x of k) {\n    }\n    switch (k) {\n      case (1): {\n      }\n    }\n    return (x: string): number => {\n    };\n  }\n  static of(a) {\n  }\n  import(p) {\n    import(p).then(() => {\n    });\n  }\n  return(v) {\n  }\n  static for(k) {\n  }\n}\n", ["delete", "of", "import", "return", "for"]),
    ],
)
def test_words_of_other_languages_name_functions(lang, code, names):
    assert [f.name for f in codeparse.functions(code, lang)] == names


@pytest.mark.parametrize(
    ("doc", "fine"),
    [
        ("Suppress duplicate warnings before they reach the log", True), ("// Region of the map that holds all open cells", True), ("Insert text at the cursor and move it on", True),
        ("Replace the text between two markers by another", True), ("Write the description of each row into the index", True), ("Reads the licence file of a package into memory", True),
        ('SuppressWarnings("unchecked") because the cast is safe here', False), ("//#region Helpers of the cache and of the index", False), ("Add a description for this function here, please, before the next release.", False),
        ("Insert text here later when ready, please, for this method", False), ("See the LICENSE file for all details of the terms", False), ("license that can be found in the LICENSE file of this tree", False),
    ],
)
def test_notes_and_placeholders_need_their_syntax(doc, fine):
    assert funcdocs.telling(doc, "f") is fine
