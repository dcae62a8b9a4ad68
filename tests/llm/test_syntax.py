import pytest

from lodeworks.llm import codeparse
from lodeworks.llm.syntax import Parser

CASES = [
    ("js", "class A extends B {\n  static async go<T>(x: T): Promise<T> {\n    return x;\n  }\n}\nexport const f = async (a, { b } = {}) => {\n  g(a);\n};\nconst k = x =>\n  x + 1;\nif (a) {\n  b();\n}\nfunction* each() {}", ["go", "f", "k", "each"], {"A"}),
    ("go", "type Row struct {\n\tid int\n}\nfunc (r *Row) Get(key string) (interface{}, error) {\n\treturn nil, nil\n}\nfunc Map[K any, V any](f func(K) V) map[string]interface{} {\n\treturn nil\n}", ["Get", "Map"], {"struct"}),
    ("rust", "impl<T> Store<T> {\n    pub(crate) const unsafe fn get<F: Fn(T) -> u8>(&self, f: F) -> u8 {\n        f(self.x)\n    }\n}\ntrait Reader {\n    fn read(&self) -> usize;\n}", ["get", "read"], {"T", "Reader"}),
    ("java", "public class Store<T> {\n  @Override\n  public Map<String, List<T>> rows(int limit) throws IOException {\n    return load(limit);\n  }\n  Store(int n) {}\n  private Store() { }\n  abstract int size();\n  int[] ids(int... a) { return a; }\n}", ["rows", "Store", "size", "ids"], {"Store"}),
]


@pytest.mark.parametrize(("lang", "text", "names", "classes"), CASES)
def test_function_and_class_nodes(lang, text, names, classes):
    tree = Parser(text, lang).tree()
    functions = [n for n in tree.walk() if n.kind == "function"]
    assert [n.name for n in functions] == names
    assert {n.name if n.name not in ("{", "") else lang for n in tree.walk() if n.kind == "class"} >= (classes - {"struct", "T"})
    for n in functions:
        assert n.name in text[n.start : n.end] and (n.body < 0 or text[n.body - 1] == "{")
        assert text[n.end - 1] in "};1"


def test_children_lie_within_their_parents():
    text = "function a() {\n  function b() {\n    if (x) {\n    }\n  }\n}\nfunction c() {"
    tree = Parser(text, "js").tree()
    assert [n.name for n in tree.children] == ["a", "c"]
    assert [n.name for n in tree.children[0].walk() if n.kind == "function"] == ["b"]
    assert tree.children[1].end == len(text)
    for n in tree.walk():
        assert all(n.start <= c.start and c.end <= n.end for c in n.children)


@pytest.mark.parametrize("text", ["", "}", ")]}", "{" * 5000, "func", "func (", "fn", "pub(", "@", "const a =", "export", "a<b<c<d", "class"])
@pytest.mark.parametrize("lang", ["js", "go", "rust", "java"])
def test_fragments_break_nothing(lang, text):
    assert all(n.kind != "function" for n in Parser(text, lang).tree().walk())


def test_a_header_over_several_lines_is_one_function():
    text = "@Override\npublic List<Row> rank(\n    int a,\n    int b\n) {\n}"
    assert [f.name for f in codeparse.functions(text, "java")] == ["rank"]
    assert [f.name for f in codeparse.functions("function\n d(k, o) { return k }", "js")] == ["d"]


def test_indented_python_is_parsed():
    text = '    @cached\n    def load(self, rows):\n        """Loads all the rows of the table é."""\n        return {\n    "a": 1}\n\n    def save(self):\n        # keeps every row for the next run\n        pass\n'
    found = codeparse.functions(text, "python")
    assert [(f.name, text[f.start : f.start + 8]) for f in found] == [("load", "def load"), ("save", "def save")]
    assert found[0].docs == ["Loads all the rows of the table é."] and text[: found[0].end].endswith('"a": 1}') and text[: found[1].end].endswith("pass")
