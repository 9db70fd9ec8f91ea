"""Parsers of source files."""

import io
import zipfile

import pytest

from scriptoria import parsers as P
from scriptoria.parsers import simulink

PY = '''"""Module doc."""
import os
LIMIT: int = 3

def outer(a, b, /, c=1, *, d: int = 2, **kw) -> None:
    """Outer doc."""
    helper(inner(os.path.join("x")), key=deep.call())
    self_call().method()
    "sep".join(kw)
    def inner(z): return later()
    class Local:
        def m(self): pass

class A(Base):
    """A doc."""
    class Nested:
        pass
    async def run(self, *args):
        super().run()
        class InRun:
            pass

if __name__ == "__main__":
    outer(1, 2)
'''
CPP = "// Module note\n// goes on\n\nnamespace app {\n/** A box.\n * Holds things. */\nclass Box {\n    int hidden;\npublic:\n    // Width in cells.\n    int width;\n    int area() {\n        return width;\n    }\nprivate:\n    int gone() {\n    }\n};\n\nint main(int argc) {\n    if (argc) {\n    }\n    return 0;\n}\n}\n"
JAVA = "package a.b;\n\n/* Doc. */\npublic class C {\n    public int size;\n    int hidden;\n    public void empty() {}\n    public int get(int i) {\n        return i;\n    }\n}\n"
JS = "/**\n * Module doc.\n */\nimport x from 'y';\n\n// Adds.\nexport async function add(a, b) {\n  return a + b;\n}\nconst mul = (a, b) => a * b;\nlet one = x => x;\nvar expr = function (q) {\n};\nclass K extends L {\n  count = 0;\n  /* Runs. */\n  static async run(n) {\n    go();\n  }\n}\nstate = 5;\n"
TS = "export const typed = (a: number, b: string): string => {\n  return b;\n};\nfunction plain(x: number): void {\n}\nexport class T {\n  private n: number = 0;\n  constructor(n: number) {\n  }\n}\n"
M = "% Head one\n% Head two\n\n% Adds.\nfunction [s, t] = add(a, b)\ns = a + b;\nend\nfunction plain(x; y)\nend\n"


def rows(language, source):
    parsed, error = P.parse_one("f", language, source)
    assert error is None
    return parsed.module, {(s["kind"], s["qualname"]): s for s in parsed.symbols}, parsed.symbols


def test_python():
    module, s, every = rows("python", PY)
    assert module["module_docstring"] == "Module doc."
    outer = s["function", "outer"]
    assert outer["signature"] == "outer(a, b/, c=1, *, d: int=2, **kw) -> None" and outer["docstring"] == "Outer doc." and outer["lineno"] == 5
    assert outer["calls"] == ["helper", "inner", "os.path.join", "deep.call", "self_call.method", "sep.join"]
    assert s["function", "outer.inner"]["parent_id"] == outer["symbol_id"] and ("method", "outer.Local.m") in s
    assert s["method", "A.run"]["calls"] == ["super.run"] and ("class", "A.Nested") in s
    assert sum(r["qualname"] == "A.run.InRun" for r in every) == 2  # under the method and again under the class
    kinds = {r["name"]: (r["kind"], r["stmt_kind"]) for r in every if r["stmt_kind"]}
    assert kinds == {"import os": ("statement", "import"), "LIMIT": ("variable", "annotated assignment"), "if __name__ == '__main__'": ("statement", "if statement")}


def test_cpp():
    module, s, _ = rows("cpp", CPP)
    assert module == {"module_docstring": "Module note\ngoes on", "namespace": "app"}
    assert s["class", "Box"]["docstring"].startswith("A box.") and s["variable", "Box.width"]["vartype"] == "int" and s["variable", "Box.width"]["docstring"] == "Width in cells."
    assert s["method", "Box.area"]["signature"] == "int area()" and ("method", "Box.gone") not in s and ("variable", "Box.hidden") not in s and ("function", "main") in s


def test_java():
    module, s, _ = rows("java", JAVA)
    assert module["package"] == "a.b" and s["class", "C"]["docstring"] == "Doc." and s["variable", "C.size"]["vartype"] == "int"
    assert s["method", "C.empty"]["signature"] == "public void empty()" and s["method", "C.get"]["source"].count("\n") == 2 and ("variable", "C.hidden") not in s
    assert P.parse_one("f", "java", "myclass y\n")[1].startswith("SyntaxError")


def test_scripts():
    module, s, _ = rows("javascript", JS)
    assert module["module_docstring"] == "Module doc." and s["function", "add"]["docstring"] == "Adds."
    assert {n: s["function", n]["signature"] for n in ("mul", "one", "expr")} == {"mul": "mul(a, b)", "one": "one(x)", "expr": "expr(q)"}
    assert s["method", "K.run"]["docstring"] == "Runs." and ("variable", "K.count") in s and ("variable", "state") in s
    _, s, _ = rows("typescript", TS)
    assert s["function", "plain"]["signature"] == "function plain(x: number): void" and s["function", "typed"]["signature"] == "typed(a: number, b: string)" and ("method", "T.constructor") in s


def test_matlab():
    module, s, _ = rows("matlab", M)
    assert module == {"header": "Head one\nHead two\n\nAdds."} or module["header"].startswith("Head one\nHead two")
    assert s["function", "add"]["args"] == ["a", "b"] and s["function", "plain"]["args"] == ["x", "y"] and s["function", "add"]["source"].endswith("end")


def test_simulink():
    xml = '<Model xmlns="u" Name="M"><System><Block Name="C" BlockType="Constant"><P Name="Value">3</P><P Name="Empty"> </P></Block><Block BlockType="Gain"/><Line><Src xmlns="" Block="C" Port="1"/><Dst xmlns="" Block="G" Port="2"/></Line></System></Model>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("simulink/BlockDiagram.xml", xml)
    parsed, error = P.parse_one("f", "simulink", buffer.getvalue(), ".slx")
    assert error is None
    model = parsed.module["model"]
    assert model["name"] == "M" and [b["name"] for b in model["blocks"]] == ["C", "Unnamed block"] and model["blocks"][0]["parameters"] == [{"name": "Value", "value": "3"}] and model["connections"] == [{"source": "C:1", "target": "G:2"}]
    assert "- C [Constant] (Value=3)" in parsed.module["module_docstring"] and "- C:1 -> G:2" in parsed.module["module_docstring"]
    mdl = 'Model {\n Name "N"\n Block {\n  BlockType "Gain"\n  Name "G"\n  Gain "2"\n }\n}\n'
    assert simulink.from_text(mdl) == {"name": "N", "blocks": [{"name": "G", "type": "Gain", "parameters": [{"name": "Gain", "value": "2"}]}], "connections": []}
    for content, suffix in ((b"no zip", ".slx"), (b"", ".txt")):
        assert P.parse_one("f", "simulink", content, suffix)[1]


@pytest.mark.parametrize("language", ["python", "cpp", "java", "javascript", "typescript", "matlab"])
def test_odd_files(language):
    for source in ("", "\n\n", "{", "/* open", "}" * 50, "x" * 200_000):
        P.parse_one("f", language, source)


def test_operator(spark):
    rows = [("a", "python", PY), ("a", "python", PY), ("b", "python", "x = 08"), ("c", None, PY), ("d", "java", None), ("e", "cpp", ""), (None, "python", "x = 1"), ("f", "cobol", "x")]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "module_id string, language string, content string, symbols string, ok boolean")
    parsed = P.parse_files(df)
    assert {r["module_id"] for r in P.rejects_of(parsed).collect()} == {"b", "c", "d", "f"} and P.modules_of(parsed).count() == 4
    assert P.symbols_of(parsed).where("module_id = 'a' and qualname = 'outer'").count() == 2 and P.parse_files(df.limit(0)).count() == 0
    binary = spark.createDataFrame([("u", "python", b"\xff\xfe\xfd")], "module_id string, language string, content binary")
    assert P.rejects_of(P.parse_files(binary)).first()["error"].startswith("UnicodeDecodeError")


def test_places_among_siblings_at_any_size():
    parsed, _ = P.parse_one("m", "python", "".join(f"class C{i}:\n    def a(self): pass\n    def b(self): pass\n" for i in range(900)))
    assert len(parsed.symbols) == 2700
    assert [s["ord"] for s in parsed.symbols if s["kind"] == "class"] == list(range(900))
    assert {(s["name"], s["ord"]) for s in parsed.symbols if s["kind"] != "class"} == {("a", 0), ("b", 1)}
