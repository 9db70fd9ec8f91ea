"""Problem 4."""

import time

import pytest

from scriptoria.llm.functions import functions_of, normalised, pairs, trivial

PY = '"""Module."""\nimport os\n\n@cached\ndef read_rows(path, limit=3):\n    """Read up to a limit of rows.\n\n    :param path: where\n    """\n    def inner(x):\n        "Doubles it."\n        return x\n    return inner\n\nclass A:\n    async def read_it(self):\n        """Read it."""\n    def write(self):\n        """TODO: document this."""\n\ntext = """\ndef fake():\n    \'\'\'Looks real.\'\'\'\n"""\n'
JS = "// /** Old one. */\n// function gone(a) {}\n\n/** Folds the rows. */\nexport async function fold(a, b = {}) {\n  return `\n/** Not code. */\nfunction fake() {}\n`;\n}\n\n// eslint-disable-next-line no-unused-vars\nconst skip = (a) => a;\n\n/* Trims the row\n   at its end. */\nexport const trim = (row) => {\n};\n\n// Labels the row once.\nlet name = async function (row) {\n};\n\n/** Lost. */\n\nfunction apart() {}\n\nclass B {\n  /**\n   * Opens the file once.\n   */\n  @log()\n  static async open(path) {\n  }\n}\n"
JAVA = 'package a;\npublic class C {\n    /** Sorts the map by key. */\n    @Override\n    @SuppressWarnings("unchecked")\n    public Map<String, Integer> sortMap(List<String> keys) throws IOException {\n    }\n    /** @param keys\n        @return\n    */\n    int none(String keys) { return 0; }\n    // NOSONAR\n    void noisy() { }\n    String s = "/** Not a comment. */ void fake() {";\n}\n'
CPP = "#include <v>\nnamespace n {\n/// Packs the rows\n/// without a key.\ntemplate <typename T>\nstatic std::vector<int> pack(const T& row) {\n}\n/* Runs. */\nint run(int a) { return a; }\n}\n"
M = "% Header text.\n\nfunction out = first_one(a)\n% Sums the rows of a.\n% more\nx = 1; % function fake\nend\n\n% Clears the table after use.\nfunction clear_it\nend\nfunction [a, b] = bare(x)\nend\n"


def names(source, language):
    return [(r[0], r[1]) for r in sorted(functions_of(source, language, False, False)) if not trivial(r[5], r[1], r[4])]


def test_languages():
    assert names(PY, "python") == [(5, "read_rows"), (10, "inner")]
    assert names(PY.replace("\n", "\r\n"), "python") == [(5, "read_rows"), (10, "inner")]
    assert names(JS, "javascript") == [(5, "fold"), (17, "trim"), (21, "name"), (33, "open")]
    assert names(JAVA, "java") == [(6, "sortMap")]
    assert names(CPP, "cpp") == [(6, "pack")]
    assert names(M, "matlab") == [(3, "first_one"), (10, "clear_it")]


def test_typescript_types():
    ts = "/** Merges two maps. */\nexport const merge = (a: Map<string, number>, b?: Map<string, number>): Map<string, number> => {\n};\n\nclass D {\n    /** Loads the table lazily. */\n    private load<T>(a: T, b = f(1)): Promise<void> {\n    }\n}\n"
    assert names(ts, "typescript") == [(2, "merge"), (7, "load")]


def test_broken_and_odd_sources():
    assert names("def broken(:\n  '''Doc here.'''\n", "python") == []
    assert names("/* never closed\nfunction f() {", "javascript") == []
    assert names("", "java") == [] and names("/** Doc of it. */", "cpp") == []
    assert names("/** Doc of one. */\n" * 20_000 + "void f() {}", "java") == [(20_001, "f")]


def test_trivial():
    for doc in ("", None, "/** */", "// ---", "/** TODO */", '"""N/A"""', "See above.", "The read rows function.", "Docstring for read_rows.", "Read rows.", "@param path\n@return", "Args:\n    path:\nReturns:\n", "@param value\n@return", "Args:\n    value:\nReturns:\n", ":param value:\n:return:", "@param {int} [value]", "TODO(ann): write docs", "/** @see Other#open */", "{@inheritDoc}", "// CHECKSTYLE:OFF", "See the wiki page on the design of the table reader and of the storage layer below it, and its two appendices.", "Same as in io/reader.py."):
        assert trivial(doc, "read_rows", "path, limit"), doc
    for doc in ("Reads rows lazily.", "Never blocks, never throws.", "Compare the rows in order.", "Same as read_all, but only rows with a key are kept and all others are counted and reported.", "See whether a row is kept.", "Like a queue of rows.", "Читает строки.", "@param path where the rows lie"):
        assert not trivial(doc, "read_rows", "path, limit"), doc


def test_signatures():
    assert normalised("const std::string& a, int b = 3", "cpp") == normalised("std::string name, int", "cpp") == "std::string,int"
    assert normalised("a, b = f(1, 2)", "python") == "_,_" and normalised("void", "cpp") == ""


def test_declarations_and_defined_cases(spark):
    header = "namespace n {\nclass T {\npublic:\n    /** Opens the table for reading. */\n    int open(const std::string& path);\n    /** Opens it by number. */\n    int open(int id);\n};\n}\n"
    body = "int n::T::open(const std::string& p) {\n    return 1;\n}\n"
    rows = [
        ("h", "p1", "cpp", "t.h", header), ("c", "p1", "cpp", "t.cpp", body), ("other", "p2", "cpp", "t.cpp", body), ("py", None, None, "a.py", PY), ("py", None, None, "a.py", PY),
        ("null", "p1", "cpp", "x.cpp", None), ("none", "p1", None, None, PY), ("empty", "p1", "java", "e.java", ""), (None, "p1", "python", "z.py", PY),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "module_id string, project string, language string, relpath string, source string, kind string, lineno int")
    got = {(r["module_id"], r["name"], r["documented_at"]): r["docstring"] for r in pairs(df).collect()}
    assert got["c", "open", "declaration"] == "Opens the table for reading."
    assert not any(k[0] in ("other", "null", "none", "empty", "h") for k in got)
    assert sum(k[0] == "py" for k in got) == 2 and sum(k[0] is None for k in got) == 2
    assert pairs(df.limit(0)).count() == 0
    slim = {(r["module_id"], r["lineno"], r["name"], r["documented_at"]) for r in pairs(df, bodies=False).collect()}
    assert slim == {(r["module_id"], r["lineno"], r["name"], r["documented_at"]) for r in pairs(df).collect()}


def test_overloads_of_separate_files(spark):
    header = "namespace n {\nclass T {\npublic:\n    /** Opens the table for reading. */\n    int open(const std::string& path);\n    /** Finds a table by its number. */\n    int open(int id);\n    int close();\n};\n}\n"
    body = "int n::T::open(int number) {\n    return 1;\n}\n\nint n::T::open(const std::string& p) {\n    return 2;\n}\n// Closes what was opened before.\nint n::T::close() {\n    return 3;\n}\nint n::T::size() {\n    return 4;\n}\n"
    df = spark.createDataFrame([("h", "p", "cpp", "t.h", header), ("c", "p", "cpp", "t.cpp", body)], "module_id string, project string, language string, relpath string, source string")
    got = {(r["module_id"], r["lineno"]): (r["docstring"], r["documented_at"]) for r in pairs(df).collect()}
    assert got == {("c", 1): ("Finds a table by its number.", "declaration"), ("c", 5): ("Opens the table for reading.", "declaration"), ("c", 9): ("Closes what was opened before.", "definition")}


UNITS = {
    "cpp": "namespace n {\nclass T {\npublic:\n    /** Opens the table for reading. */\n    int open(const std::string& path) {\n        return call(path);\n    }\n};\n}\n",
    "typescript": "class A {\n  /** Opens the file once. */\n  open(path) {\n    return () => { call(path); };\n  }\n}\n",
    "python": 'class A:\n    def open(self, x):\n        """Reads lazily."""\n        return x\n\n',
    "matlab": "function out = open(a)\n% Sums the rows of a.\nx = 1;\nend\n\n",
}


@pytest.mark.parametrize("language", UNITS)
def test_a_file_of_five_megabytes(language):
    copies = 5_000_000 // len(UNITS[language])
    began = time.time()
    assert sum(r[1] == "open" and r[5] is not None for r in functions_of(UNITS[language] * copies, language, True, True)) == copies
    assert time.time() - began < 20
