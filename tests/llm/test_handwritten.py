"""Problem 2."""

import random

from scriptoria.llm.handwritten import classify

CODE = "import os\n\n\ndef trim(path, limit=3):\n    \"\"\"Trim a file to its limit.\"\"\"\n    with open(path) as f:\n        lines = f.readlines()\n    return lines[:limit]\n\n\ndef join(parts):\n    return os.sep.join(parts)\n"
UI = "class Form:\n    def setup(self, form):\n" + "".join(f"        self.button_{i}.setGeometry(({i * 7}, {i * 3}, 10, 20))\n        self.button_{i}.setName('button_{i}')\n" for i in range(30))
MIN = "!function(e,t){" + "".join(f'function a{c}(n,r){{return n?r[e]:t}};' for c in "bcdefghijklmnopqrstuvwxyz") + "}();"
TABLE = "ROWS = (\n" + "".join(f"    {{'id': {i * 7919}, 'x': 0.{i:05d}, 'y': {i * 31}}},\n" for i in range(40)) + ")\n"
BLOB = 'export default "' + "".join(random.Random(1).choices("ABCDEFGHabcdefgh0123456789+/", k=3000)) + '";'


def kinds(spark, rows):
    df = spark.createDataFrame(rows, "module_id string, source string, language string, relpath string, kind string, head string")
    return {r["module_id"]: r["kind"] for r in classify(df).collect()}


def test_kinds(spark):
    rows = [
        ("hand", CODE, "python", "src/a.py", "x", "y"),
        ("hand_crlf", CODE.replace("\n", "\r\n"), None, None, "x", "y"),
        ("marker", "# Generated by tool from a.schema. DO NOT EDIT.\n" + CODE, "python", "src/b.py", "x", "y"),
        ("kept", "# Once generated by a script; since 2020 maintained by hand.\n" + CODE, "python", "src/c.py", "x", "y"),
        ("speaks", "# Checks for the code generator: output must start with 'DO NOT EDIT'.\n" + CODE, "python", "src/generator/d.py", "x", "y"),
        ("own", "# Part of this project. Copyright 2020, see LICENSE.\n" + CODE, "python", "src/e.py", "x", "y"),
        ("header", "/*! somelib 2.5.13 */\nfunction a() {\n  return 1;\n}\n", "javascript", "app/f.js", "x", "y"),
        ("folder", CODE, "python", "third_party/somelib/g.py", "x", "y"),
        ("portal", CODE, "python", "vendor_portal/h.py", "x", "y"),
        ("ui", UI, "python", "src/i.py", "x", "y"),
        ("min", MIN, "javascript", "src/j.js", "x", "y"),
        ("table", TABLE, "python", "src/k.py", "x", "y"),
        ("blob", BLOB, "javascript", "src/l.js", "x", "y"),
        ("comment", CODE + "# " + "a long remark on the design of this file " * 9 + "\n", "python", "src/m.py", "x", "y"),
        ("primes", CODE + "PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43]\n", "python", "src/n.py", "x", "y"),
        ("null", None, "python", "src/o.py", "x", "y"),
        ("empty", "", "python", "src/p.py", "x", "y"),
        ("blank", " \r\n\t", "python", "src/q.py", "x", "y"),
    ]
    got = kinds(spark, rows)
    hand = {"hand", "hand_crlf", "kept", "speaks", "own", "portal", "comment", "primes"}
    assert {k for k, v in got.items() if v == "handwritten"} == hand
    assert got["marker"] == "generated" and got["header"] == got["folder"] == "vendored" and got["min"] == "minified" and got["blob"] == "data"
    assert not {"null", "empty", "blank"} & got.keys()


def test_the_longest_run_tells_data(spark):
    short, blob = 'a = "' + "QUJD" * 50 + '";\n', 'export default "' + "QUJDREVG" * 400 + '";'
    rows = [(k, t, "javascript", "src/a.js", None, None) for k, t in (("last", short + blob), ("first", blob + "\n" + short), ("only", blob))]
    assert kinds(spark, rows) == dict.fromkeys(("last", "first", "only"), "data")


def test_long_text_repeats_and_empty_table(spark):
    words = [a + b + c for a in ("trim", "load", "sort", "pack", "read") for b in ("row", "key", "map", "bin", "log", "set") for c in "abcdefghijklmnopqrstuvwxyz"]
    long = "".join(f"def {w}(path):\n    return {w[::-1]}(path, {v})\n\n" for w, v in zip(words, reversed(words))) * 1
    rows = [("a", long, "python", "a.py", None, None)] * 2
    assert kinds(spark, rows) == {"a": "handwritten"}
    assert kinds(spark, []) == {}


def test_small_files_are_judged_too(spark):
    rows = [
        ("blob", 'x = "' + "QUJDREVG" * 12 + '"\n', "python"), ("same", "".join(f"o.set_{i}({i})\n" for i in range(8)), "python"), ("one", "x = 1\n", "python"), ("numbers", ", ".join(str(i * 37) for i in range(30)), "matlab"),
        ("brackets", "[" + "[{}, [], ''], " * 40 + "]", "javascript"), ("least", "}", None), ("two", "int a1;\nint a2;\n", "cpp"),
    ]
    got = kinds(spark, [(k, t, language, "src/a", None, None) for k, t, language in rows])
    assert got == {"blob": "data", "same": "generated", "one": "handwritten", "numbers": "data", "brackets": "minified", "least": "handwritten", "two": "handwritten"}
