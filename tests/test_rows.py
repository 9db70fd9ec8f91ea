"""Queries without SQL against plain Python over the same tables."""

import ast
import re
import warnings
from xml.etree import ElementTree

import pandas as pd
import pytest

from scriptoria import queries
from scriptoria.functions.sanitize import sanitize_text
from scriptoria.operators.chunking import chunks_of
from scriptoria.plans.models import Extractive
from scriptoria.plans.summarise import budget


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def frame(data, name, *columns):
    return pd.read_parquet(f"{data}/{name}.parquet", columns=list(columns))


@pytest.fixture(scope="module")
def sources(data):
    m = frame(data, "modules", "module_id", "language", "relpath", "source").drop_duplicates("module_id")
    return m[m["source"].notna()].set_index("module_id")


def parses(source):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source)
        except (SyntaxError, ValueError):
            return None


def is_python(row):
    return (row.relpath or "").endswith(".py")


def test_every_query_is_checked():
    checked = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert queries.QUERIES.keys() - queries.SQL.keys() <= checked


def test_parse_rejects(spark, data, sources):
    got = {r["module_id"] for r in rows(spark, data, "parse_rejects")}
    python = sources[[is_python(r) for r in sources.itertuples()]]
    assert {i for i in python.index if parses(python.source[i]) is None} == got & set(python.index)
    assert not got - set(sources.index)


def test_parsed_modules(spark, data, sources):
    got = {r["module_id"]: r for r in rows(spark, data, "parsed_modules")}
    rejected = {r["module_id"] for r in rows(spark, data, "parse_rejects")}
    assert not got.keys() & rejected and got.keys() | rejected <= set(sources.index)
    trees = {r.Index: parses(r.source) for r in sources.itertuples() if is_python(r)}
    trees = {i: t for i, t in trees.items() if t is not None}
    assert len(trees) > 20 and trees.keys() <= got.keys()
    for i, tree in trees.items():
        assert (got[i]["module_docstring"] or "") == (ast.get_docstring(tree) or ""), i


def test_parsed_symbols(spark, data, sources):
    got = {}
    for r in rows(spark, data, "parsed_symbols"):
        got.setdefault(r["module_id"], []).append(r)
    seen = 0
    for r in sources.itertuples():
        tree = parses(r.source) if is_python(r) else None
        if tree is None:
            continue
        functions = [(x.name, x.lineno) for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        classes = [x for x in tree.body if isinstance(x, ast.ClassDef)]
        methods = [(x.name, x.lineno) for c in classes for x in c.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        mine = [s for s in got.get(r.Index, []) if s["parent_id"] is None]
        assert sorted(functions) == sorted((s["name"], s["lineno"]) for s in mine if s["kind"] == "function"), r.Index
        assert sorted((c.name, c.lineno) for c in classes) == sorted((s["name"], s["lineno"]) for s in mine if s["kind"] == "class"), r.Index
        inner = sorted((s["name"], s["lineno"]) for s in got.get(r.Index, []) if s["kind"] == "method")
        assert set(methods) <= set(inner), r.Index
        seen += len(functions) + len(methods)
    assert seen > 100
    # in the other languages a symbol's name stands in its line
    for i, symbols in got.items():
        lines = sources.source[i].splitlines()
        assert all(s["name"] in lines[s["lineno"] - 1] for s in symbols if s["lineno"] and s["kind"] in ("function", "class") and not is_python(sources.loc[i])), i


def test_limited_document_chunks(spark, data):
    texts = frame(data, "documents", "doc_id", "text").drop_duplicates("doc_id").set_index("doc_id").text
    got = {}
    for r in sorted(rows(spark, data, "limited_document_chunks"), key=lambda r: (r["doc_id"], r["pos"])):
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for i, text in texts.items():
        text = text if isinstance(text, str) else ""
        chunks = got.get(i, [])
        assert "".join("".join(chunks).split()) == "".join(text.split()), i
        assert all(len(c.split()) <= 150 or len(c) <= 900 for c in chunks), i
        # greedy: neither two neighbours nor a chunk and the next paragraph would have fitted together
        whole = {p.strip() for p in re.split(r"\n{2,}", text.strip())}
        for a, b in zip(chunks, chunks[1:]):
            first = re.split(r"\n{2,}", b)[0]
            if first in whole and all(p in whole for p in re.split(r"\n{2,}", a)) and len(first) <= 900 and len(first.split()) <= 150:
                assert len(a) + 2 + len(first) > 900 or len(a.split()) + len(first.split()) + a.count("\n\n") + 1 > 150, i


def test_annotated_sections(spark, data):
    s = frame(data, "manual_sections", "section_id", "body").drop_duplicates("section_id").set_index("section_id").body
    names = {p for p in frame(data, "modules", "relpath").relpath.dropna()}
    names |= {p.rpartition("/")[2] for p in names}
    reference = re.compile(r"(?<!\w)\w[\w./-]*\.(?:py|m|md|rst|txt|json|yaml|yml|csv)(?!\w)")
    want = {}
    for i, body in s.dropna().items():
        missing = {x for x in reference.findall(body)} - names
        if missing:
            want[i] = len(missing)
    got = {r["section_id"]: r for r in rows(spark, data, "annotated_sections")}
    assert {i: r["missing"] for i, r in got.items()} == want and want
    for i, r in got.items():
        assert r["body"].replace(" [missing]", "") == s[i].replace(" [missing]", "") and r["body"].count(" [missing]") >= 1


def test_rewritten_pages(spark, data):
    before = {r["section_id"]: r["html"] for r in queries.corpus._pages(spark, data).collect()}
    tags = re.compile(r"<(p|li|h[1-6])>(.*?)</\1>", re.S | re.I)
    for r in rows(spark, data, "rewritten_pages"):
        want = tags.sub(lambda m: f"<{m[1]}>{sanitize_text(re.sub('<[^>]+>', '', m[2]))}</{m[1]}>", before[r["section_id"]])
        assert r["html"] == want


def test_call_drawings(spark, data):
    placed = {}
    for r in rows(spark, data, "call_positions"):
        placed.setdefault(r["scope"], {})[r["qualname"]] = r
    edges = {}
    for r in rows(spark, data, "call_edges"):
        edges.setdefault(r["module_id"], set()).add((r["source"], r["target"]))
    got = {r["scope"]: r["svg"] for r in rows(spark, data, "call_drawings")}
    assert got.keys() == placed.keys()
    for scope, svg in got.items():
        root = ElementTree.fromstring(svg)
        ns = {"s": "http://www.w3.org/2000/svg"}
        assert len(root.findall(".//s:rect", ns)) == len(placed[scope])
        assert len(root.findall(".//s:line", ns)) == sum(a in placed[scope] and b in placed[scope] for a, b in edges.get(scope, ()))


def test_document_summaries(spark, data):
    """Texts that fit are asked once, whole; of longer ones every part is, and what is left of it comes from their answers."""
    texts = frame(data, "documents", "doc_id", "text").drop_duplicates("doc_id").set_index("doc_id").text
    model, (available, size) = Extractive(), budget("docstring", 160, 60)
    got = {int(r["id"]): r["summary"] for r in rows(spark, data, "document_summaries")}
    assert got.keys() == set(texts.index)
    long = 0
    for i, text in texts.items():
        text = text if isinstance(text, str) else ""
        if len(text.split()) <= available:
            assert got[i] == (model.summarise(text, "docstring") or ""), i
        else:
            long += 1
            answers = " ".join(model.summarise(c, "docstring") for c in chunks_of(text, size))
            assert set(re.findall(r"\w+", got[i])) <= set(re.findall(r"\w+", answers + " " + text)), i
    assert long > 3
