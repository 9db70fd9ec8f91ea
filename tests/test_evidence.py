"""Evidence, manuals, references and ranking."""

from pyspark.sql import functions as F

from scriptoria.operators import evidence as E

DOCS = [
    (1, "README.md", "# Overview\nIt reads rows.\nThen it stops.\n\nUsage: call it\nnow\n## Next"),
    (2, "tests/a.md", "Overview of tests\nmore\nInput files\nhidden"),
    (3, "src/b.md", "An overview that is very much longer than the one in the readme file\nx"),
    (4, None, "The outputs are here"),
    (5, "c.md", None),
    (6, "docs/d.md", ""),
]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id int, path string, text string, section string, rank int")


def test_evidence(spark):
    rows = E.map_evidence(docs(spark), "id", "path", "text").collect()
    got = {(r["section"], r["rank"]): (r["id"], r["line_no"], r["snippet"]) for r in rows}
    assert got["Overview", 1] == (1, 1, "# Overview\nIt reads rows. Then it stops.") and got["Overview", 2][0] == 3
    assert got["How to Run", 1] == (1, 5, "Usage: call it\nnow") and got["Inputs", 1] == (2, 3, "Input files") and got["Outputs", 1] == (4, 1, "The outputs are here")
    assert not any(r["id"] == 2 and r["section"] == "Overview" for r in rows)


def test_top_keeps_the_best_of_a_hot_section(spark):
    rows = [(i, f"f{i}.md", "input " + "w" * (i % 37)) for i in range(500)]
    got = E.map_evidence(docs(spark, rows), "id", "path", "text", top=5).orderBy("rank").collect()
    best = sorted(rows, key=lambda r: (-len(r[2]), r[0]))[:5]
    assert [(r["id"], r["rank"]) for r in got] == [(b[0], k) for k, b in enumerate(best, 1)]
    assert E.map_evidence(docs(spark, []), "id", "path", "text").count() == 0


def test_coverage_and_files(spark):
    found = E.map_evidence(docs(spark), "id", "path", "text", top=None)
    cover = {r["section"]: r for r in E.section_coverage(spark, found).collect()}
    assert len(cover) == 7 and cover["Examples"]["inferred"] and cover["Examples"]["body"] == "[[NEEDS_EXAMPLES]]" and cover["Overview"]["snippets"] == 2
    assert {r["path"]: r["sections"] for r in E.files_by_section(found).collect()}["README.md"] == ["How to Run", "Overview"]


def test_manual_round(spark):
    text = "lost line\nOverview: first\nmore\n\nInputs:\na file\nOverview: again\nNot a title 1: x"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no title")], "id int, t string")
    got = {(r["id"], r["title"]): (r["ord"], r["body"]) for r in E.parse_manual(df, "id", "t").collect()}
    assert got == {(1, "Overview"): (0, "again\nNot a title 1: x"), (1, "Inputs"): (1, "a file")}
    filled = E.infer_missing(E.parse_manual(df, "id", "t"), "id", ["Overview", "Outputs"]).collect()
    assert {(r["title"], r["inferred"]) for r in filled} == {("Overview", False), ("Inputs", False), ("Outputs", True)}
    fallback = df.select("id", E.fallback_sections(F.col("t")).alias("s")).collect()
    assert fallback[0]["s"][0]["body"] == text and fallback[1]["s"][0]["body"] == "No information provided." and fallback[0]["s"][1]["body"].endswith("(inferred)")
    assert df.select(E.missing_sections(F.lit("x [[NEEDS_EXAMPLES]] [[NEEDS_INPUTS]] [[OTHER]]"))).first()[0] == ["Inputs", "Examples"]


def test_references(spark):
    texts = spark.createDataFrame([(1, "See a/b.py, b.py, gone.md and gone.md, x.pyc"), (2, None), (3, "none")], "id int, t string")
    files = spark.createDataFrame([("a/b.py",), (None,)], "path string")
    lost = E.missing_references(texts, "id", "t", files, "path")
    assert [(r["id"], r["ref"]) for r in lost.collect()] == [(1, "gone.md")]
    rows = {r["id"]: r for r in E.annotate_missing(texts, "id", "t", lost).collect()}
    assert rows[1]["t"] == "See a/b.py, b.py, gone.md [missing] and gone.md [missing], x.pyc" and rows[2]["t"] is None and rows[3]["missing_references"] is None


def test_ranking_matches_containment(spark):
    paths = ["src/main.py", "src/util.py", "tests/main.py", "lib/reader.cpp", "a.egg-info/run.py", "doc.txt", "x/version.h", None]
    refs = ["util.py", "src/", "lib/reader.cpp", "LIB/READER.CPP", "py", "", None, "nowhere/x.py"]
    files, patterns = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(r,) for r in refs], "pattern string")
    got = {r["path"]: r["score"] for r in E.rank_files(files, "path", patterns, top=None).collect()}
    kept = ["src/main.py", "src/util.py", "lib/reader.cpp", "x/version.h"]
    distinct = {r.lower() for r in refs if r}
    want = {p: 2 * any(w in p for w in ("run", "main", "cli", "config", "io", "dataset", "reader", "writer", "pipeline")) + sum(r in p for r in distinct) for p in kept}
    assert got == want
    assert [r["path"] for r in E.rank_files(files, "path", patterns, top=2).collect()] == sorted(want, key=lambda p: (-want[p], p))[:2]


def test_sections_of_snippets(spark):
    df = spark.createDataFrame([("a", "Outputs and inputs"), ("b", None), ("c", "nothing")], "path string, text string")
    assert {(r["section"], r["path"]) for r in E.sections_of_snippets(df, "path", "text").collect()} == {("Inputs", "a"), ("Outputs", "a")}
    assert E.sections_of_snippets(df, "path", "text", wanted=[]).count() == 0
