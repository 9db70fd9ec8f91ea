"""Sources, pages, lint, cache, summarisation, pipelines, streams and the driver contract."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptoria.functions.vocabulary import MERGE_INSTRUCTIONS
from scriptoria.operators import cache as K
from scriptoria.operators import lint as L
from scriptoria.plans.document import document, module_parts, parse_tree
from scriptoria.plans.manual import code_snippet, scan_code, write_manual
from scriptoria.plans.models import Extractive, HttpModel
from scriptoria.plans.summarise import budget, summarise
from scriptoria.sinks import pages as S
from scriptoria.sources import extract, tree


@pytest.fixture
def project(tmp_path):
    files = {
        "README.md": "# Overview\nThe tool trims rows.\n\nUsage: run main\ncall it with a path\n", "extra.md": "Inputs are files.", "notes.txt": "outputs", "src/pkg/__init__.py": '"""Package."""\n', "src/main.py": '"""Main."""\nimport argparse\n\n\ndef load_file(path):\n    """Loads a file to run."""\n    return trim(path)\n\n\ndef trim(x):\n    return x\n',
        "src/bad.py": "x = 08", "a.m": "% Head\nfunction y = f(x)\nend\n", "docs/page.html": "<h1>Examples</h1><script>no</script><p>one <b>two</b></p><pre>x = 1</pre>", "ignore_me/e.py": "x = 1", ".git/config.py": "x = 1", "c.txt": "no",
    }
    for name, text in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "tree")


def test_scan(spark, project):
    found = {r["relpath"] for r in tree.scan(spark, project, [f"{project}/ignore_me"]).collect()}
    assert found == {"src/pkg/__init__.py", "src/main.py", "src/bad.py", "a.m"}
    every = tree.scan(spark, project, suffixes=[], content=False)
    assert every.where("content is not null").count() == 0 and ".git/config.py" not in {r["relpath"] for r in every.collect()}
    docs = tree.collected(every).select("group", "relpath").orderBy("group", "relpath").collect()
    assert [(r[0], r[1]) for r in docs] == [(0, "README.md"), (1, "extra.md"), (2, "c.txt"), (2, "notes.txt"), (5, "docs/page.html")]
    assert tree.collected(every, tree.FILE_GROUPS).count() == 4 and tree.markdown_files(every).count() == 1
    assert {r["language"] for r in tree.with_language(every).collect()} >= {"python", "matlab", None}


def test_utf8(spark):
    df = spark.createDataFrame([("a", b"ok"), ("b", b"\xff")], "relpath string, content binary")
    good, bad = tree.readable(df)
    assert [r["relpath"] for r in good.collect()] == ["a"] and [r["relpath"] for r in bad.collect()] == ["b"]


def test_extract(spark):
    assert extract.html_text("<h2>A  b</h2>\n<p>one<br>two</p><style>x</style><pre>c\n d</pre>") == "## A b\none\ntwo\n```\nc\nd\n```"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:document>')
    df = spark.createDataFrame([(buffer.getvalue(), ".docx"), (b"<p>x</p>", ".HTML"), (b"raw", ".md"), (b"\xff", ".md"), (None, ".md"), (b"no zip", ".docx")], "c binary, s string")
    assert [r[0] for r in df.select(extract.document_text(F.col("c"), F.col("s"))).collect()] == ["## Head\nab", "x", "raw", "", "", ""]


def test_lint(spark):
    html = "<h2>Class: A</h2><h3>Method: m</h3><h3>f()</h3>\n<p>There are no methods and <b>no classes</b>. You can run.</p>\n<p>pizza pizza weather</p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>you can</p>")], "id int, html string")
    got = {(r["id"], r["kind"], r["detail"]) for r in L.review(df, "id", "html").collect()}
    assert (1, "HALLUCINATION", "pizza") in got and (1, "HALLUCINATION", "weather") in got and not any(g[0] != 1 for g in got)
    assert {g[2] for g in got if g[1] == "CONTRADICTION"} == {"'no methods' stated but found 1", "'no classes' stated but found 1"}
    rows = L.assistant_phrasing(df, "id", "html").collect()
    assert {(r["id"], r["phrase"], r["line"]) for r in rows} == {(1, "you can", -1), (3, "you can", 1)} or {(r["id"], r["phrase"]) for r in rows} == {(1, "you can"), (3, "you can")}
    assert L.rewrite_page("<p>Keeps <i>rows</i>.\nYou can go.</p><p class='x'>You can</p><LI>- no</LI><h3>Head</h3>") == "<p>Keeps rows.</p><p class='x'>You can</p><LI></LI><h3>Head</h3>".replace("LI", "LI")


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert K.open_cache(spark, path).count() == K.open_cache(spark, None).count() == 0
    K.append(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), path)
    K.append(spark.createDataFrame([("a", "3")], "key string, value string"), path)
    cache = K.open_cache(spark, path)
    prompts = spark.createDataFrame([("a", "x"), ("c", "y"), ("c", "y"), (None, "z")], "key string, text string")
    assert [r["key"] for r in K.misses(prompts, cache).collect()] == ["c"]
    assert {r["key"]: r["value"] for r in K.answered(prompts, cache).collect()} == {"a": "3", "c": None, None: None}
    K.compact(spark, path, str(tmp_path / "compact"))
    assert {r["key"]: r["value"] for r in K.open_cache(spark, str(tmp_path / "compact")).collect()} == {"a": "3", "b": "2"}
    todo, done = K.resume(spark.createDataFrame([("p",), ("q",)], "path string"), spark.createDataFrame([("q", "m"), ("r", "m")], "path string, module string"))
    assert [r["path"] for r in todo.collect()] == ["p"] and [r["path"] for r in done.collect()] == ["q"]


class Failing(Extractive):
    """Fails on some parts and never shortens others."""

    def summarise(self, text, kind, system=""):
        if "fail" in text:
            raise RuntimeError("no answer")
        return super().summarise(text, kind)


def test_summaries(spark, tmp_path):
    cache = str(tmp_path / "cache")
    long = "\n\n".join(f"para{i} " + "w " * 30 for i in range(12))
    df = spark.createDataFrame([(1, "short text here"), (2, long), (3, None), (4, "fail"), (5, "short text here")], "id int, text string")
    got = {r["id"]: r["summary"] for r in summarise(df, Failing(words=8), cache_path=cache, context=150, chunk=40).collect()}
    assert got["1"] == got["5"] == "short text here" and got["3"] == got["4"] == "" and got["2"].lstrip("- ").startswith("para0")
    stored = spark.read.parquet(cache).count()
    again = {r["id"]: r["summary"] for r in summarise(df.where("id <> 4"), Extractive(words=1), cache_path=cache, context=150, chunk=40).collect()}
    assert again == {k: v for k, v in got.items() if k != "4"} and spark.read.parquet(cache).count() == stored  # a second run asks nothing
    assert budget("module", 10)[0] == 1 and summarise(df.limit(0), Extractive()).count() == 0


class Distinct:
    """Answers with the distinct words of its text."""

    def summarise(self, text, kind, system=""):
        return " ".join(sorted({w for w in text.removeprefix(MERGE_INSTRUCTIONS).split() if w.isalpha()}))


def test_parts_and_hook(spark):
    df = spark.createDataFrame([(1, "w " * 400, ["alpha " * 30, "", "beta " * 30, "gamma"]), (2, "w " * 400, None), (3, "short", ["x"])], "id int, text string, parts array<string>")
    got = {r["id"]: r["summary"] for r in summarise(df, Distinct(), context=120, chunk=30, after_chunk=str.upper).collect()}
    assert got == {"1": "ALPHA BETA GAMMA", "2": "W", "3": "short"}


def test_module_parts(spark):
    from scriptoria.parsers import modules_of, parse_files, symbols_of

    source = '"""Doc."""\nX = 1\n\n\ndef f():\n    pass\n\n\nclass Big:\n    def m(self):\n        return 1\n\n\nclass Small:\n    pass\n'
    parsed = parse_files(spark.createDataFrame([("m", "python", source)], "module_id string, language string, content string"))
    parts = module_parts(modules_of(parsed), symbols_of(parsed), 4).first()["parts"]
    assert parts == ["Doc.", "def m(self):\n        return 1", "class Small:\n    pass", "X = 1", "def f():\n    pass"]


def test_a_model_that_never_shortens_ends(spark):
    long = "\n\n".join("w " * 30 for _ in range(6))
    df = spark.createDataFrame([(1, long)], "id int, text string")
    assert summarise(df, Extractive(words=10_000), context=130, chunk=40).first()["summary"]


def test_http_model_gives_up():
    model = HttpModel("http://127.0.0.1:9/v1/chat/completions", attempts=2, pause=0, timeout=1)
    assert not model.ping()
    with pytest.raises(RuntimeError):
        model.summarise("x", "module")


def test_documented_project(spark, project, tmp_path):
    out = str(tmp_path / "out")
    done = document(spark, project, Extractive(), out, [f"{project}/ignore_me"])
    assert {r["relpath"] for r in done.modules.collect()} == {"src/pkg/__init__.py", "src/main.py", "a.m"} and [r["module_id"] for r in done.rejects.collect()] == ["src/bad.py"]
    page = (tmp_path / "out" / "src" / "main.html").read_text()
    assert page.startswith(f"<!-- {L.MARKER} -->") and "load_file(path)" in page and (tmp_path / "out" / "index.html").exists()
    assert S.clean_folder(out) == ["a.html", "index.html"]
    assert parse_tree(spark, str(tmp_path / "out"))[0].count() == 0


def test_manual(spark, project):
    sections, evidence = write_manual(spark, project, Extractive())
    got = {r["title"]: r["body"] for r in sections.collect()}
    assert len(got) == 7 and got["Overview"].startswith("# Overview") and got["How to Run"].startswith("Usage") and evidence.count() >= 4
    page = S.manual_pages(sections.withColumn("id", F.lit(1)), "id").first()["html"]
    assert page.count("<h2") == 7 and 'href="#how-to-run"' in page
    assert scan_code(spark, project, []).count() == 0 and scan_code(spark, project, ["How to Run"]).count() >= 1
    assert "load_file(path)" in code_snippet("def load_file(path):\n    pass\n", ".py") and code_snippet("x = 08", ".py") == "x = 08" and code_snippet(None, ".py") == ""
    assert {r["section"] for r in S.evidence_json(spark, evidence).where("json like '%\"inferred\":false%'").collect()} >= {"Overview", "How to Run"}


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([('<div class="sidebar">old</div><p>x</p>', "a$b\\c")], "h string, n string")
    assert df.select(S.replace_sidebar(F.col("h"), F.col("n"))).first()[0] == '<div class="sidebar">a$b\\c</div><p>x</p>'
    one = df.select(S.insert_link(F.lit("<ul><li>a</li></ul>"), "m.html", "Manual").alias("x"))
    assert one.first()[0] == '<ul><li>a</li><li><a href="m.html">Manual</a></li></ul>' and one.select(S.insert_link(F.col("x"), "m.html", "Manual", True)).first()[0] == one.first()[0]
    assert S.wrapped("one two three four five six", 9, 2) == ["one two", "three fo…"[:9]] or len(S.wrapped("one two three four five six", 9, 2)) == 2
    with pytest.raises(Exception, match="leaves the folder"):
        S.write_pages(spark.createDataFrame([("../x.html", "h")], "path string, html string"), str(tmp_path))
    code = spark.createDataFrame([("x = 1", "python"), ("a < b", "nope"), (None, None)], "c string, l string").select(S.highlighted(F.col("c"), F.col("l"))).collect()
    assert "x" in code[0][0] and "&lt;" in code[1][0] and code[2][0] is None


def test_streams(spark, tmp_path):
    from scriptoria.streaming.incremental import latest_deliveries, lint_stream, summarise_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "<h2>Class: A</h2><p>you can</p>", "some text")], "id int, html string, text string").write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema("id int, html string, text string").parquet(source)
    for _ in range(2):
        lint_stream(read(), "id", "html", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
        summarise_stream(read().select("text"), Extractive(), "docstring", str(tmp_path / "cache"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and spark.read.parquet(str(tmp_path / "cache")).count() == 1
    rows = spark.readStream.schema("id int, html string, text string").parquet(source).withColumn("at", F.timestamp_seconds(F.col("id")))
    query = latest_deliveries(rows, "id", "at").writeStream.format("memory").queryName("deliveries").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deliveries").count() == 1


def test_contract(spark, data):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    queries, sql = E.queries(), E.oracle_sql()
    assert sql.keys() <= queries.keys() and len(queries) > 40


def test_sidebars_close_by_depth():
    page = '<div class="sidebar"><div>a<div>b</div></div>c</div><p>x</p>'
    assert S.with_sidebar(page, "new") == '<div class="sidebar">new</div><p>x</p>'
    assert S.with_sidebar('<div class="sidebar"><div>a</div>', "new") == '<div class="sidebar"><div>a</div>' and S.with_sidebar("<p>x</p>", "n") == "<p>x</p>"


def test_outlines_are_condensed_in_waves(spark):
    from scriptoria.plans.document import condensed, joined

    rows = spark.createDataFrame([(f"m{i:03d}", f"module {i} " + "word " * 40) for i in range(60)] + [(None, "lost")], "ord string, text string").where("ord is not null")
    assert condensed(rows, Extractive(), "project", None, 400).count() == 60
    few = condensed(rows, Extractive(), "project", None, 400, most=200)
    assert few.count() < 60 and joined(few, "ord", "text").first()["text"]
    assert condensed(rows.limit(0), Extractive(), "project", None, 400, most=1).count() == 0


def test_corrupt_files_of_a_cache_are_skipped(spark, tmp_path):
    path = str(tmp_path / "cache")
    K.append(spark.createDataFrame([("a", "1")], "key string, value string"), path)
    (tmp_path / "cache" / "part-broken.parquet").write_bytes(b"no parquet")
    assert {r["key"]: r["value"] for r in K.open_cache(spark, path).collect()} == {"a": "1"}


def test_pdfs_and_assets(spark, tmp_path):
    from scriptoria.sinks import pdf as P

    html = "<html><title>T</title><script>no()</script><p>One (1) &amp; two</p><ul>" + "<li>item and more words</li>" * 150 + "</ul></html>"
    assert P.lines_of(html)[:2] == ["T", "One (1) & two"] and "no()" not in "".join(P.lines_of(html))
    data = P.pdf_of(html)
    assert data.startswith(b"%PDF-1.4") and data.rstrip().endswith(b"%%EOF") and b"/Count 3" in data and rb"One \(1\) & two" in data
    start = int(data.rsplit(b"startxref", 1)[1].split()[0])
    assert data[start : start + 4] == b"xref"
    for n, line in enumerate(data[start:].split(b"\n")[3:8], 1):
        assert data[int(line[:10]) :].startswith(f"{n} 0 obj".encode())
    pages = spark.createDataFrame([("a/b.html", html), ("c.html", ""), ("d.html", None), (None, "x")], "path string, html string")
    P.write_pdfs(pages, str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*.pdf")) == ["b.pdf", "c.pdf"]
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "logo.svg").write_text("<svg/>")
    S.write_assets(str(tmp_path), str(tmp_path / "own"))
    assert (tmp_path / "static" / "style.css").read_text() == S.STYLE and (tmp_path / "static" / "logo.svg").exists()
