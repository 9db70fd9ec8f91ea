"""Problem 1."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scriptoria.llm.phrases import Classifier, Patterns, literals
from scriptoria.llm.residue import KINDS, classify, described_sections, judge, masked, prose, residue, train
from scriptoria.llm.templates import WILDCARD, Leaf, judged_lines

RESIDUE = [
    "To start {{ name }}, open a shell.", "Welcome to [YOUR TOOL]!", "[[NEEDS_OVERVIEW]]", "TODO: describe what your project does (max. 50 words)", "lorem ipsum dolor sit amet",
    "Sample text. Sample text.", "HTTP 502 - Bad Gateway. Request id: 12ab9.", "# Not Found", "Access denied. Incident 77.", "You need to enable JavaScript to run this app.",
    "Your browser does not support scripts or it is switched off.", "This page requires JS.", "Traceback (most recent call last):\n  File \"a.py\", line 3, in f", "Coming soon...", "XXXX", "Die angeforderte Seite wurde leider nicht gefunden.",
    "A sound start. ${HOME_DIR}", '{"error": {"code": 503, "message": "Service Unavailable"}}',
]
SOUND = [
    "The server answers 404 Not Found when the id is unknown.", "Slots such as `{{ name }}` are filled when a page is rendered.", "Enable JavaScript in the viewer if you want to pan the call graph.",
    "Access is denied to accounts without a signed token.", "    java -jar tool.jar [options] <source-dir>", "```sh\npython a.py --input <file>\n```", "The linter lists every TODO it finds in a.py.",
    "A filler generator writes lorem ipsum paragraphs into the fixtures.", "Set `TOOL_HOME`, then call `tool run`.", "Run `make all` and wait.",
]


MORE_RESIDUE = [
    "We'll be right back.", "Sorry, this page isn't available.", "Error establishing a database connection", "Describe your project here.", "Add a short description here", "JavaScript must be enabled", "Please enable cookies and JavaScript",
    "An error has occurred.", "Service temporarily unavailable", "404 page not found", "The requested URL was not found on this server.", "This section is under construction.", "Content coming soon", "JavaScript is required to view this page.",
    "This site requires JavaScript to be enabled.", "Loading, please wait...", "Diese Seite benötigt JavaScript.", "Segmentation fault (core dumped)", "Placeholder", "Write a short summary of the tool here.", "Página no encontrada",
]
MORE_SOUND = [
    "The page shows an error when the key is missing.", "The tool writes a placeholder text into empty cells.", "JavaScript files are scanned as well.", "Scripts in the tools folder need Python 3.", "Use --enable-javascript to parse scripts.",
    "Describe the rows with a schema.", "Add a row with the add command.", "Write access is denied by default.", "The todo list is kept in todo.md.", "Insert the disk and start the tool.", "Sample rate is 44 kHz.", "The test suite runs foo and bar.",
    "Complete the setup by running make.", "Replace the battery once a year.", "Loading takes about 5 seconds.", "Hint: use the cache.", "1. Install the tool.\n2. Start it.",
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "section_id long, body string, kind string, __text string")
    return {r["section_id"]: r["kind"] for r in residue(df).collect()}


def test_cases_and_sound_texts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(RESIDUE + SOUND)]
    assert set(found(spark, rows)) == set(range(len(RESIDUE)))


def test_further_cases(spark):
    assert set(found(spark, [(i, t, None, None) for i, t in enumerate(MORE_RESIDUE + MORE_SOUND)])) == set(range(len(MORE_RESIDUE)))


def test_verdicts_do_not_depend_on_other_lines(spark):
    texts = ["Your session has ended.", "Your session has expired.", "This page requires JS.", "This page likes JS."]
    alone = {i for i, t in enumerate(texts) if found(spark, [(i, t, None, None)])}
    assert alone == {0, 1, 2} == set(found(spark, [(i, t, None, None) for i, t in enumerate(texts)]))


def test_nulls_blanks_repeats_and_long_texts(spark):
    long = "A sound sentence about caches. " * 40_000
    rows = [(1, None, None, None), (2, "", "a", "b"), (3, " \n ", "a", "b"), (4, "tbd", None, "b"), (4, "tbd", None, "b"), (5, long, "a", "b"), (6, long + "\nTBD", "a", "b"), (None, "TBD", "a", "b")]
    assert set(found(spark, rows)) == {4, 6, None}


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_titles(spark):
    df = spark.createDataFrame([(" overview: ",), ("HOW  TO RUN",), ("Inputs",), (None,)], "title string")
    assert described_sections(df).count() == 2


UNSEEN = [
    "Write your overview in this spot", "Please write something useful in this box", "HTTP 418 I'm a teapot", "Bitte hier den Überblick ergänzen", "Página não encontrada", "Questo testo è un segnaposto", "Strona nie istnieje",
    "Please add a description of your tool in this space.", "Diese Seite wurde nicht gefunden.", "Cette section est encore vide.",
]
UNSEEN_SOUND = [
    "Put your key in this file.", "Please write the output to a file in this folder.", "HTTP 404 is sent when a row is missing.", "HTTP 503 responses are retried.", "The overview lists each tool.", "Bitte den Schlüssel in die Datei schreiben.",
    "Internal tool; see the team wiki for background.", "Describe rows with a schema and write them here.", "Welcome to the docs.",
]


def test_residue_that_no_pattern_knows(spark):
    assert set(found(spark, [(i, t, None, None) for i, t in enumerate(UNSEEN + UNSEEN_SOUND)])) == set(range(len(UNSEEN)))
    model = train([])
    assert sum(judge(t) is None and classify(model, t) is not None for t in UNSEEN) >= 6


def test_leaf_widens_and_finds_what_a_scan_finds():
    leaf = Leaf(6, 0.75)
    assert leaf.add("we could not load page one".split()) == leaf.add("we could not load page two".split()) == 0
    assert leaf.templates[0][-1] == WILDCARD and leaf.add("they did not see page one".split()) == 1
    rng = random.Random(3)
    lines = [[rng.choice("abc") for _ in range(6)] for _ in range(400)]
    leaf, scanned = Leaf(6, 0.75), []

    def scan(tokens):
        for i, template in enumerate(scanned):
            if sum(a == b for a, b in zip(template, tokens)) >= 0.75 * 6:
                scanned[i] = [a if a == b else WILDCARD for a, b in zip(template, tokens)]
                return i
        scanned.append(list(tokens))
        return len(scanned) - 1

    assert [leaf.add(x) for x in lines] == [scan(x) for x in lines] and leaf.templates == scanned


def test_a_large_leaf_is_not_scanned():
    leaf, began = Leaf(9, 0.75), time.time()
    for i in range(30_000):
        leaf.add(["the", "tool", *(str(hash((i, k)) % 99_991) for k in range(7))])
    assert time.time() - began < 20


@pytest.mark.parametrize("leaf", [7, 20_000])
def test_verdicts_on_templates_reach_every_line(spark, leaf):
    texts = [f"the tool reads file {i}" for i in range(50)] + ["odd line", None]
    lines = spark.createDataFrame([(t,) for t in texts], "line string").select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "line", F.lit(2).cast("long").alias("n"))
    judge_of = lambda: ((lambda line: "odd" if line == "odd line" else None), (lambda template, uses: "file" if template == "the tool reads file <*>" and uses > 2 else None))
    got = lines.join(judged_lines(lines, judge_of, leaf=leaf), ["k1", "k2"]).collect()
    assert {r["line"]: r["kind"] for r in got} == {**{t: "file" for t in texts[:50]}, "odd line": "odd"}


def test_patterns_need_their_literals():
    assert literals(r"^(?:not found|gone)\b") == {"not found", "gone"} and literals(r"a?\d*") is None
    patterns = Patterns(KINDS)
    for line in (x for x in RESIDUE + MORE_RESIDUE + SOUND + MORE_SOUND):
        low = line.lower()
        assert patterns.first(low) == next((k for k, p in patterns.patterns if p.search(low)), None)


def test_classifier_without_lines():
    assert Classifier([]).best("any text") == (None, 0.0)


def test_judge_and_masks(spark):
    assert judge(None) is None and judge("We trim the axle.") is None and judge("Access denied.") == "error"
    row = spark.createDataFrame([("Please turn on JavaScript, error 404 id 12ab3c", "a `x {{y}}` b")], "a string, b string").select(masked(F.col("a")), prose(F.col("b"))).first()
    assert row[0] == "Please <enable> <script>, error <num> id <num>" and row[1] == "a <code> b"
