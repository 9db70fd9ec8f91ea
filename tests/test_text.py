"""Text functions against Python's own."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions.sanitize import sanitize, sanitize_text
from scriptoria.functions.vocabulary import PROMPTS, SYSTEM_PROMPT, prompt_lines

WILD = "aß é\t\n\r\x0b\x0c\x1c\x1d\x85\xa0  中<>&\"'./_-[]|"


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, t string, out string").repartition(1)
    return [tuple(r) for r in df.sortWithinPartitions("i").select(*exprs).collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=WILD, max_size=40), min_size=20, max_size=60))
def test_words_lines_and_blanks(spark, texts):
    rows = column(spark, texts, T.word_count(F.col("t")), T.split_lines(F.col("t")), T.strip(F.col("t")))
    for text, (n, lines, bare) in zip(texts, rows):
        assert n == len(text.split()) and lines == text.splitlines() and bare == text.strip()


def test_nulls(spark):
    c = F.col("t")
    row = column(spark, [None], T.word_count(c), T.strip_fim(c), T.content_key("k", c), T.placeholders(c), T.slug(c), T.paragraphs_html(c), T.tag_bodies(c, "p"), T.path_tokens(c), T.split_lines(c))[0]
    assert row == (0, "", "k:null", [], "user_manual", "", [], [], None)


def test_keys_differ_for_null_and_empty(spark):
    a, b, c = column(spark, [None, "", "<None>"], T.content_key("k", F.col("t")))
    assert len({a, b, c}) == 3 and b[0] == "k:" + hashlib.sha256(b"").hexdigest()


def test_markup(spark):
    c = F.col("t")
    html = "<p class='a'>One <b>two</b></p>\n<PRE>x</PRE>\n<li>Three</li><p>four\nlines</p>"
    bodies, bare, line, lost = column(spark, [html], T.tag_bodies(c, "p"), T.without_tags(c), T.line_of(c, F.lit("THREE")), T.line_of(c, F.lit("four\nlines")))[0]
    assert bodies == ["One <b>two</b>", "x</PRE>\n<li>Three</li><p>four\nlines"] and "<" not in bare and line == 3 and lost == -1
    assert column(spark, ["a & <b>\n\nc\nd\n\n "], T.paragraphs_html(c))[0][0] == "<p>a &amp; &lt;b&gt;</p>\n<p>c<br/>d</p>"


def test_paths(spark):
    c = F.col("t")
    got = column(spark, ["a/b.tar.gz", ".hidden", "x", "a/.b.py", "d.e/f"], T.file_name(c), T.stem(c), T.suffix(c))
    assert got == [("b.tar.gz", "b.tar", ".gz"), (".hidden", ".hidden", ""), ("x", "x", ""), (".b.py", ".b", ".py"), ("f", "f", "")]
    assert column(spark, ["a/b", "ab", "a"], T.is_under(c, F.lit("a"))) == [(True,), (False,), (True,)]
    assert column(spark, ["see src/a.py, b.py or c.md"], T.path_tokens(c))[0][0] == ["src/a.py", "b.py"]


def test_other_scalars(spark):
    c = F.col("t")
    text = "import argparse\np = argparse.ArgumentParser()\nif __name__ == '__main__':\n    run()\n"
    assert column(spark, [text], T.cli_lines(c), T.main_block(c))[0] == (["p = argparse.ArgumentParser()"], "if __name__ == '__main__':\n    run()\n")
    assert column(spark, ["Ünï code!", "--"], T.unicode_slug(c), T.slug(c)) == [("ünï-code", "n_code"), ("simulink-model", "user_manual")]
    assert column(spark, ["[[A]] x [[B]] [[A]] [[]]"], T.placeholders(c))[0][0] == ["[[A]]", "[[B]]"]
    assert column(spark, ["a<|fim_prefix|>b"], T.strip_fim(c))[0][0] == "ab"
    assert column(spark, ["x"], T.percent(F.lit(1), F.lit(3)), T.percent(F.lit(0), F.lit(0)))[0] == (33, 100)


SUMMARIES = ["Reads rows.\n- a list\nYou can run it.\nThis script does it.\n\nKeeps keys.", "project summary", "code: x\n```python\nKept", "a\r\nb\x0bc", "This summary omits.\nAs an AI language model I cannot.", "", "  \n ", "just describe what is implemented.", "describe wh"]


def test_sanitizer(spark):
    got = [r[0] for r in column(spark, SUMMARIES, sanitize(F.col("t")))]
    assert got == [sanitize_text(s) for s in SUMMARIES]
    assert got[0] == "Reads rows.\n\nKeeps keys." and got[1] == "It prints." and got[2] == "Kept"
    assert column(spark, [None], sanitize(F.col("t")))[0][0] == ""


@pytest.mark.parametrize("alphabet", ["aA \n-*.:`", WILD])
def test_sanitizer_forms_agree(spark, alphabet):
    texts = [t for k in range(60) for t in ["".join(alphabet[(k * 7 + j * j * 3) % len(alphabet)] for j in range(k % 23))]]
    assert [r[0] for r in column(spark, texts, sanitize(F.col("t")))] == [sanitize_text(t) for t in texts]


def test_prompt_lines():
    lines = prompt_lines()
    assert len(lines) == len(set(lines)) and "code:" in lines and "```" in lines and all(x == x.strip().lower() for x in lines)
    assert all("{text}" in p for p in PROMPTS.values()) and SYSTEM_PROMPT.lower() in lines
