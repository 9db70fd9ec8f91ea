"""Problem 5."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm.splitting import boundaries, limits_of, pieces, split

PROSE = "# Title\n\nThe cache reads a row. It waits for the key, then it stops.\n\n- one item\n- another item\n\nDer Leser schreibt. 接着队列把源文件写入目录。如果队列不可用，系统会等待。\r\n\r\n```py\nx = 1\n\ny = 2\n```\n"


def check(text, limit, overlap, code):
    parts = split(text, limit, overlap, code)
    assert "".join(text[c:e] for _, c, e in parts) == text
    assert all(e - a <= limit and c - overlap <= a <= c for a, c, e in parts)
    assert all(e > c for _, c, e in parts) or text == ""
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;\n\ŕ‍éß中。ก ाक{}()/+", max_size=400), st.integers(4, 60), st.integers(0, 40), st.booleans())
def test_limits_and_round_trip(text, limit, overlap, code):
    check(text, limit, overlap, code)


@pytest.mark.parametrize("limit,overlap", [(40, 0), (40, 12), (90, 20)])
def test_cuts_lie_on_boundaries(limit, overlap):
    text = PROSE * 20
    places = set(boundaries(text, False)[0])
    parts = check(text, limit, overlap, False)
    assert all(c in places for _, c, _ in parts[1:])


def test_balance_and_least_number():
    parts = check("word " * 1000, 1200, 100, False)
    sizes = [e - c for _, c, e in parts]
    assert len(parts) == 5 and max(sizes) - min(sizes) < 20


def test_unbroken_runs_and_marks_stay_together():
    check("A" * 10_000, 1200, 100, False)
    text = "e\u0301" * 3000
    assert all(c % 2 == 0 for _, c, _ in check(text, 101, 10, False)[1:])
    text = "ab\r\n" * 2000
    assert all(text[c - 1 : c + 1] != "\r\n" for _, c, _ in check(text, 50, 5, True)[1:])


def test_code_prefers_definitions():
    text = "".join(f"def f{i}():\n    a = {i}\n\n    return a\n\n" for i in range(60))
    parts = check(text, 400, 40, True)
    assert all(text[c:].startswith("def ") for _, c, _ in parts[1:])


def test_large_text_is_linear():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(150_000))
    assert len(check(text, 1200, 100, False)) > 900


def test_operator_cases(spark):
    rows = [("snippet", "1", None), ("snippet", "2", ""), ("snippet", "3", "x y " * 10), ("snippet", "4", "x y " * 500), ("snippet", "4", "x y " * 500), ("other", "5", "z" * 9999), ("source", None, "a = 1\n" * 99), (None, "7", "z" * 999)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "item_kind string, item_id string, text string, piece int, pieces string")
    got = pieces(df, {"snippet": (100, 10), "source": (200, 20)}).collect()
    assert {(r["item_kind"], r["item_id"]) for r in got} == {("snippet", "4"), ("source", None)}
    four = sorted((r for r in got if r["item_id"] == "4"), key=lambda r: r["piece"])
    assert "".join(r["text"][r["cut_char"] - r["start_char"] :] for r in four) == "x y " * 500 and len(four) == four[0]["pieces"]
    assert pieces(df.limit(0), {"snippet": (100, 10)}).count() == 0


def test_limits(spark):
    df = spark.createDataFrame([("a", 10, 2), ("a", 8, None), ("b", None, 1), (None, 5, 1), ("c", 0, 0)], "item_kind string, max_chars int, overlap_chars int")
    assert limits_of(df) == {"a": (8, 0)}
