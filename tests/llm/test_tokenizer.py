"""Problem 6."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm.tokenizer import TOKENIZERS, VOCABULARY, encode, vocabulary

PATH = f"{TOKENIZERS}/{VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_public_library(reference, text):
    assert vocabulary(PATH).encode([text])[0] == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbeinorst '\n\té中🚀0123<|>endoftx", max_size=60))
def test_equals_it_on_common_letters(reference, text):
    assert vocabulary(PATH).encode([text])[0] == reference(text)


def test_odd_texts(reference):
    bpe = vocabulary(PATH)
    for text in ("<|endoftext|>", "a" * 20_000, " " * 300, "\r\n\r\n  x", "I'LL I'll", "é" * 50, "﻿x", "\x00\x01", "ab" * 5000, "🚀" * 200):
        assert bpe.encode([text])[0] == reference(text), text[:20]


def test_pairs_agree_with_merging():
    bpe = vocabulary(PATH)
    raw = {i: t for t, i in bpe.ids.items()}
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50_000, 4000), rng.integers(0, 50_000, 4000)
    good = bpe.compatible(a, b)
    assert all((bpe.merge(raw[x] + raw[y]) == [x, y]) == g for x, y, g in zip(a.tolist(), b.tolist(), good.tolist()))
    assert good.any() and not good.all()


def test_every_token_is_its_own_result():
    bpe = vocabulary(PATH)
    assert all(bpe.merge(t) == [i] for t, i in list(bpe.ids.items())[::7])


def test_operator_cases(spark, reference):
    rows = [(1, None), (2, ""), (3, "The cache. " * 3), (3, "The cache. " * 3), (None, "x"), (5, "long text " * 60_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, ids string, n int")
    got = encode(df).collect()
    assert [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[], []]
    assert [r["ids"] for r in got if r["doc_id"] == 3] == [reference("The cache. " * 3)] * 2
    assert {r["n"] for r in encode(df, out="n", count_only=True).where("doc_id in (1, 2)").collect()} == {0}
    assert encode(df.limit(0)).count() == 0 and encode(df).schema["ids"].dataType.simpleString() == "array<int>"
