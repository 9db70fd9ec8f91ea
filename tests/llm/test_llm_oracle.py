"""Queries of the problems against their SQL, or against the tables and each other where there is none."""

from collections import Counter
from math import floor, log2

import pandas as pd
import pytest
from oracle import assert_equal

from scriptoria.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, name):
    assert_equal(spark, data, queries.QUERIES[name], queries.SQL[name])


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def texts(data, name, key, text):
    t = pd.read_parquet(f"{data}/{name}.parquet", columns=[key, text]).drop_duplicates(key).set_index(key)[text]
    return {k: v for k, v in t.items() if isinstance(v, str)}


def test_residue_queries_agree(spark, data):
    found = {r["section_id"] for r in rows(spark, data, "p1_found")}
    kinds = {r["kind"]: r["sections"] for r in rows(spark, data, "p1_kinds")}
    sections = pd.read_parquet(f"{data}/manual_sections.parquet", columns=["section_id"])
    assert found and kinds.keys() <= {"slot", "hint", "filler", "error", "notice"} and max(kinds.values()) <= len(found) <= sum(kinds.values())
    assert Counter(r["section_id"] for r in rows(spark, data, "p1_sound_manual")) == Counter(set(sections.section_id) - found)


def test_defects_and_their_counts_agree(spark, data):
    found = rows(spark, data, "p3_found")
    assert len({r["symbol_id"] for r in found}) == len(found)
    assert {r["defect"]: r["pairs"] for r in rows(spark, data, "p3_counts")} == Counter(r["defect"] for r in found)
    prompts = texts(data, "symbols", "symbol_id", "docstring")
    assert all(prompts[r["symbol_id"]].strip() for r in found)


def test_functions_are_where_they_are_said_to_be(spark, data):
    sources = texts(data, "modules", "module_id", "source")
    pairs = rows(spark, data, "p4_pairs")
    found = {(r["module_id"], r["lineno"], r["name"]) for r in rows(spark, data, "p4_found")}
    assert found == {(r["module_id"], r["lineno"], r["name"]) for r in pairs if r["documented_at"] == "definition"} and found
    for r in pairs:
        assert r["name"] in sources[r["module_id"]].split("\n")[r["lineno"] - 1] and r["source"].strip() and r["docstring"].strip()
        assert r["source"].rstrip() in sources[r["module_id"]]


def test_pieces_give_back_their_items(spark, data):
    limits = pd.read_parquet(f"{data}/size_limits.parquet").set_index("item_kind")
    items = {"snippet": {str(k): v for k, v in texts(data, "evidence", "evidence_id", "snippet").items()}, "source": texts(data, "modules", "module_id", "source")}
    got = {}
    for r in rows(spark, data, "p5_pieces"):
        got.setdefault((r["item_kind"], r["item_id"]), []).append(r)
    assert got.keys() == {(k, i) for k, t in items.items() for i, v in t.items() if len(v) > limits.max_chars[k]}
    for (kind, item), pieces in got.items():
        text, pieces = items[kind][item], sorted(pieces, key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(pieces[0]["pieces"]))
        assert "".join(text[r["cut_char"] : r["end_char"]] for r in pieces) == text
        for r in pieces:
            assert r["text"] == text[r["start_char"] : r["end_char"]] and len(r["text"]) <= limits.max_chars[kind] and r["cut_char"] - r["start_char"] <= limits.overlap_chars[kind]


def test_ids_are_those_of_the_library(spark, data):
    from tokenizers import Tokenizer

    from scriptoria.llm.tokenizer import TOKENIZERS, VOCABULARY

    library = Tokenizer.from_file(f"{TOKENIZERS}/{VOCABULARY}")
    documents = pd.read_parquet(f"{data}/documents.parquet", columns=["doc_id", "text"])
    got = {r["doc_id"]: r["ids"] for r in rows(spark, data, "p6_ids")}
    assert len(got) == len(documents)
    plain = documents[documents.text.notna() & ~documents.text.fillna("").str.contains("<|", regex=False)]
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in zip(plain.doc_id, plain.text))
    assert all(got[i] == [] for i, t in zip(documents.doc_id, documents.text) if not isinstance(t, str) or not t)
    assert sum(r["documents"] for r in rows(spark, data, "p6_length_histogram")) == len(documents)


def test_shares_are_those_of_the_mix(spark, data):
    mixed = rows(spark, data, "p7_mix")
    targets = pd.read_parquet(f"{data}/mix_targets.parquet").set_index("source")
    tokens, whole = Counter(), 0
    for r in mixed:
        assert 1 <= r["repeats"] <= targets.max_repeats[r["source"]]
        tokens[r["source"]] += r["tokens"] * r["repeats"]
        whole += r["tokens"] * r["repeats"]
    shares = {r["source"]: r for r in rows(spark, data, "p7_shares")}
    assert shares.keys() == set(targets.index)
    for source, r in shares.items():
        assert r["tokens"] == tokens[source] and abs(r["actual_share"] - tokens[source] / whole) < 1e-9
        assert abs(r["actual_share"] - targets.target_share[source]) < 0.02


def test_sentences_cover_every_text_in_order(spark, data):
    documents = texts(data, "documents", "doc_id", "text")
    got = {}
    for r in rows(spark, data, "p8_found"):
        got.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert got.keys() == {i for i, t in documents.items() if t.lstrip("﻿").strip()}
    for i, spans in got.items():
        text, spans = documents[i], sorted(spans)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.removeprefix("﻿").split())
    bands = Counter(floor(log2(b - a)) for spans in got.values() for a, b in spans)
    assert {r["band"]: r["sentences"] for r in rows(spark, data, "p8_lengths")} == bands
