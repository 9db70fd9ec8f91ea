"""Blocks and packing."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.operators import chunking as C

TEXT = "# Head\nintro text\n\n```py\na = 1\n\nb = 2\n```\nafter\n## Sub\nlast\n"


def test_blocks():
    assert C.blocks_of(TEXT) == ["# Head", "intro text", "```py\na = 1\n\nb = 2\n```", "after", "## Sub", "last"]
    assert C.blocks_of("a\n```\nopen\n\nend") == ["a", "```\nopen\n\nend"] and C.blocks_of(None) == C.blocks_of(" \n") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.integers(3, 12), st.integers(0, 2), st.booleans())
def test_packing_is_greedy_and_within_budget(sizes, budget, separator, flush):
    blocks = [" ".join(["w"] * n) for n in sizes]
    chunks = C.pack(blocks, budget, separator=separator, flush_first=flush)
    assert " ".join(chunks).split() == " ".join(blocks).split()
    groups = [c.split("\n\n") for c in chunks]
    for a, b in zip(groups, groups[1:]):
        cost = sum(len(x.split()) for x in a) + separator * (len(a) - 1)
        assert cost <= budget
        first = len(b[0].split())
        if max(map(len, map(str.split, a))) < budget and first < budget and not any(n > budget for n in sizes):
            assert cost + separator + first > budget


def test_chunks_keep_fences_and_order():
    text = "\n\n".join(f"para {i} " + "w " * 6 for i in range(9)) + "\n\n```\n" + "x " * 5 + "\n```"
    chunks = C.chunks_of(text, 20)
    assert [b for c in chunks for b in C.blocks_of(c)] == C.blocks_of(text)
    assert any(c.endswith("```") and c.count("```") == 2 for c in chunks)


def test_oversize_and_limits():
    assert "".join(C.slices_of("abcd efgh ijkl", 3, 1)) == "abcd efgh ijkl" and len(C.slices_of("abcd efgh ijkl", 3, 1)) == 4
    chunks = C.limited_chunks_of("a " * 30 + "\n\n" + "b " * 5 + "\n\n" + "c " * 4, 10, 60)
    assert all(len(c) <= 60 for c in chunks) and chunks[-1].split() == ["b"] * 5 + ["c"] * 4
    assert C.limited_chunks_of("a\n\nb\n\nc", 100, 5) == ["a\n\nb", "c"]
    assert C.structural_chunks_of(["one two", "three", "w " * 30], 5)[0] == "one two\n\nthree"


def test_groups():
    assert C.groups_of(["a b", "c d", "e"], 6) == [["a b", "c d"], ["e"]] and C.groups_of([], 5) == [] and C.groups_of(["w " * 50], 3) == [["w " * 50]]


def test_columns(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "w " * 100)], "id int, t string")
    rows = {r["id"]: r for r in df.select("id", C.blocks(F.col("t")).alias("b"), C.chunks(F.col("t"), 8).alias("c"), C.limited_chunks(F.col("t"), 8, 50).alias("l"), C.fixed_slices(F.col("t"), 10).alias("s")).collect()}
    assert rows[1]["b"] == C.blocks_of(TEXT) and rows[1]["c"] == C.chunks_of(TEXT, 8)
    assert rows[2]["b"] == rows[3]["b"] == rows[2]["c"] == rows[2]["s"] == rows[3]["s"] == []
    assert rows[4]["s"] == C.slices_of("w " * 100, 100, 10) and rows[4]["l"] == C.limited_chunks_of("w " * 100, 8, 50)
