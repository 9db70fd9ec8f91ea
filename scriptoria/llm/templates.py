"""Message-template mining with a fixed-depth prefix tree.

A line's leaf is its token count plus its first ``depth`` tokens, numbers masked. In a leaf a line
joins the first template whose constant tokens make up ``similarity`` of its own; where they differ the template
gets a wildcard. Leaves of more than ``LEAF`` lines are split by a hash of the line into parts that grow their
templates apart, so that no task holds more than one part, however many lines begin alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.runtime import parallelism, salted_join

WILDCARD = "<*>"
#: Lines of a leaf that grow their templates together, on average.
LEAF = 20_000


def leaf_path(line: Column, depth: int) -> Column:
    """The tree path of a line: its length and its first tokens."""
    tokens = F.split(line, " ")
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, depth))


class Leaf:
    """The templates of lines of one length.

    A line that agrees with a template but for m tokens agrees with it in one of any m + 1 places. Templates are listed by the token
    of each place beyond the ``depth`` first ones, which all lines share, and a line meets those of the m + 1 places with the shortest
    lists; the first that is similar enough is taken.
    """

    def __init__(self, size: int, similarity: float, depth: int = 0) -> None:
        self.templates: list[list[str]] = []
        self.least = similarity * size
        self.spare = int(size - self.least) + 1
        self.places = range(min(depth, size), size)
        self.lists: dict[tuple[int, str], list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        """The number of the template that ``tokens`` joins; it may be widened by it."""
        if len(self.places) < self.spare:
            met = range(len(self.templates))
        else:
            short = sorted((self.lists.get((k, tokens[k]), []) for k in self.places), key=len)[: self.spare]
            met = sorted(set().union(*short))
        for i in met:
            template = self.templates[i]
            if sum(map(str.__eq__, template, tokens)) >= self.least:
                for k, (x, y) in enumerate(zip(template, tokens)):
                    if x != y:
                        template[k] = WILDCARD
                return i
        self.templates.append(list(tokens))
        i = len(self.templates) - 1
        for k in self.places:
            self.lists.setdefault((k, tokens[k]), []).append(i)
        return i


Judge = Callable[[str, int], str | None]


def _grow(judge_of: Callable[[], tuple[Callable[[str], str | None], Judge]], similarity: float, depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge_line, judge_template = judge_of()
        now, leaf, found, uses = None, None, [], []

        def verdicts() -> list[tuple]:
            """The lines of a finished part whose own text or whose template is judged."""
            kinds = [judge_template(" ".join(t), n) for t, n in zip(leaf.templates, uses)]
            return [(k1, k2, line or kinds[i]) for k1, k2, i, line in found if line or kinds[i]]

        for pdf in batches:
            rows = []
            for part, k1, k2, line, n in zip(pdf["part"], pdf["k1"], pdf["k2"], pdf["line"], pdf["n"]):
                if part != now:
                    if leaf is not None:
                        rows += verdicts()
                    tokens = line.split(" ")
                    now, leaf, found, uses = part, Leaf(len(tokens), similarity, depth), [], []
                i = leaf.add(line.split(" "))
                if i == len(uses):
                    uses.append(0)
                uses[i] += n
                found.append((k1, k2, i, judge_line(line)))
            yield pd.DataFrame(rows, columns=["k1", "k2", "kind"])
        if leaf is not None:
            yield pd.DataFrame(verdicts(), columns=["k1", "k2", "kind"])

    return run


def judged_lines(lines: DataFrame, judge_of: Callable[[], tuple[Callable[[str], str | None], Judge]], depth: int = 2, similarity: float = 0.75, leaf: int = LEAF) -> DataFrame:
    """``(k1, k2, kind)``: the lines of ``lines`` (k1, k2, line, n; distinct, keyed by k1 and k2, ``n`` uses) that are judged.

    ``judge_of`` gives two functions, made once a task: the kind of a line, and the kind of a template with the number of its uses.
    A verdict on a template holds for all its lines. Null lines have no template. Parts come sorted, hence in the same order at any partitioning.
    """
    paths = lines.where("line is not null").withColumn("path", leaf_path(F.col("line"), depth))
    sizes = paths.groupBy("path").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    # a leaf of one part needs no lookup
    large = sizes.where("parts > 1")
    parted = salted_join(paths, large, ["path"], "left").withColumn("part", F.concat_ws(" ", F.pmod("k1", F.coalesce("parts", F.lit(1))).cast("string"), "path"))
    spread = parted.select("part", "k1", "k2", "line", "n").repartition(parallelism(lines.sparkSession), "part").sortWithinPartitions("part", "line")
    return spread.mapInPandas(_grow(judge_of, similarity, depth), "k1 long, k2 long, kind string")
