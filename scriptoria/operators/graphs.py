"""Components, layers and levels of graphs.

Per module the graphs are small by nature and are solved group by group; the components of a
graph of any size are found task by task, and joined by repeated joins, with the lineage cut each round, where tasks share nodes.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.runtime import cut_lineage, salted_join

#: Bytes that the nodes a task contracts at once may take, roughly.
HELD = 64 << 20


def components_of(names: Iterable[str], links: Iterable[tuple[str, str]]) -> dict[str, int]:
    """Component of each node; components are numbered by their first node in name order."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found: dict[str, int] = {}
    n = 0
    for start in sorted(set(names)):
        if start in found:
            continue
        queue = deque([start])
        found[start] = n
        while queue:
            for other in near[queue.popleft()]:
                if other not in found:
                    found[other] = n
                    queue.append(other)
        n += 1
    return found


def layers_of(names: Iterable[str], links: Iterable[tuple[str, str]]) -> dict[str, int]:
    """Longest-path layers; where only cycles remain, the node of the fewest open predecessors, then name, is freed."""
    import heapq

    names = set(names)
    after, waits = defaultdict(set), dict.fromkeys(names, 0)
    for a, b in set(links):
        if a in names and b in names and a != b:
            after[a].add(b)
            waits[b] += 1
    layer = dict.fromkeys(names, 0)
    heap = [(n, name) for name, n in waits.items()]
    heapq.heapify(heap)
    done: set[str] = set()
    while heap:
        n, name = heapq.heappop(heap)
        if name in done or n != waits[name]:
            continue
        done.add(name)
        for b in after[name]:
            if b not in done:
                layer[b] = max(layer[b], layer[name] + 1)
                waits[b] -= 1
                heapq.heappush(heap, (waits[b], b))
    return layer


def levels_of(names: Iterable[str], links: Iterable[tuple[str, str]]) -> dict[str, int]:
    """Longest-path levels; nodes on or behind a cycle each get a level of their own, in name order, after the others."""
    names = set(names)
    after, waits = defaultdict(set), dict.fromkeys(names, 0)
    for a, b in set(links):
        if a in names and b in names and a != b:
            after[a].add(b)
            waits[b] += 1
    level = {n: 0 for n in names if not waits[n]}
    queue = deque(sorted(level))
    left = dict(waits)
    while queue:
        a = queue.popleft()
        for b in sorted(after[a]):
            left[b] -= 1
            level[b] = max(level.get(b, 0), level[a] + 1)
            if not left[b]:
                queue.append(b)
    settled = {n: level[n] for n in names if not left[n]}
    top = max(settled.values(), default=-1)
    for k, n in enumerate(sorted(names - settled.keys()), 1):
        settled[n] = top + k
    return settled


_SOLVERS = {"component": components_of, "layer": layers_of, "level": levels_of}


def solve_groups(nodes: DataFrame, edges: DataFrame, scope: str, what: str) -> DataFrame:
    """``(scope, qualname, value)`` by ``what`` (component, layer or level) of each scope's graph.

    The graph of one scope is one group: scopes are modules, whose size is bounded by their file.
    """
    solve = _SOLVERS[what]
    rows = nodes.select(F.col(scope).cast("string").alias(scope), F.col("qualname").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        edges.select(F.col(scope).cast("string").alias(scope), F.col("source").alias("a"), F.col("target").alias("b"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        link = pdf["b"].notna()
        found = solve(pdf.loc[~link, "a"], zip(pdf.loc[link, "a"], pdf.loc[link, "b"]))
        names = sorted(n for n in found if n in set(pdf.loc[~link, "a"]))
        return pd.DataFrame({scope: pdf[scope].iloc[0], "qualname": names, "value": [found[n] for n in names]})

    return rows.groupBy(scope).applyInPandas(run, f"{scope} string, qualname string, value int")


def contract(batches: Iterable[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """The smallest node linked with each node of ``batches`` of two binary columns.

    Nodes are given out, and forgotten, once they take about ``most`` bytes, so a node may come several times.
    """
    near: dict[bytes, bytes] = {}
    held = 0

    def top(x: bytes) -> bytes:
        while (up := near[x]) != x:
            near[x] = x = near[up]
        return x

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(near), pa.binary()), pa.array([top(x) for x in near], pa.binary())], ["node", "component"])

    for batch in batches:
        for ends in zip(*(c.to_pylist() for c in batch.columns)):
            for x in ends:
                if x not in near:
                    near[x] = x
                    held += len(x) + 200
            a, b = top(ends[0]), top(ends[1])
            near[max(a, b)] = min(a, b)
            if held >= most:
                yield found()
                near.clear()
                held = 0
    yield found()


def components(edges: DataFrame, source: str = "source", target: str = "target", rounds: int = 60, held: int = HELD) -> DataFrame:
    """``(node, component)``: the smallest node of each node's component, over a graph of any size.

    The links of each task are contracted first, where they lie, in about ``held`` bytes at once. Only if nodes are met several times, the
    components found so are linked by them and joined over all tasks. Null ends are ignored, loops give single nodes.
    """
    ends = edges.select(F.col(source).cast("string").cast("binary").alias("u"), F.col(target).cast("string").cast("binary").alias("v")).where("u is not null and v is not null")
    stars = ends.mapInArrow(lambda batches: contract(batches, held), "node binary, component binary")
    stars = cut_lineage(stars.select(F.col("node").cast("string").alias("node"), F.col("component").cast("string").alias("component")))
    if stars.groupBy(F.xxhash64("node")).count().where("count > 1").isEmpty():
        return stars
    met = stars.groupBy("node").agg(F.collect_set("component").alias("c")).select(F.explode("c").alias("u"), F.array_min("c").alias("v")).where("u <> v").distinct()
    joined = settle(met, rounds).select(F.col("u").alias("component"), F.col("component").alias("least"))
    return salted_join(stars, joined, ["component"], "left").groupBy("node").agg(F.min(F.coalesce("least", "component")).alias("component"))


def settle(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, component)``: the smallest node of the component of each ``u`` that is not the smallest itself, of distinct links ``(u, v)`` with u > v.

    Alternating star contractions: each round links every node's larger neighbours to its smallest one, then every
    node's neighbours to the smallest. The number of rounds grows with the logarithm of the number of nodes. Minima
    are combined before they are shuffled, and the joins are salted, so a node may hold most links.
    """
    links = cut_lineage(links)
    before = None
    for _ in range(rounds):
        # large star: larger neighbours of each node are linked to the smallest of the node and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours not larger than a node, and the node, are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = cut_lineage(small)
        state = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("component"))
