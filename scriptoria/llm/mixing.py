"""Problem 7: mix records of overlapping sources to target shares of the total size.

Records are distinct texts. A record may lie in several sources; records are aggregated by that
membership pattern, of which there are at most 2^k - 1 for k sources. Tokens are routed from the
patterns to the sources' quotas by a min-cost flow whose costs are convex in the number of
repetitions. All costs lie on the arcs that leave the origin, one for each repetition, and cheapest paths leave it once; so
the cheapest flow is a maximal flow of the first uses, grown by paths to one of the first and second uses, and so on. Paths lead over
sources only, of which there are few, and carry what all patterns allow together. The flow says how many tokens of a pattern serve a source at each repetition; seeded
records fill these amounts by their running total.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.tokenizer import encode
from scriptoria.runtime import cut_lineage, table, widen

#: Most sources of one mix, which bounds the patterns and the flow network on the driver.
MAX_SOURCES = 16
#: Records that one task ranks at once, on average.
BUCKET_RECORDS = 4096


@dataclass(frozen=True)
class Target:
    """A source's share of the mix and how often a record may serve in it."""

    source: str
    share: float
    repeats: int


def _arrays(tokens: dict[int, int], targets: list[Target]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns with tokens in order, their sizes and the uses that the strictest of their sources allows."""
    patterns = np.array(sorted(p for p, c in tokens.items() if c > 0), np.int64)
    sizes = np.array([tokens[int(p)] for p in patterns], np.int64)
    uses = np.full(len(patterns), np.iinfo(np.int64).max, np.int64)
    for i, t in enumerate(targets):
        uses = np.where(patterns >> i & 1, np.minimum(uses, t.repeats), uses)
    return patterns, sizes, uses


def _taken(room: np.ndarray, amount: int) -> np.ndarray:
    """``amount`` taken out of ``room``, in order."""
    before = np.cumsum(room) - room
    return np.clip(amount - before, 0, room)


def _grow(served: np.ndarray, free: np.ndarray, within: np.ndarray, quotas: np.ndarray) -> None:
    """Grow a flow to a maximal one. ``served``: tokens by pattern and source, ``free``: unused ones by pattern; both are changed."""
    k = len(quotas)
    while True:
        short = quotas - served.sum(0)
        start = [i for i in range(k) if free[within[:, i]].sum() > 0]
        # the shortest path from a source that can use free tokens to one that is short; each hands tokens of shared patterns on
        moves = [[served[within[:, j], i].sum() for j in range(k)] for i in range(k)]
        via: dict[int, int] = dict.fromkeys(start, -1)
        queue = deque(start)
        end = next((i for i in start if short[i] > 0), None)
        while queue and end is None:
            i = queue.popleft()
            for j in range(k):
                if j not in via and moves[i][j] > 0:
                    via[j] = i
                    queue.append(j)
                    if short[j] > 0:
                        end = j
                        break
        if end is None:
            return
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min([int(free[within[:, path[0]]].sum()), int(short[end]), *(int(moves[i][j]) for i, j in zip(path, path[1:]))])
        for i, j in list(zip(path, path[1:]))[::-1]:
            moved = _taken(np.where(within[:, j], served[:, i], 0), amount)
            served[:, i] -= moved
            served[:, j] += moved
        given = _taken(np.where(within[:, path[0]], free, 0), amount)
        free -= given
        served[:, path[0]] += given


def route(tokens: dict[int, int], targets: list[Target], total: int) -> tuple[int, dict[tuple[int, int, int], int]]:
    """Tokens routed for a mix of ``total``: ``{(pattern, source index, repetition): tokens}``.

    ``tokens``: size of each membership pattern (bit i: in source i). Of a pattern of size c the r-th use
    holds c tokens whichever sources they go to, at cost r - 1; a pattern is used as often as the
    strictest of its sources allows.
    """
    patterns, sizes, uses = _arrays(tokens, targets)
    within = np.stack([(patterns >> i & 1).astype(bool) for i in range(len(targets))], 1) if len(patterns) else np.zeros((0, len(targets)), bool)
    quotas = np.array([round(total * t.share) for t in targets], np.int64)
    served = np.zeros(within.shape, np.int64)
    for level in range(1, int(uses.max(initial=0)) + 1):
        _grow(served, sizes * np.minimum(level, uses) - served.sum(1), within, quotas)
        if (served.sum(0) >= quotas).all():
            break
    out: dict[tuple[int, int, int], int] = {}
    ends = np.cumsum(served, 1)
    for n in np.flatnonzero(ends[:, -1]) if len(patterns) else ():
        p, size = int(patterns[n]), int(sizes[n])
        for i in np.flatnonzero(served[n]):
            # the sources take consecutive stretches of the pattern's uses
            at, stop = int(ends[n, i] - served[n, i]), int(ends[n, i])
            while at < stop:
                r = at // size + 1
                step = min(stop, r * size) - at
                out[p, int(i), r] = step
                at += step
    return int(served.sum()), out


def largest_total(tokens: dict[int, int], targets: list[Target]) -> int:
    """The largest total whose quotas can all be met.

    They can if those of every set of sources fit into what the patterns that meet the set may hold, which is the cut condition
    of the flow; the sets are checked all at once.
    """
    patterns, sizes, uses = _arrays(tokens, targets)
    k = len(targets)
    inside = np.zeros(1 << k, np.int64)
    np.add.at(inside, patterns, sizes * uses)
    capacity = int(inside.sum())
    sets = np.arange(1 << k)
    for i in range(k):  # what lies within each set of sources
        with_i = sets[(sets >> i & 1).astype(bool)]
        inside[with_i] += inside[with_i ^ (1 << i)]
    room = capacity - inside[(1 << k) - 1 - sets]

    def fits(total: int) -> bool:
        need = np.zeros(1 << k, np.int64)
        for i, t in enumerate(targets):
            need += (sets >> i & 1) * round(total * t.share)
        return bool((need <= room).all())

    low, high = 0, capacity
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low


def _position(seed: int, *columns: str | Column) -> Column:
    """A seeded uniform position in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _running_total(records: DataFrame) -> DataFrame:
    """``records`` with ``upto``: the tokens of the pattern up to and with the record, in seeded order.

    A hot pattern never meets in one task: its positions are cut into buckets of about
    ``BUCKET_RECORDS`` records, the sums of the buckets are accumulated first, and records only within theirs.
    """
    counted = records.groupBy("pattern").agg(F.count("*").alias("__n"))
    placed = records.join(F.broadcast(counted), "pattern").withColumn("__bucket", F.floor(F.col("position") * F.ceil(F.col("__n") / BUCKET_RECORDS))).drop("__n")
    sums = placed.groupBy("pattern", "__bucket").agg(F.sum("tokens").alias("__sum"))
    before = Window.partitionBy("pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pattern", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("pattern", "__bucket").orderBy("position", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("__upto", F.sum("tokens").over(within)).join(offsets, ["pattern", "__bucket"]).withColumn("upto", F.col("__before") + F.col("__upto")).drop("__bucket", "__upto", "__before")


def mix(docs: DataFrame, targets: list[Target], seed: int = 0, total: int | None = None, **tokenizer: str) -> DataFrame:
    """``(doc_id, source, repeats, tokens)``: the documents of the mix, how often each serves.

    ``total`` is the size aimed at; by default the largest one that meets all shares, and a total beyond it
    leaves the scarcest sources short. Sizes miss the quotas by at most half a record at either end of a pattern, source and
    repetition. Copies of a text within a source serve as one record, represented by the smallest
    ``doc_id``. Null and empty texts, null sources and sources without a target stay out; without
    any record the result is empty. A record serves the stretch of tokens that holds its middle.
    """
    if not targets or len(targets) > MAX_SOURCES or len({t.source for t in targets}) < len(targets):
        raise ValueError(f"between 1 and {MAX_SOURCES} distinct sources are needed")
    spark = docs.sparkSession
    index = F.create_map(*[F.lit(x) for i, t in enumerate(targets) for x in (t.source, i)])
    known = docs.select("doc_id", "text", F.try_element_at(index, F.col("source")).alias("__i")).where("__i is not null and text <> ''")
    sized = encode(known.select("doc_id", "__i", F.sha2("text", 256).alias("text_key"), "text"), out="tokens", count_only=True, **tokenizer)
    per_source = sized.groupBy("text_key", "__i").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").cast("long").alias("tokens"))
    records = per_source.groupBy("text_key").agg(
        F.bit_or(F.expr("shiftleft(1, __i)")).alias("pattern"),
        F.first("tokens").alias("tokens"),
        F.map_from_entries(F.collect_list(F.struct("__i", "doc_id"))).alias("ids"),
    )
    records = cut_lineage(records.withColumn("position", _position(seed, "text_key")))
    sizes = {r["pattern"]: int(r["tokens"]) for r in records.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    best = largest_total(sizes, targets)
    routed = route(sizes, targets, best if total is None else total)[1]
    # per pattern and repetition the sources take consecutive stretches of the running total
    stretches, end = [], {}
    for (p, i, r), amount in sorted(routed.items(), key=lambda x: (x[0][0], x[0][2], x[0][1])):
        start = end.get((p, r), 0)
        end[p, r] = start + amount
        stretches.append((p, i, start, start + amount))
    plan = spark.createDataFrame(stretches, "pattern int, __i int, __start long, __end long")
    middle = F.col("upto") - F.col("tokens") / 2
    uses = _running_total(records).join(F.broadcast(plan), "pattern").where((middle >= F.col("__start")) & (middle < F.col("__end")))
    names = F.array(*[F.lit(t.source) for t in targets])
    return uses.groupBy("text_key", "__i").agg(F.first(F.element_at("ids", F.col("__i"))).alias("doc_id"), F.count("*").cast("int").alias("repeats"), F.first("tokens").alias("tokens")).select(
        "doc_id", names[F.col("__i")].alias("source"), "repeats", "tokens"
    )


def report(mixed: DataFrame, targets: list[Target]) -> DataFrame:
    """``(source, target_share, actual_share, tokens, documents, max_repeats, most_repeats)`` of a mix, one row per target."""
    spark = mixed.sparkSession
    aim = spark.createDataFrame([(t.source, t.share, t.repeats) for t in targets], "source string, target_share double, max_repeats int")
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = by.agg(F.sum("tokens").alias("__all"))
    got = aim.join(F.broadcast(by), "source", "left").crossJoin(F.broadcast(whole))  # one row
    return got.select(
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        "max_repeats",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )


def _targets(spark, sf_dir: str) -> list[Target]:
    rows = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    return sorted((Target(*r) for r in rows), key=lambda t: t.source)


def p7_mix(spark, sf_dir: str) -> DataFrame:
    """The documents of the largest mix that meets every target share."""
    return mix(widen(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), _targets(spark, sf_dir))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return report(p7_mix(spark, sf_dir), _targets(spark, sf_dir))
