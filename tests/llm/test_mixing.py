"""Problem 7."""

import heapq
import itertools
import random
import time

import pytest

from scriptoria.llm.mixing import Target, largest_total, mix, report, route

TARGETS = [Target("a", 0.5, 1), Target("b", 0.3, 2), Target("c", 0.2, 3)]


class Flow:
    """Min-cost max-flow by successive cheapest paths with potentials; integer capacities."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for tail, head, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[tail].append(len(self.to))
            self.to.append(head)
            self.room.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and (x := d + self.cost[e] + potential[a] - potential[b]) < far[b]:
                        far[b], via[b] = x, e
                        heapq.heappush(heap, (x, b))
            if via[sink] < 0:
                return total
            potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
            push, at = None, sink
            while at != source:
                push = self.room[via[at]] if push is None else min(push, self.room[via[at]])
                at = self.to[via[at] ^ 1]
            at = sink
            while at != source:
                self.room[via[at]] -= push
                self.room[via[at] ^ 1] += push
                at = self.to[via[at] ^ 1]
            total += push


def by_paths(tokens, targets, total):
    """Tokens routed and their cost, by successive cheapest paths over all arcs."""
    patterns = sorted(p for p, c in tokens.items() if c > 0)
    levels = [(p, r) for p in patterns for r in range(1, min(t.repeats for i, t in enumerate(targets) if p >> i & 1) + 1)]
    net = Flow(2 + len(levels) + len(targets))
    first = []
    for n, (p, r) in enumerate(levels, 2):
        first.append((net.arc(0, n, tokens[p], r - 1), r))
        for i in range(len(targets)):
            if p >> i & 1:
                net.arc(n, 2 + len(levels) + i, tokens[p], 0)
    for i, t in enumerate(targets):
        net.arc(2 + len(levels) + i, 1, round(total * t.share), 0)
    return net.run(0, 1), sum(net.room[a ^ 1] * (r - 1) for a, r in first)


def test_flow_is_cheapest_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        caps = [rng.randint(0, 4) for _ in range(3)]
        costs = [rng.randint(0, 3) for _ in range(3)]
        need = rng.randint(0, 6)
        net = Flow(3)
        arcs = [net.arc(0, 1, c, w) for c, w in zip(caps, costs)]
        net.arc(1, 2, need, 0)
        got = net.run(0, 2)
        assert got == min(need, sum(caps))
        best = min(sum(x * w for x, w in zip(xs, costs)) for xs in itertools.product(*(range(c + 1) for c in caps)) if sum(xs) == got)
        assert sum(net.room[a ^ 1] * w for a, w in zip(arcs, costs)) == best


def test_route_is_as_large_and_cheap_as_by_paths():
    rng = random.Random(5)
    for _ in range(60):
        k = rng.randint(1, 5)
        targets = [Target(str(i), 1 / k, rng.randint(1, 4)) for i in range(k)]
        sizes = {p: rng.randint(0, 60) for p in range(1, 1 << k) if rng.random() < 0.6}
        best = largest_total(sizes, targets)
        for total in (best, best // 2, best + 40):
            routed, flows = route(sizes, targets, total)
            want, cost = by_paths(sizes, targets, total)
            assert (routed, sum(n * (r - 1) for (_, _, r), n in flows.items())) == (want, cost) and sum(flows.values()) == routed
            assert all(sum(n for (q, _, s), n in flows.items() if (q, s) == (p, r)) <= sizes[p] for p, _, r in flows)
        meets = lambda n: by_paths(sizes, targets, n)[0] >= sum(round(n * t.share) for t in targets)
        assert meets(best) and not meets(best + 2 * k)


def test_sixteen_sources_of_all_patterns():
    rng = random.Random(6)
    targets = [Target(str(i), s / 136, 1 + i % 4) for i, s in enumerate(range(1, 17))]
    sizes = {p: rng.randint(1, 10_000) for p in range(1, 1 << 16)}
    began = time.time()
    total = largest_total(sizes, targets)
    assert route(sizes, targets, total)[0] == sum(round(total * t.share) for t in targets) and time.time() - began < 60
    assert largest_total({}, targets) == 0 and route({}, targets, 5) == (0, {})


def test_route_meets_quotas_and_caps():
    sizes = {0b001: 1000, 0b010: 150, 0b100: 90, 0b011: 100}
    total = largest_total(sizes, TARGETS)
    routed, flows = route(sizes, TARGETS, total)
    assert routed == sum(round(total * t.share) for t in TARGETS)
    for (p, i, r), amount in flows.items():
        assert p >> i & 1 and r <= min(t.repeats for k, t in enumerate(TARGETS) if p >> k & 1) and amount <= sizes[p]
    assert route(sizes, TARGETS, total * 3)[0] < sum(round(total * 3 * t.share) for t in TARGETS)


def documents(spark, n=600, extra=()):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["cache", "row", "key", "table"], k=rng.randint(5, 40))) + f" {i}", rng.choice("aaaabbc")) for i in range(n)]
    rows += [(10_000 + i, rows[i][1], "b") for i in range(0, 60)]  # the same texts in another source
    return spark.createDataFrame([(*r, 7, "x") for r in [*rows, *extra]], "doc_id long, text string, source string, tokens int, pattern string")


def test_shares_and_repeats(spark):
    df = documents(spark, extra=[(1, None, "a"), (2, "", "a"), (3, "no source", None), (4, "other", "zzz")])
    mixed = mix(df, TARGETS, seed=1)
    rows = mixed.collect()
    limits = {t.source: t.repeats for t in TARGETS}
    assert all(1 <= r["repeats"] <= limits[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    for r in report(mixed, TARGETS).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.02 and r["most_repeats"] <= r["max_repeats"]
    seeded = lambda n: {(r["doc_id"], r["repeats"]) for r in mix(df, TARGETS, seed=n, total=3000).collect()}
    assert seeded(1) == seeded(1) != seeded(2)


def test_total_and_empty(spark):
    df = documents(spark)
    got = sum(r["tokens"] for r in report(mix(df, TARGETS, total=2000), TARGETS).collect())
    assert abs(got - 2000) < 150
    empty = mix(df.limit(0), TARGETS)
    assert empty.count() == 0 and [r["actual_share"] for r in report(empty, TARGETS).collect()] == [0.0] * 3


def test_bad_targets(spark):
    for targets in ([], [TARGETS[0], TARGETS[0]], [Target(str(i), 0.01, 1) for i in range(17)]):
        with pytest.raises(ValueError):
            mix(documents(spark, 60), targets)
