"""Call graphs, components, layers and outlines."""

import random

from scriptoria.operators import callgraph as G
from scriptoria.operators import graphs as R
from scriptoria.operators import outline as O


def symbols(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "symbol_id long, module_id string, parent_id long, kind string, name string, qualname string, signature string, calls array<string>, ord int, target string")


ROWS = [
    (1, "m", None, "function", "alpha", "alpha", "alpha()", ["beta", "os.path", "beta", "alpha"], 0),
    (2, "m", None, "function", "beta", "beta", "beta()", [], 1),
    (3, "m", None, "class", "W", "W", None, None, 2),
    (4, "m", 3, "method", "build", "W.build", "build(self)", ["self.render", "alpha", None], 0),
    (5, "m", 3, "method", "render", "W.render", "render(self)", None, 1),
    (6, "m", None, "function", "render", "V.render", "render()", ["W.render"], 4),
    (7, "n", None, "function", "beta", None, None, ["gone"], 0),
    (8, None, None, "function", "lost", "lost", None, ["beta"], 0),
    (9, "n", None, "function", None, None, None, ["beta"], 1),
]


def test_call_graph(spark):
    defs = G.callables(symbols(spark, ROWS))
    assert defs.count() == 6
    resolved = {(r["module_id"], r["source"], r["raw"]): r["target"] for r in G.resolve_calls(defs).collect()}
    assert resolved["m", "alpha", "beta"] == "beta" and resolved["m", "alpha", "os.path"] is None and resolved["m", "W.build", "self.render"] == "W.render" and resolved["n", "beta", "gone"] is None
    edges = G.edges(G.resolve_calls(defs))
    got = {(r["module_id"], r["source"], r["target"], r["external"]) for r in edges.collect()}
    assert ("m", "alpha", "alpha", True) in got and ("m", "W.build", "W.render", False) in got and ("m", "V.render", "W.render", False) in got
    nodes = {(r["qualname"], r["external"]) for r in G.nodes(defs, edges).where("module_id = 'm'").collect()}
    assert nodes == {("alpha", False), ("beta", False), ("W.build", False), ("W.render", False), ("V.render", False), ("os.path", True), ("alpha", True)}
    assert {r["qualname"]: r["n"] for r in G.called_by(edges).collect()} == {"beta": 1, "W.render": 2, "alpha": 1}
    degrees = {(r["module_id"], r["qualname"]): (r["calls_out"], r["calls_external"], r["calls_in"]) for r in G.degrees(defs, edges).collect()}
    assert degrees["m", "alpha"] == (1, 2, 1) and degrees["m", "beta"] == (0, 0, 1)
    assert [(r["cluster"], r["members"]) for r in G.clusters(G.nodes(defs, edges)).collect()] == [("W", 2)]
    assert [r["qualname"] for r in G.most_called(edges, 1).where("module_id = 'm'").collect()] == ["W.render"]
    empty = G.callables(symbols(spark, []))
    assert G.edges(G.resolve_calls(empty)).count() == 0


def brute_components(names, links):
    group = {n: {n} for n in names}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {n: min(group[n]) for n in names}


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    for kind in range(4):
        n = 120
        if kind == 0:
            links = [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(90)]
        elif kind == 1:
            links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(n)]  # a chain
        elif kind == 2:
            links = [("n000", f"n{i:03}") for i in range(n)] + [("x", "y")]  # a hub
        else:
            links = [("z", "z"), ("a", "b"), ("b", "a"), ("b", "a")]
        names = {x for e in links for x in e}
        df = spark.createDataFrame([*links, (None, "q"), ("q", None)], "source string, target string")
        got = {r["node"]: r["component"] for r in R.components(df).collect()}
        assert got == brute_components(names, links), kind
    assert R.components(spark.createDataFrame([], "source string, target string")).count() == 0


def test_components_that_tasks_share(spark):
    rng = random.Random(11)
    names = [f"{c}{i}" for c in ("n", "é", "\uffff", "\U0001f600") for i in range(60)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(170)] + [(names[0], x) for x in names[::9]] + [("only", "only")]
    df = spark.createDataFrame(links, "source string, target string").repartition(5)
    expect = {a.decode(): b.decode() for a, b in brute_components({x.encode() for e in links for x in e}, [(a.encode(), b.encode()) for a, b in links]).items()}
    for held in (1, 2000, 64 << 20):  # one link at once, several, a task's
        got = [(r["node"], r["component"]) for r in R.components(df, held=held).collect()]
        assert len(got) == len(expect) and dict(got) == expect, held


def call_components(spark, rows, folder):
    from pyspark.sql import functions as F
    from scriptoria.queries import code

    symbols(spark, rows).withColumn("ingested_at", F.lit(0)).write.parquet(f"{folder}/symbols.parquet")
    return [tuple(r) for r in code.call_components(spark, str(folder)).collect()]


def test_components_of_modules_whose_names_meet(spark, tmp_path):
    call = lambda i, module, name, calls: (i, module, None, "function", name, name, None, calls, 0)
    rows = [call(1, "a", "b/c", ["x"]), call(2, "a/b", "c", ["y", "self.c"]), call(3, "z", "q", ["q"]), call(4, "z", "idle", []), *[call(9 + i, f"o{i}", "f", ["g"]) for i in range(40)]]
    expect = {**dict.fromkeys(["a/b/c", "a/x", "a/b/y", "a/b/self.c"], "a/b/c"), "z/q": "z/q", **{f"o{i}/{n}": f"o{i}/f" for i in range(40) for n in "fg"}}
    got = call_components(spark, rows, tmp_path)
    assert len(got) == len(expect) and dict(got) == expect


def test_components_leave_less_on_disk_than_the_budget(spark, data):
    from pathlib import Path

    from scriptoria.queries import code

    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        each = sc.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = shuffled()
    assert code.call_components(spark, data).count() > 0
    assert 0 < shuffled() - before < 4 * Path(data, "symbols.parquet").stat().st_size


def test_layers_levels_and_groups(spark):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")]
    assert R.layers_of("abcd", links) == R.levels_of("abcd", links) == {"a": 0, "b": 1, "c": 2, "d": 0}
    cyclic = [("a", "b"), ("b", "a"), ("b", "c"), ("s", "a")]
    assert R.levels_of("abcs", cyclic) == {"s": 0, "a": 1, "b": 2, "c": 3}
    assert R.layers_of("abcs", cyclic)["s"] == 0 and R.layers_of("ab", [("a", "b"), ("b", "a")]) == {"a": 0, "b": 1}
    assert R.components_of("abc", [("a", "b")]) == {"a": 0, "b": 0, "c": 1} and R.layers_of("", []) == {}
    nodes = spark.createDataFrame([("m", n) for n in "abcd"] + [("k", "a")], "scope string, qualname string")
    edges = spark.createDataFrame([("m", a, b) for a, b in links], "scope string, source string, target string")
    got = {(r["scope"], r["qualname"]): r["value"] for r in R.solve_groups(nodes, edges, "scope", "layer").collect()}
    assert got == {("m", "a"): 0, ("m", "b"): 1, ("m", "c"): 2, ("m", "d"): 0, ("k", "a"): 0}


def test_outlines_and_navigation(spark):
    modules = spark.createDataFrame([("m", "mod"), ("e", None)], "module_id string, name string")
    got = {r["module_id"]: r["outline"] for r in O.module_outline(modules, symbols(spark, ROWS)).collect()}
    assert got["m"] == "- module mod\n  - class W\n    - method build\n    - method render\n  - function alpha\n  - function beta\n  - function render"
    assert got["e"] == "- module \n  (no classes or functions defined)"
    files = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("z.py",), ("a/b/x.py",), (None,), ("",), ("c/x.ts",)], "path string")
    assert {r["folder"]: r["entries"] for r in O.navigation(files, "path").collect()} == {"": "z.py a/ c/", "a": "y.py b/", "a/b": "x.py", "c": "x.ts"}
    assert {r["path"]: r["link"] for r in O.page_links(files, "path").collect()}["a/b/x.py"] == "a/b/x.html"
    assert [(r["stem"], r["n"]) for r in O.name_collisions(files, "path").collect()] == [("x", 2)]
    assert {r["folder"]: r["files"] for r in O.folder_sizes(files, "path").collect()} == {"": 1, "a": 1, "a/b": 1, "c": 1}
