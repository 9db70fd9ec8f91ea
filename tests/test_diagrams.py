"""Drawings."""

from scriptoria import parsers as P
from scriptoria.operators import diagrams as D


def test_positions():
    rows = {r[0]: r[1:] for r in D.positions_of([("a", False), ("b", False), ("c", False), ("os.x", True)], [("a", "b"), ("a", "os.x")])}
    assert rows["a"][1:3] == (0, 0) and rows["b"][1:3] == (0, 1) and rows["c"][1] == 1 and rows["os.x"] == (True, -1, 2, D.MARGIN + 2 * D.COLUMN, D.MARGIN)
    assert len({(r[3], r[4]) for r in rows.values()}) == 4 and D.positions_of([], []) == [] and D.drawn({}, []) == ""


def test_call_graph_drawing(spark):
    nodes = spark.createDataFrame([("m", "W.a", False), ("m", "W.b", False), ("m", "x<y", True), ("n", "f", False)], "module_id string, qualname string, external boolean")
    edges = spark.createDataFrame([("m", "W.a", "W.b", False), ("m", "W.b", "x<y", True)], "module_id string, source string, target string, external boolean")
    placed = D.positions(nodes, edges)
    assert placed.count() == 4 and [(r["cluster"], r["left"], r["right"]) for r in D.extents(placed).collect()] == [("W", D.MARGIN, D.MARGIN + D.COLUMN + D.WIDTH)]
    svg = {r["scope"]: r["svg"] for r in D.call_graph_svg(nodes, edges).collect()}
    assert svg["m"].count("<rect") == 3 and svg["m"].count("<line") == 2 and "x&lt;y" in svg["m"] and svg["n"].count("<rect") == 1
    assert D.positions(nodes.limit(0), edges.limit(0)).count() == 0


def test_block_diagrams(spark):
    mdl = 'Model {\n Name "Main model"\n Block {\n  BlockType "Gain"\n  Name "G"\n }\n Block {\n  BlockType "Sum"\n  Name "S"\n }\n}\n'
    df = spark.createDataFrame([("a.mdl", "simulink", mdl), ("b.py", "python", "x = 1")], "module_id string, language string, content string")
    models = P.modules_of(P.parse_files(df, path_col="module_id"))
    row = D.block_diagram_svg(models).first()
    assert row["anchor"] == "main-model" and row["svg"].count("<rect") == 2 and D.block_links(models).count() == 0
    assert {(r["block"], r["links_in"], r["links_out"]) for r in D.block_degrees(models).collect()} == {("G", 0, 0), ("S", 0, 0)}
    linked = spark.createDataFrame([("m", ("M", [("A", "t", []), ("B", "t", [])], [("A:1", "B:2"), ("A", "gone")]))], "module_id string, model struct<name:string,blocks:array<struct<name:string,type:string,parameters:array<struct<name:string,value:string>>>>,connections:array<struct<source:string,target:string>>>")
    assert [(r["source"], r["target"]) for r in D.block_links(linked).collect()] == [("A", "B")] and D.block_diagram_svg(linked).first()["svg"].count("<line") == 1
