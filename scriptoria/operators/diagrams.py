"""Drawings of call graphs and block diagrams: positions, extents and SVG.

A drawing shows one module, so its nodes form one small group; everything is computed group by group in Arrow batches.
"""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import unicode_slug
from scriptoria.operators.graphs import components_of, layers_of, levels_of
from scriptoria.sinks.pages import wrapped

#: Distances between layers and rows, size of a box, and margin, in pixels.
COLUMN, ROW, WIDTH, HEIGHT, MARGIN = 260.0, 84.0, 200.0, 48.0, 40.0

POSITIONS = "scope string, qualname string, external boolean, component int, layer int, x double, y double"


def positions_of(nodes: list[tuple[str, bool]], links: list[tuple[str, str]]) -> list[tuple[str, bool, int, int, float, float]]:
    """``(name, external, component, layer, x, y)``: inner nodes by component and layer, external ones in a last column.

    Components stand below each other; in a layer nodes are in name order.
    """
    inner = sorted({n for n, external in nodes if not external})
    outer = sorted({n for n, external in nodes if external})
    known = set(inner)
    near = [(a, b) for a, b in links if a in known and b in known]
    part, layer = components_of(inner, near), layers_of(inner, near)
    out, top, last = [], MARGIN, -1
    for k in sorted(set(part.values())):
        rows: dict[int, int] = {}
        for n in inner:
            if part[n] == k:
                row = rows[layer[n]] = rows.get(layer[n], -1) + 1
                out.append((n, False, k, layer[n], MARGIN + layer[n] * COLUMN, top + row * ROW))
                last = max(last, layer[n])
        top += (max(rows.values()) + 1) * ROW + ROW / 2
    out += [(n, True, -1, last + 1, MARGIN + (last + 1) * COLUMN, MARGIN + i * ROW) for i, n in enumerate(outer)]
    return out


def _groups(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    n = nodes.select(F.col(scope).cast("string").alias("scope"), F.col("qualname").alias("a"), F.lit(None).cast("string").alias("b"), F.col("external"))
    return n.unionByName(edges.select(F.col(scope).cast("string").alias("scope"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("boolean").alias("external")))


def _parts(pdf: pd.DataFrame) -> tuple[list[tuple[str, bool]], list[tuple[str, str]]]:
    link = pdf["b"].notna()
    return [(a, bool(e)) for a, e in zip(pdf.loc[~link, "a"], pdf.loc[~link, "external"])], list(zip(pdf.loc[link, "a"], pdf.loc[link, "b"]))


def positions(nodes: DataFrame, edges: DataFrame, scope: str = "module_id") -> DataFrame:
    """Positions of the nodes of each scope's call graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["scope"].iloc[0], *p) for p in positions_of(*_parts(pdf))]
        return pd.DataFrame(rows, columns=["scope", "qualname", "external", "component", "layer", "x", "y"])

    return _groups(nodes, edges, scope).groupBy("scope").applyInPandas(run, POSITIONS)


def extents(placed: DataFrame) -> DataFrame:
    """``(scope, cluster, left, top, right, bottom)`` of the clusters of two and more inner nodes."""
    rows = placed.where("not external").select("scope", F.split("qualname", "[.]")[0].alias("cluster"), "x", "y")
    box = rows.groupBy("scope", "cluster").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + WIDTH).alias("right"), (F.max("y") + HEIGHT).alias("bottom"), F.count("*").alias("n"))
    return box.where("n >= 2").drop("n")


def _box(x: float, y: float, label: str, kind: str) -> str:
    lines = wrapped(label)
    text = "".join(f'<tspan x="{x + WIDTH / 2:g}" dy="{0 if i == 0 else 14}">{escape(t)}</tspan>' for i, t in enumerate(lines))
    return f'<g class="{kind}"><rect x="{x:g}" y="{y:g}" width="{WIDTH:g}" height="{HEIGHT:g}"/><text x="{x + WIDTH / 2:g}" y="{y + HEIGHT / 2 - 7 * (len(lines) - 1):g}">{text}</text></g>'


def drawn(places: dict[str, tuple[float, float, str]], links: list[tuple[str, str]]) -> str:
    """An SVG of boxes ``{name: (x, y, kind)}`` and lines between them; links of unknown names are left out."""
    if not places:
        return ""
    right, bottom = max(x for x, _, _ in places.values()) + WIDTH + MARGIN, max(y for _, y, _ in places.values()) + HEIGHT + MARGIN
    lines = "".join(
        f'<line x1="{places[a][0] + WIDTH:g}" y1="{places[a][1] + HEIGHT / 2:g}" x2="{places[b][0]:g}" y2="{places[b][1] + HEIGHT / 2:g}"/>' for a, b in sorted(set(links)) if a in places and b in places
    )
    boxes = "".join(_box(x, y, name, kind) for name, (x, y, kind) in sorted(places.items()))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {right:g} {bottom:g}">{lines}{boxes}</svg>'


def call_graph_svg(nodes: DataFrame, edges: DataFrame, scope: str = "module_id") -> DataFrame:
    """``(scope, svg)``: a drawing of each scope's call graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, links = _parts(pdf)
        places = {n: (x, y, "external" if e else "callable") for n, e, _, _, x, y in positions_of(names, links)}
        return pd.DataFrame({"scope": [pdf["scope"].iloc[0]], "svg": [drawn(places, links)]})

    return _groups(nodes, edges, scope).groupBy("scope").applyInPandas(run, "scope string, svg string")


def block_links(models: DataFrame, id_col: str = "module_id") -> DataFrame:
    """``(id, source, target)``: connections between blocks, ports dropped; ends that name no block are left out."""
    rows = models.where("model is not null").select(id_col, F.col("model.blocks.name").alias("__names"), F.explode("model.connections").alias("c"))
    ends = rows.select(id_col, "__names", F.split("c.source", ":")[0].alias("source"), F.split("c.target", ":")[0].alias("target"))
    return ends.where(F.array_contains("__names", F.col("source")) & F.array_contains("__names", F.col("target"))).select(id_col, "source", "target")


def block_degrees(models: DataFrame, id_col: str = "module_id") -> DataFrame:
    """``(id, block, links_in, links_out)`` of every block, zeros included."""
    links = block_links(models, id_col)
    blocks = models.where("model is not null").select(id_col, F.explode("model.blocks.name").alias("block")).distinct()
    into = links.groupBy(id_col, F.col("target").alias("block")).agg(F.count("*").alias("links_in"))
    out = links.groupBy(id_col, F.col("source").alias("block")).agg(F.count("*").alias("links_out"))
    return blocks.join(into, [id_col, "block"], "left").join(out, [id_col, "block"], "left").na.fill(0)


def block_diagram_svg(models: DataFrame, id_col: str = "module_id") -> DataFrame:
    """``(id, anchor, svg)``: a drawing of each block diagram, in columns by level."""

    @F.pandas_udf("string")
    def draw(rows: pd.DataFrame) -> pd.Series:
        out = []
        for blocks, links in zip(rows["blocks"], rows["connections"]):
            names = [b["name"] for b in (blocks if blocks is not None else [])]
            ends = [(c["source"].split(":")[0], c["target"].split(":")[0]) for c in (links if links is not None else [])]
            level = levels_of(names, ends)
            rank: dict[int, int] = {}
            places = {}
            for n in sorted(level):
                row = rank[level[n]] = rank.get(level[n], -1) + 1
                places[n] = (MARGIN + level[n] * COLUMN, MARGIN + row * ROW, "block")
            out.append(drawn(places, ends))
        return pd.Series(out, dtype=object)

    shown = models.where("model is not null")
    return shown.select(id_col, unicode_slug(F.col("model.name")).alias("anchor"), draw(F.struct("model.blocks", "model.connections")).alias("svg"))
