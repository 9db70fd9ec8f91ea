"""Queries over modules and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria import parsers
from scriptoria.functions import text as T
from scriptoria.operators import diagrams as D
from scriptoria.operators import callgraph as G
from scriptoria.operators import graphs as R
from scriptoria.operators import outline as O
from scriptoria.plans.models import Extractive
from scriptoria.plans.summarise import summarise
from scriptoria.runtime import first_delivery, spread, table
from scriptoria.sinks import pages as S


def _symbols(spark, sf, *columns):
    return first_delivery(table(spark, sf, "symbols").select("symbol_id", *columns, "ingested_at"), "symbol_id").drop("ingested_at")


def _defs(spark, sf):
    return G.callables(_symbols(spark, sf, "module_id", "kind", "name", "qualname", "signature", "calls", "ord"))


def _edges(spark, sf):
    return G.edges(G.resolve_calls(_defs(spark, sf)))


def resolved_calls(spark, sf):
    return G.resolve_calls(_defs(spark, sf))


def call_edges(spark, sf):
    return _edges(spark, sf)


def call_nodes(spark, sf):
    return G.nodes(_defs(spark, sf), _edges(spark, sf)).select("module_id", "qualname", "external")


def callers(spark, sf):
    return G.called_by(_edges(spark, sf)).select("module_id", "qualname", F.array_join("callers", " ").alias("callers"), "n")


def call_degrees(spark, sf):
    return G.degrees(_defs(spark, sf), _edges(spark, sf))


def call_clusters(spark, sf):
    return G.clusters(G.nodes(_defs(spark, sf), _edges(spark, sf)))


def call_layers(spark, sf):
    d = _defs(spark, sf)
    e = G.edges(G.resolve_calls(d))
    return R.solve_groups(G.nodes(d, e), e, "module_id", "layer").withColumnRenamed("value", "layer")


def call_levels(spark, sf):
    d = _defs(spark, sf)
    e = G.edges(G.resolve_calls(d))
    return R.solve_groups(G.nodes(d, e), e, "module_id", "level").withColumnRenamed("value", "level")


def call_components(spark, sf):
    """Components of callables over all modules: names are joined with their module.

    Symbols are spread by module once, so that calls are resolved and contracted where they lie.
    """
    s = spread(_symbols(spark, sf, "module_id", "kind", "name", "qualname", "signature", "calls", "ord"), "module_id")
    e = G.links(G.resolve_calls(G.callables(s)))
    key = lambda c: F.concat("module_id", F.lit("/"), c)
    return R.components(e.select(key(F.col("source")).alias("source"), key(F.col("target")).alias("target")))


def call_positions(spark, sf):
    d = _defs(spark, sf)
    e = G.edges(G.resolve_calls(d))
    return D.positions(G.nodes(d, e), e)


def call_extents(spark, sf):
    return D.extents(call_positions(spark, sf))


def call_drawings(spark, sf):
    d = _defs(spark, sf)
    e = G.edges(G.resolve_calls(d))
    return D.call_graph_svg(G.nodes(d, e), e)


def most_called(spark, sf):
    return G.most_called(_edges(spark, sf), 3).select("module_id", "qualname", "n", F.col("rank").cast("long").alias("rank"))


def project_components(spark, sf):
    """Components of the graph that links projects with the languages of their documents."""
    d = table(spark, sf, "documents").where("project is not null and lang is not null").select("project", "lang").distinct()
    return R.components(d.select(F.concat(F.lit("p:"), "project").alias("source"), F.concat(F.lit("l:"), "lang").alias("target")))


def module_outlines(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "name", "ingested_at"), "module_id").drop("ingested_at")
    return O.module_outline(m, _symbols(spark, sf, "module_id", "parent_id", "kind", "name", "ord"))


def class_members(spark, sf):
    return O.member_bullets(_symbols(spark, sf, "parent_id", "name", "summary", "ord"))


def last_module_summary(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "name", F.coalesce("module_docstring", "header").alias("summary"), F.struct("scanned_at", "module_id").alias("o"), "ingested_at"), "module_id")
    return O.last_summaries(m, "o")


def function_prompts(spark, sf):
    return O.function_prompt(_symbols(spark, sf, "qualname", "signature", "returns", "docstring", "source"))


def navigation(spark, sf):
    return O.navigation(table(spark, sf, "modules"), "relpath").select("folder", F.col("depth").cast("long").alias("depth"), "entries")


def page_links(spark, sf):
    return O.page_links(table(spark, sf, "modules"), "relpath")


def stem_collisions(spark, sf):
    return O.name_collisions(table(spark, sf, "modules"), "relpath")


def folder_sizes(spark, sf):
    return O.folder_sizes(table(spark, sf, "modules"), "relpath")


def _parsed(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "language", "relpath", "source", "ingested_at"), "module_id")
    return parsers.parse_files(spread(m.where("source is not null")), content_col="source", path_col="relpath")


def parsed_symbols(spark, sf):
    return parsers.symbols_of(_parsed(spark, sf))


def parsed_modules(spark, sf):
    return parsers.modules_of(_parsed(spark, sf)).drop("model")


def parse_rejects(spark, sf):
    return parsers.rejects_of(_parsed(spark, sf))


def module_pages(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "name", "relpath", "module_docstring", "header", "ingested_at"), "module_id")
    return S.module_pages(m, table(spark, sf, "symbols"))


def manual_pages(spark, sf):
    return S.manual_pages(first_delivery(table(spark, sf, "manual_sections"), "section_id"), "manual_id")


def document_summaries(spark, sf):
    """Documents summarised by the deterministic stand-in under a small budget: chunks, waves, merges."""
    return summarise(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), Extractive(), context=160, chunk=60)


def table_deliveries(spark, sf):
    """Rows and keys of the tables with repeated deliveries."""
    parts = [table(spark, sf, t).agg(F.lit(t).alias("t"), F.count("*").alias("n"), F.count_distinct(k).alias("keys")) for t, k in (("modules", "module_id"), ("symbols", "symbol_id"), ("manual_sections", "section_id"), ("evidence", "evidence_id"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_DEFS = """
WITH s AS (SELECT DISTINCT symbol_id, module_id, name, coalesce(qualname, name) AS qualname, coalesce(signature, '<null>') AS signature, coalesce(calls, []) AS calls, coalesce(ord, 0) AS ord FROM symbols WHERE kind IN ('function', 'method') AND module_id IS NOT NULL AND coalesce(name, '') <> ''),
defs AS (SELECT module_id, qualname, arg_max(calls, ord) AS calls, min(ord) AS ord FROM s GROUP BY module_id, qualname),
calls AS (SELECT DISTINCT module_id, qualname AS source, unnest(calls) AS raw FROM defs),
cand AS (SELECT c.module_id, c.source, c.raw, d.qualname, d.ord, count(d.qualname) OVER (PARTITION BY c.module_id, c.source, c.raw) AS n,
  list_max([0] || list_transform(range(1, len(string_split(c.source, '.')) + 1), lambda k: CASE WHEN starts_with(d.qualname, array_to_string(string_split(c.source, '.')[1:k], '.') || '.') THEN k ELSE 0 END)) AS plen
  FROM calls c LEFT JOIN defs d ON d.module_id = c.module_id AND string_split(d.qualname, '.')[-1] = string_split(c.raw, '.')[-1]),
best AS (SELECT *, row_number() OVER (PARTITION BY module_id, source, raw ORDER BY plen DESC, ord, qualname) AS r FROM cand),
resolved AS (SELECT b.module_id, b.source, b.raw, coalesce(x.qualname, CASE WHEN n = 1 OR plen > 0 THEN b.qualname END) AS target FROM best b LEFT JOIN defs x ON x.module_id = b.module_id AND x.qualname = b.raw WHERE r = 1),
edges AS (SELECT DISTINCT module_id, source, CASE WHEN target IS NOT NULL AND target <> source THEN target ELSE raw END AS target, NOT (target IS NOT NULL AND target <> source) AS external FROM resolved)
"""

def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{T.BLANK}+', ''), '{T.BLANK}+$', '')"


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _paragraphs(x: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter(list_transform(string_split({_escaped(x)}, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> ''), lambda p: '<p>' || replace(p, chr(10), '<br/>') || '</p>'), chr(10)), '')"


def _page(title: str, body: str) -> str:
    """A page as an SQL expression: what the template gives for these parts."""
    head = "'<!-- Generated by scriptoria -->~<!DOCTYPE html>~<html lang=\"en\">~<head>~<meta charset=\"utf-8\">~<title>' || {t} || '</title>~<link rel=\"stylesheet\" href=\"static/style.css\">~</head>~<body>~<div class=\"sidebar\"></div>~<main>~<h1>' || {t} || '</h1>~' || {b} || '~</main>~</body>~</html>~'"
    return head.replace("~", "' || chr(10) || '").replace("{t}", title).replace("{b}", body)


#: Longest paths in the part of each graph that no cycle reaches; ``behind``: nodes on or behind a cycle.
_PATHS = """, n AS (SELECT DISTINCT module_id, source AS q FROM edges UNION SELECT module_id, target FROM edges), e AS (SELECT DISTINCT module_id, source AS a, target AS b FROM edges WHERE source <> target),
reach AS (SELECT module_id, a, b FROM e UNION SELECT r.module_id, r.a, e.b FROM reach r JOIN e ON e.module_id = r.module_id AND e.a = r.b),
behind AS (SELECT DISTINCT r.module_id, r.b AS q FROM reach r JOIN reach c ON c.module_id = r.module_id AND c.a = c.b AND c.a = r.a),
depth AS (SELECT n.module_id, n.q, 0 AS d FROM n ANTI JOIN e ON e.module_id = n.module_id AND e.b = n.q UNION SELECT d.module_id, e.b, d.d + 1 FROM depth d JOIN e ON e.module_id = d.module_id AND e.a = d.q ANTI JOIN behind x ON x.module_id = e.module_id AND x.q = e.b),
lv AS (SELECT module_id, q, max(d) AS level FROM depth GROUP BY 1, 2)
"""
#: Places of the nodes where no graph has a cycle.
_PLACES = """, i AS (SELECT DISTINCT module_id, source AS q FROM edges UNION SELECT module_id, target FROM edges WHERE NOT external), o AS (SELECT DISTINCT module_id, target AS q FROM edges WHERE external),
e AS (SELECT DISTINCT x.module_id, source AS a, target AS b FROM edges x SEMI JOIN i ON i.module_id = x.module_id AND i.q = x.target WHERE source <> target),
depth AS (SELECT i.module_id, i.q, 0 AS d FROM i ANTI JOIN e ON e.module_id = i.module_id AND e.b = i.q UNION SELECT d.module_id, e.b, d.d + 1 FROM depth d JOIN e ON e.module_id = d.module_id AND e.a = d.q),
near AS (SELECT module_id, a, b FROM e UNION SELECT module_id, b, a FROM e), joined AS (SELECT module_id, q AS a, q AS b FROM i UNION SELECT j.module_id, j.a, near.b FROM joined j JOIN near ON near.module_id = j.module_id AND near.a = j.b),
part AS (SELECT module_id, a AS q, min(b) AS first FROM joined GROUP BY 1, 2), laid AS (SELECT module_id, q, max(d) AS layer FROM depth GROUP BY 1, 2),
numbered AS (SELECT module_id, q, layer, dense_rank() OVER (PARTITION BY module_id ORDER BY first) - 1 AS component, row_number() OVER (PARTITION BY module_id, first, layer ORDER BY q) - 1 AS r FROM part JOIN laid USING (module_id, q)),
high AS (SELECT module_id, component, (max(r) + 1) * 84.0 + 42.0 AS h FROM numbered GROUP BY 1, 2), tops AS (SELECT module_id, component, 40.0 + coalesce(sum(h) OVER (PARTITION BY module_id ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top FROM high),
last AS (SELECT module_id, max(layer) AS last FROM numbered GROUP BY 1),
places AS (SELECT module_id AS scope, q AS qualname, false AS external, CAST(component AS INTEGER) AS component, CAST(layer AS INTEGER) AS layer, CAST(40.0 + layer * 260.0 AS DOUBLE) AS x, CAST(top + r * 84.0 AS DOUBLE) AS y FROM numbered JOIN tops USING (module_id, component)
  UNION ALL SELECT o.module_id, q, true, -1, CAST(coalesce(last, -1) + 1 AS INTEGER), CAST(40.0 + (coalesce(last, -1) + 1) * 260.0 AS DOUBLE), CAST(40.0 + (row_number() OVER (PARTITION BY o.module_id ORDER BY q) - 1) * 84.0 AS DOUBLE) FROM o LEFT JOIN last USING (module_id))
"""


def matlab_functions(spark, sf):
    """The functions of the parsed MATLAB files."""
    m = table(spark, sf, "modules").select("module_id", "language").where("lower(language) = 'matlab'").distinct()
    return parsed_symbols(spark, sf).join(m, "module_id", "left_semi").select("module_id", "name", "signature", "kind", F.col("lineno").cast("long").alias("lineno"))


def cpp_namespaces(spark, sf):
    """The namespaces of the parsed C++ files."""
    m = table(spark, sf, "modules").select("module_id", "language").where("lower(language) = 'cpp'").distinct()
    return parsed_modules(spark, sf).join(m, "module_id", "left_semi").where("namespace is not null").select("module_id", "namespace")


QUERIES = {
    "resolved_calls": resolved_calls,
    "call_edges": call_edges,
    "call_nodes": call_nodes,
    "callers": callers,
    "call_degrees": call_degrees,
    "call_clusters": call_clusters,
    "call_layers": call_layers,
    "call_levels": call_levels,
    "call_components": call_components,
    "call_positions": call_positions,
    "call_extents": call_extents,
    "call_drawings": call_drawings,
    "most_called": most_called,
    "project_components": project_components,
    "module_outlines": module_outlines,
    "class_members": class_members,
    "last_module_summary": last_module_summary,
    "function_prompts": function_prompts,
    "navigation": navigation,
    "page_links": page_links,
    "stem_collisions": stem_collisions,
    "folder_sizes": folder_sizes,
    "parsed_symbols": parsed_symbols,
    "parsed_modules": parsed_modules,
    "parse_rejects": parse_rejects,
    "module_pages": module_pages,
    "manual_pages": manual_pages,
    "document_summaries": document_summaries,
    "table_deliveries": table_deliveries,
    "matlab_functions": matlab_functions,
    "cpp_namespaces": cpp_namespaces,
}

SQL = {
    "resolved_calls": _DEFS + "SELECT module_id, source, raw, target FROM resolved",
    "call_edges": _DEFS + "SELECT * FROM edges",
    "call_nodes": _DEFS + "SELECT module_id, source AS qualname, false AS external FROM edges UNION SELECT module_id, target, external FROM edges",
    "callers": _DEFS + "SELECT module_id, target AS qualname, string_agg(DISTINCT source, ' ' ORDER BY source) AS callers, count(DISTINCT source) AS n FROM edges WHERE NOT external GROUP BY 1, 2",
    "call_degrees": _DEFS + ", o AS (SELECT module_id, source AS qualname, count(*) FILTER (NOT external) AS calls_out, count(*) FILTER (external) AS calls_external FROM edges GROUP BY 1, 2), i AS (SELECT module_id, target AS qualname, count(*) AS calls_in FROM edges WHERE NOT external GROUP BY 1, 2) SELECT d.module_id, d.qualname, coalesce(calls_out, 0) AS calls_out, coalesce(calls_external, 0) AS calls_external, coalesce(calls_in, 0) AS calls_in FROM defs d LEFT JOIN o USING (module_id, qualname) LEFT JOIN i USING (module_id, qualname)",
    "call_clusters": _DEFS + ", n AS (SELECT module_id, source AS qualname FROM edges UNION SELECT module_id, target FROM edges WHERE NOT external) SELECT module_id, string_split(qualname, '.')[1] AS cluster, count(*) AS members FROM n GROUP BY 1, 2 HAVING count(*) >= 2",
    "most_called": _DEFS + ", c AS (SELECT module_id, target AS qualname, count(*) AS n FROM edges WHERE NOT external GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY n DESC, qualname) AS rank FROM c) SELECT module_id, qualname, n, rank FROM r WHERE rank <= 3",
    "call_components": _DEFS.replace("WITH s AS", "WITH RECURSIVE s AS") + """, k AS (SELECT DISTINCT module_id || '/' || source AS a, module_id || '/' || target AS b FROM edges), l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT a AS node, a AS r FROM l UNION SELECT x.node, l.b FROM reach x JOIN l ON l.a = x.r) SELECT node, min(r) AS component FROM reach GROUP BY node""",
    "project_components": """WITH RECURSIVE e AS (SELECT DISTINCT 'p:' || project AS a, 'l:' || lang AS b FROM documents WHERE project IS NOT NULL AND lang IS NOT NULL), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node""",
    "last_module_summary": "WITH m AS (SELECT DISTINCT module_id, name, coalesce(module_docstring, header) AS summary, scanned_at FROM modules WHERE name IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scanned_at DESC NULLS LAST, module_id DESC) AS r FROM m) SELECT name, summary FROM r WHERE r = 1",
    "class_members": "WITH s AS (SELECT DISTINCT symbol_id, parent_id, coalesce(ord, 0) AS ord, '- ' || coalesce(name, '') || CASE WHEN coalesce(summary, '') <> '' THEN ': ' || summary ELSE '' END AS l FROM symbols WHERE parent_id IS NOT NULL) SELECT parent_id, string_agg(l, chr(10) ORDER BY ord, symbol_id) AS text FROM s GROUP BY parent_id",
    "module_outlines": """WITH m AS (SELECT DISTINCT module_id, name FROM modules), s AS (SELECT DISTINCT symbol_id, module_id, parent_id, kind, coalesce(name, '') AS name, coalesce(ord, 0) AS ord FROM symbols WHERE module_id IS NOT NULL),
t AS (SELECT module_id, parent_id AS symbol_id, string_agg('    - method ' || name, chr(10) ORDER BY ord, symbol_id) AS m FROM s WHERE kind = 'method' AND parent_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT s.module_id, 0 AS r, s.ord, s.symbol_id, '  - class ' || s.name || coalesce(chr(10) || t.m, '') AS l FROM s LEFT JOIN t USING (module_id, symbol_id) WHERE s.kind = 'class' AND s.parent_id IS NULL
  UNION ALL SELECT module_id, 1, ord, symbol_id, '  - function ' || name FROM s WHERE kind = 'function' AND parent_id IS NULL),
b AS (SELECT module_id, string_agg(l, chr(10) ORDER BY r, ord, symbol_id) AS body FROM l GROUP BY module_id)
SELECT m.module_id, '- module ' || coalesce(m.name, '') || chr(10) || coalesce(b.body, '  (no classes or functions defined)') AS outline FROM m LEFT JOIN b USING (module_id)""",
    "function_prompts": "SELECT symbol_id, concat_ws(chr(10), " + ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '{label}' || {c} END" for label, c in (("Name: ", "qualname"), ("Signature: ", "signature"), ("Returns: ", "returns"), ("Docstring: ", "docstring"))) + ", CASE WHEN coalesce(source, '') <> '' THEN 'Code:' || chr(10) || source END) AS prompt FROM (SELECT DISTINCT symbol_id, qualname, signature, returns, docstring, source FROM symbols)",
    "navigation": """WITH p AS (SELECT DISTINCT string_split(relpath, '/') AS p FROM modules WHERE coalesce(relpath, '') <> ''), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM p),
s AS (SELECT DISTINCT coalesce(array_to_string(p[1:n-1], '/'), '') AS folder, n - 1 AS depth, n < len(p) AS dir, p[n] AS name FROM x)
SELECT folder, depth, string_agg(name || CASE WHEN dir THEN '/' ELSE '' END, ' ' ORDER BY dir, name) AS entries FROM s GROUP BY folder, depth""",
    "page_links": r"SELECT DISTINCT relpath, CASE WHEN regexp_matches(relpath, '[^/]\.[^./]+$') THEN regexp_replace(relpath, '\.[^./]+$', '') ELSE relpath END || '.html' AS link FROM modules WHERE coalesce(relpath, '') <> ''",
    "stem_collisions": r"WITH p AS (SELECT DISTINCT relpath, CASE WHEN regexp_matches(relpath, '[^/]\.[^./]+$') THEN regexp_replace(string_split(relpath, '/')[-1], '\.[^.]+$', '') ELSE string_split(relpath, '/')[-1] END AS stem FROM modules WHERE relpath IS NOT NULL) SELECT stem, count(*) AS n FROM p GROUP BY stem HAVING count(*) > 1",
    "folder_sizes": "WITH p AS (SELECT DISTINCT string_split(relpath, '/') AS p FROM modules WHERE relpath IS NOT NULL) SELECT coalesce(array_to_string(p[1:len(p)-1], '/'), '') AS folder, count(*) AS files FROM p GROUP BY 1",
    "table_deliveries": " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, count(DISTINCT {k}) AS keys FROM {t}" for t, k in (("modules", "module_id"), ("symbols", "symbol_id"), ("manual_sections", "section_id"), ("evidence", "evidence_id"))),
    "call_levels": _DEFS.replace("WITH s AS", "WITH RECURSIVE s AS") + _PATHS + "SELECT module_id, q AS qualname, CAST(level AS INTEGER) AS level FROM lv UNION ALL SELECT b.module_id, b.q, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY b.module_id ORDER BY b.q) AS INTEGER) FROM behind b LEFT JOIN (SELECT module_id, max(level) AS top FROM lv GROUP BY 1) m USING (module_id)",
    "call_layers": _DEFS.replace("WITH s AS", "WITH RECURSIVE s AS") + _PATHS + "SELECT module_id, q AS qualname, CAST(level AS INTEGER) AS layer FROM lv",
    "call_positions": _DEFS.replace("WITH s AS", "WITH RECURSIVE s AS") + _PLACES + "SELECT scope, qualname, external, component, layer, x, y FROM places",
    "call_extents": _DEFS.replace("WITH s AS", "WITH RECURSIVE s AS") + _PLACES + "SELECT scope, string_split(qualname, '.')[1] AS cluster, min(x) AS left, min(y) AS top, max(x) + 200.0 AS right, max(y) + 48.0 AS bottom FROM places WHERE NOT external GROUP BY 1, 2 HAVING count(*) >= 2",
    "manual_pages": f"""WITH s AS (SELECT DISTINCT section_id, manual_id, ord, title, body FROM manual_sections), a AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM s),
b AS (SELECT *, CASE WHEN k = '' THEN 'section' ELSE replace(k, ' ', '-') END AS anchor FROM a),
c AS (SELECT manual_id, ord, '<li><a href="#' || anchor || '">' || {_escaped('title')} || '</a></li>' AS toc, '<h2 id="' || anchor || '">' || {_escaped('title')} || '</h2>' || chr(10) || {_paragraphs('body')} AS part FROM b),
d AS (SELECT manual_id, '<ul>' || string_agg(toc, '' ORDER BY ord NULLS FIRST, toc, part) || '</ul>' || chr(10) || string_agg(part, chr(10) ORDER BY ord NULLS FIRST, toc, part) AS body FROM c GROUP BY manual_id)
SELECT manual_id, {_page("'User Manual'", "body")} AS html FROM d""",
    "module_pages": rf"""WITH m AS (SELECT DISTINCT module_id, name, relpath, module_docstring, header FROM modules), s AS (SELECT DISTINCT symbol_id, module_id, parent_id, kind, name, qualname, signature, docstring, summary, coalesce(ord, 0) AS ord FROM symbols WHERE module_id IS NOT NULL),
l AS (SELECT module_id, symbol_id, ord, CASE kind WHEN 'variable' THEN 2 WHEN 'statement' THEN 3 WHEN 'function' THEN 1 ELSE 0 END AS r, coalesce(parent_id, symbol_id) AS g, parent_id IS NOT NULL AS inside, CASE WHEN kind = 'class' THEN 'h2' ELSE 'h3' END AS h,
  CASE WHEN kind = 'class' THEN 'Class: ' || name WHEN kind = 'method' THEN 'Method: ' || coalesce(signature, name) ELSE coalesce(signature, name) END AS title, coalesce(qualname, name, '') AS id, coalesce(summary, docstring) AS t FROM s),
p AS (SELECT module_id, string_agg('<' || h || ' id="' || {_escaped('id')} || '">' || {_escaped('title')} || '</' || h || '>' || {_paragraphs('t')}, chr(10) ORDER BY r, g, inside, ord, symbol_id) AS body FROM l GROUP BY module_id),
q AS (SELECT m.module_id, relpath, {_escaped('name')} AS name, {_paragraphs('coalesce(module_docstring, header)')} || coalesce(chr(10) || body, '') AS body FROM m LEFT JOIN p USING (module_id))
SELECT module_id, regexp_replace(coalesce(relpath, module_id), '\.[^./]+$', '') || '.html' AS path, {_page("name", "body")} AS html FROM q""",
    "matlab_functions": r"""WITH m AS (SELECT DISTINCT module_id, regexp_split_to_array(source, '\x0d\x0a|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM modules WHERE lower(language) = 'matlab' AND source <> ''),
x AS (SELECT module_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS lineno FROM m), y AS (SELECT *, trim(line, ' ' || chr(9)) AS s FROM x),
f AS (SELECT module_id, min(lineno) AS start FROM y WHERE s <> '' AND NOT starts_with(s, '%') GROUP BY module_id)
SELECT module_id, regexp_extract(line, '(?i)^\s*function\s+(?:(?:\[[^\]]*\]|\w+)\s*=\s*)?(\w+)', 1) AS name, s AS signature, 'function' AS kind, lineno FROM y JOIN f USING (module_id) WHERE lineno >= start AND regexp_matches(line, '(?i)^\s*function\s+(?:(?:\[[^\]]*\]|\w+)\s*=\s*)?\w+')""",
    "cpp_namespaces": r"""WITH m AS (SELECT DISTINCT module_id, regexp_split_to_array(source, '\x0d\x0a|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM modules WHERE lower(language) = 'cpp' AND source IS NOT NULL),
x AS (SELECT module_id, trim(unnest(l), ' ' || chr(9)) AS s, unnest(range(1, len(l) + 1)) AS n FROM m), y AS (SELECT module_id, n, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')[2] AS w FROM x WHERE starts_with(s, 'namespace '))
SELECT module_id, regexp_replace(arg_min(w, n), '\{$', '') AS namespace FROM y WHERE w IS NOT NULL GROUP BY module_id""",
}
