"""Queries over documents, evidence and manual sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions.sanitize import sanitize
from scriptoria.functions.vocabulary import BAD_META, BAD_PARTS, BAD_STARTS, SECTIONS, prompt_lines
from scriptoria.operators import chunking as C
from scriptoria.operators import evidence as E
from scriptoria.operators import lint as L
from scriptoria.operators.cache import misses, resume
from scriptoria.operators.outline import first_of_each, listed
from scriptoria.runtime import first_delivery, table
from scriptoria.sinks.pages import evidence_json, insert_link, replace_sidebar
from scriptoria.sources.tree import DOCUMENT_GROUPS, FILE_GROUPS, collected, markdown_files, with_language

BLANK = T.BLANK
LINES = r"(\x0d\x0a|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def quoted(text: str) -> str:
    """A text as an SQL string."""
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{BLANK}+', ''), '{BLANK}+$', '')"


_SQL_LINES = "(CASE WHEN l[len(l)] = '' THEN l[1:len(l)-1] ELSE l END)"


def _split(x: str) -> str:
    return f"regexp_split_to_array({x}, '{LINES.replace('(', '(?:', 1)}')"


def document_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("tokens"))


def document_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_key("doc", F.col("text")).alias("key"))


def repeated_texts(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return first_of_each(d, F.sha2("text", 256), ["doc_id"], ["doc_id", "source"]).select("key", "doc_id", "source", F.col("n").alias("copies"))


def cache_misses(spark, sf):
    d = table(spark, sf, "documents").select("source", T.content_key("doc", F.col("text")).alias("key"))
    return misses(d.where("source is distinct from 'readme'"), d.where("source = 'readme'").select("key")).select("key")


def slugs(spark, sf):
    return first_delivery(table(spark, sf, "manual_sections"), "section_id").select("section_id", T.slug(F.col("title")).alias("slug"), T.slug(F.col("title"), "-", "section").alias("anchor"))


def section_paragraphs_html(spark, sf):
    return first_delivery(table(spark, sf, "manual_sections"), "section_id").select("section_id", T.paragraphs_html(F.col("body")).alias("html"))


def section_placeholders(spark, sf):
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id")
    return s.select("section_id", F.array_join(T.placeholders(F.col("body")), " ").alias("tokens"), F.array_join(E.missing_sections(F.col("body")), ", ").alias("missing")).where("tokens <> ''")


def document_path_tokens(spark, sf):
    return E.document_patterns(table(spark, sf, "documents"), "text")


def path_parts(spark, sf):
    p = F.col("path")
    return table(spark, sf, "documents").where(p.isNotNull()).select("doc_id", T.file_name(p).alias("name"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"))


def long_slices(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(C.fixed_slices(F.col("text"), 40)).alias("pos", "piece"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "piece")


def document_blocks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(C.blocks(F.col("text"))).alias("pos", "block"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "block")


def document_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(C.chunks(F.col("text"), 120)).alias("pos", "chunk"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


def limited_document_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(C.limited_chunks(F.col("text"), 150, 900)).alias("pos", "chunk"))


def sanitized_summaries(spark, sf):
    s = first_delivery(table(spark, sf, "symbols").select("symbol_id", "summary", "ingested_at"), "symbol_id")
    return s.select("symbol_id", sanitize(F.col("summary")).alias("summary"))


def section_evidence(spark, sf):
    found = E.map_evidence(table(spark, sf, "documents"), "doc_id", "path", "text")
    return found.select("section", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("line_no").cast("long").alias("line_no"), "snippet")


def section_hits(spark, sf):
    found = E.map_evidence(table(spark, sf, "documents"), "doc_id", "path", "text", top=None)
    return found.groupBy("section").agg(F.count("*").alias("snippets"), F.count_distinct("doc_id").alias("documents"))


def section_coverage(spark, sf):
    found = E.map_evidence(table(spark, sf, "documents"), "doc_id", "path", "text", top=None)
    return E.section_coverage(spark, found).select(F.col("ord").cast("long").alias("ord"), "section", "snippets", "inferred", "body")


def sections_by_path(spark, sf):
    found = E.map_evidence(table(spark, sf, "documents").where("path is not null"), "doc_id", "path", "text", top=None)
    return E.files_by_section(found).select("path", F.array_join("sections", ", ").alias("sections"))


def snippet_sections(spark, sf):
    ev = first_delivery(table(spark, sf, "evidence"), "evidence_id")
    return E.sections_of_snippets(ev, "evidence_id", "snippet").select("section", "evidence_id")


def ranked_code_files(spark, sf):
    ranked = E.rank_files(table(spark, sf, "modules"), "relpath", E.document_patterns(table(spark, sf, "documents"), "text"), top=50)
    return ranked.select("relpath", F.col("score").cast("long").alias("score"))


def missing_references(spark, sf):
    return E.missing_references(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "modules"), "relpath")


def annotated_sections(spark, sf):
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id").select("section_id", "body")
    lost = E.missing_references(s, "section_id", "body", table(spark, sf, "modules"), "relpath")
    return E.annotate_missing(s, "section_id", "body", lost).where("missing_references is not null").select("section_id", "body", F.size("missing_references").alias("missing"))


def parsed_manuals(spark, sf):
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id")
    section = F.concat(F.regexp_replace(F.trim(F.coalesce("title", F.lit("x"))), ":$", ""), F.lit(": "), F.coalesce("body", F.lit("")))
    text = listed(s.select("manual_id", "ord", "section_id", section.alias("t")), ["manual_id"], F.col("t"), ["ord", "section_id"])
    return E.parse_manual(text, "manual_id", "text").select("manual_id", "title", "body")


def inferred_sections(spark, sf):
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id")
    named = s.select("manual_id", F.initcap(F.regexp_replace(F.lower(F.trim("title")), r"\s*:$", "")).alias("title"), "body")
    wanted = ["Overview", "How To Run", "Inputs", "Outputs", "Examples"]
    found = E.infer_missing(named.where(F.col("title").isin(*wanted)).groupBy("manual_id", "title").agg(F.max("body").alias("body")), "manual_id", wanted)
    return found.groupBy("title", "inferred").agg(F.count("*").alias("sections"))


def fallback_manuals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(E.fallback_sections(F.col("text"))).alias("s")).select("doc_id", "s.title", "s.body")
    return d.groupBy("title").agg(F.count_if(F.col("body") == "No information provided.").alias("empty"), F.count("*").alias("sections"))


PHRASES, TERMS = ["you should", "there is one", "the option"], ["kettle", "beacon", "ledger"]


#: Pages of six forms, told by the remainder of their id: with and without the marks of generated pages, with true, false and late claims.
PAGES = [
    "<h2>Class: {title}</h2>\n<p>{body}</p>\n<p>No <b>classes</b> here</p>",
    "<h3>Method: {title}</h3>\n<p>No <b>methods</b> here</p>\n<p>{body}</p>",
    "<!-- Generated by scriptoria -->\n<h3>{title}</h3>\n<h3>more</h3>\n<p>No functions</p>\n<p>{body}</p>",
    "<h2>{title}</h2>\n<p>{body}</p>\n<p>No classes, no methods and no functions here</p>",
    "<h1>Project Documentation</h1>\n<h2>Class: {title}</h2>\n<p>{body}</p>\n<p>x</p>\n<p>No classes here</p>",
    "<p>{body}</p>",
]


def _pages(spark, sf):
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id")
    form = F.element_at(F.array(*[F.lit(p) for p in PAGES]), (F.pmod("section_id", F.lit(len(PAGES))) + 1).cast("int"))
    html = F.replace(F.replace(form, F.lit("{title}"), F.coalesce("title", F.lit(""))), F.lit("{body}"), F.coalesce("body", F.lit("")))
    return s.select("section_id", html.alias("html"))


def page_phrases(spark, sf):
    found = L.assistant_phrasing(_pages(spark, sf), "section_id", "html", PHRASES)
    return found.select("section_id", F.col("pos").cast("long").alias("pos"), "phrase", "detail", F.col("line").cast("long").alias("line"))


def page_terms(spark, sf):
    return L.foreign_terms(_pages(spark, sf), "section_id", "html", TERMS).select("section_id", F.col("pos").cast("long").alias("pos"), "term")


def page_contradictions(spark, sf):
    return L.contradictions(_pages(spark, sf), "section_id", "html").select("section_id", "what", F.col("found").cast("long").alias("found"))


def page_review(spark, sf):
    return L.review(_pages(spark, sf), "section_id", "html", phrases=PHRASES, terms=TERMS).groupBy("kind").agg(F.count("*").alias("findings"), F.count_distinct("section_id").alias("pages"))


def rewritten_pages(spark, sf):
    return _pages(spark, sf).select("section_id", L.rewritten(F.col("html")).alias("html"))


_PAGES = """SELECT section_id, replace(replace(CASE section_id % 6 WHEN 0 THEN '<h2>Class: {title}</h2>~<p>{body}</p>~<p>No <b>classes</b> here</p>' WHEN 1 THEN '<h3>Method: {title}</h3>~<p>No <b>methods</b> here</p>~<p>{body}</p>'
  WHEN 2 THEN '<!-- Generated by scriptoria -->~<h3>{title}</h3>~<h3>more</h3>~<p>No functions</p>~<p>{body}</p>' WHEN 3 THEN '<h2>{title}</h2>~<p>{body}</p>~<p>No classes, no methods and no functions here</p>'
  WHEN 4 THEN '<h1>Project Documentation</h1>~<h2>Class: {title}</h2>~<p>{body}</p>~<p>x</p>~<p>No classes here</p>' ELSE '<p>{body}</p>' END, '{title}', coalesce(title, '')), '{body}', coalesce(body, '')) AS html FROM (SELECT DISTINCT section_id, title, body FROM manual_sections)"""
_PAGES = _PAGES.replace("~", "' || chr(10) || '")
_CLAIMS = f"""p AS (SELECT section_id, html, lower(array_to_string(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g'))[1:2], ' ')) AS lead,
  list_transform(regexp_extract_all(html, '(?is)<h3[^>]*>(.*?)</h3>', 1), lambda x: starts_with({_strip('x')}, 'Method:')) AS h3, list_transform(regexp_extract_all(html, '(?is)<h2[^>]*>(.*?)</h2>', 1), lambda x: starts_with({_strip('x')}, 'Class:')) AS h2 FROM h),
k AS (SELECT section_id, 'methods' AS what, contains(lead, 'no methods') AS said, len(list_filter(h3, lambda x: x)) AS found FROM p UNION ALL SELECT section_id, 'functions', contains(lead, 'no functions'), len(list_filter(h3, lambda x: NOT x)) FROM p
  UNION ALL SELECT section_id, 'classes', contains(lead, 'no classes'), len(list_filter(h2, lambda x: x)) FROM p),
c AS (SELECT section_id, what, CAST(found AS BIGINT) AS found FROM k WHERE said AND found > 0)"""
def generated_pages(spark, sf):
    return _pages(spark, sf).select("section_id", L.is_generated(F.col("html")).alias("generated"))


def replaced_sidebars(spark, sf):
    """Pages whose sidebar holds blocks of its own get another one."""
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id")
    html = F.concat(F.lit('<div class="sidebar" id="s"><div><div>old</div></div><p>old</p></div><main>'), F.coalesce("body", F.lit("")), F.lit("</main>"))
    return s.select("section_id", replace_sidebar(html, F.replace("title", F.lit("$"), F.lit(""))).alias("html"))


def cli_builders(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "source", "ingested_at"), "module_id")
    return m.select("module_id", F.array_join(T.cli_lines(F.col("source")), "\n").alias("code"), F.size(T.cli_lines(F.col("source"))).alias("n")).where("n > 0").drop("n")


def main_blocks(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "source", "ingested_at"), "module_id")
    return m.select("module_id", T.main_block(F.col("source")).alias("block")).where("block <> ''")


def project_progress(spark, sf):
    m = first_delivery(table(spark, sf, "modules").select("module_id", "project", "source", "ingested_at"), "module_id")
    return m.groupBy("project").agg(T.percent(F.count("source"), F.count("*")).alias("percent"))


def open_files(spark, sf):
    """Files that have not been read yet, as a resumed run finds them."""
    m = table(spark, sf, "modules").where("relpath is not null")
    return resume(m.select("relpath").distinct(), m.where("source is not null").select("relpath"), "relpath")[0]


def folder_documents(spark, sf):
    parents = F.array(*[F.lit(p) for p in ("docs", "src", "README.md")])
    d = table(spark, sf, "documents").select("path", F.explode(parents).alias("parent"))
    return d.where(T.is_under(F.col("path"), F.col("parent"))).groupBy("parent").agg(F.count("*").alias("documents"))


def file_languages(spark, sf):
    m = table(spark, sf, "modules").where("relpath is not null").select("relpath", T.suffix(F.col("relpath")).alias("suffix")).distinct()
    return with_language(m).select("relpath", "language")


def _paths(spark, sf):
    return table(spark, sf, "documents").where("path is not null").select(F.col("path").alias("relpath")).distinct()


def collected_documents(spark, sf):
    return collected(_paths(spark, sf), DOCUMENT_GROUPS).select("relpath", F.col("group").cast("long").alias("place"))


def collected_files(spark, sf):
    return collected(_paths(spark, sf), FILE_GROUPS).select("relpath", F.col("group").cast("long").alias("place"))


def markdown_paths(spark, sf):
    return markdown_files(_paths(spark, sf)).select("relpath", F.col("ord.later").alias("later"))


def unicode_slugs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.try_element_at(T.split_lines(F.col("text")), F.lit(1)).alias("line")).where("line is not null")
    return d.select("doc_id", T.unicode_slug(F.col("line")).alias("slug"))


def linked_indexes(spark, sf):
    s = first_delivery(table(spark, sf, "manual_sections"), "section_id")
    html = F.concat(F.lit('<ul><li>'), T.escape_html(F.coalesce("title", F.lit(""))), F.lit('</li></ul>\n<p>end</p>'))
    return s.select("section_id", insert_link(html, "user_manual.html", "User Manual").alias("last"), insert_link(html, "user_manual.html", "User Manual", first=True).alias("first"))


def evidence_documents(spark, sf):
    """The best evidence of each section as one JSON text."""
    return evidence_json(spark, E.map_evidence(table(spark, sf, "documents"), "doc_id", "path", "text"))


def _section_case(line: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({line}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{'|'.join(w)})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN {quoted(n)}" for n, _, w in SECTIONS)
    return f"CASE {whens} END"


_HITS = f"""
WITH d AS (SELECT doc_id, path, {_split('text')} AS l, string_split(lower(coalesce(path, '')), '/') AS parts FROM documents WHERE text IS NOT NULL AND text <> ''),
ln AS (SELECT doc_id, path, parts, {_SQL_LINES} AS l FROM d),
x AS (SELECT doc_id, path, parts, l, unnest(range(1, len(l) + 1)) AS n FROM ln),
h AS (SELECT *, {_section_case(f"lower({_strip('l[n]')})")} AS section, list_has_any(parts, ['tests', 'examples', 'fixtures']) AS inside FROM x),
found AS (SELECT * FROM h WHERE section IS NOT NULL AND NOT (inside AND section = 'Overview'))
"""
_DROP = f"""NOT (
  len(list_filter([{', '.join(quoted(p) for p in [*prompt_lines(), *BAD_PARTS, *BAD_META])}], lambda p: contains(lower(s), p))) > 0
  OR (length(s) > 8 AND len(list_filter([{', '.join(map(quoted, prompt_lines()))}], lambda p: contains(p, lower(s)))) > 0)
  OR starts_with(s, '-') OR starts_with(s, '*')
  OR len(list_filter([{', '.join(map(quoted, BAD_STARTS))}], lambda p: starts_with(lower(s), p))) > 0
  OR regexp_matches(lower(s), '^this (script|code|file) (does|is)\\b'))"""

QUERIES = {
    "document_tokens": document_tokens,
    "document_keys": document_keys,
    "repeated_texts": repeated_texts,
    "cache_misses": cache_misses,
    "slugs": slugs,
    "section_paragraphs_html": section_paragraphs_html,
    "section_placeholders": section_placeholders,
    "document_path_tokens": document_path_tokens,
    "path_parts": path_parts,
    "long_slices": long_slices,
    "document_blocks": document_blocks,
    "document_chunks": document_chunks,
    "limited_document_chunks": limited_document_chunks,
    "sanitized_summaries": sanitized_summaries,
    "section_evidence": section_evidence,
    "section_hits": section_hits,
    "section_coverage": section_coverage,
    "sections_by_path": sections_by_path,
    "snippet_sections": snippet_sections,
    "ranked_code_files": ranked_code_files,
    "missing_references": missing_references,
    "annotated_sections": annotated_sections,
    "parsed_manuals": parsed_manuals,
    "inferred_sections": inferred_sections,
    "fallback_manuals": fallback_manuals,
    "page_phrases": page_phrases,
    "page_terms": page_terms,
    "page_contradictions": page_contradictions,
    "page_review": page_review,
    "rewritten_pages": rewritten_pages,
    "generated_pages": generated_pages,
    "replaced_sidebars": replaced_sidebars,
    "cli_builders": cli_builders,
    "main_blocks": main_blocks,
    "project_progress": project_progress,
    "open_files": open_files,
    "folder_documents": folder_documents,
    "file_languages": file_languages,
    "collected_documents": collected_documents,
    "collected_files": collected_files,
    "markdown_paths": markdown_paths,
    "unicode_slugs": unicode_slugs,
    "linked_indexes": linked_indexes,
    "evidence_documents": evidence_documents,
}

SQL = {
    "document_tokens": f"SELECT doc_id, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '')), 0) AS BIGINT) AS tokens FROM documents",
    "document_keys": "SELECT doc_id, 'doc:' || coalesce(sha256(text), 'null') AS key FROM documents",
    "repeated_texts": "SELECT sha256(text) AS key, min(doc_id) AS doc_id, arg_min(coalesce(source, '<null>'), doc_id) AS source, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1".replace("arg_min(coalesce(source, '<null>'), doc_id)", "nullif(arg_min(coalesce(source, '<null>'), doc_id), '<null>')"),
    "cache_misses": "WITH k AS (SELECT source, 'doc:' || coalesce(sha256(text), 'null') AS key FROM documents) SELECT DISTINCT key FROM k WHERE source IS DISTINCT FROM 'readme' AND key NOT IN (SELECT key FROM k WHERE source = 'readme')",
    "slugs": "WITH s AS (SELECT DISTINCT section_id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g') AS t FROM manual_sections) SELECT section_id, CASE WHEN trim(t) = '' THEN 'user_manual' ELSE replace(trim(t), ' ', '_') END AS slug, CASE WHEN trim(t) = '' THEN 'section' ELSE replace(trim(t), ' ', '-') END AS anchor FROM s",
    "section_paragraphs_html": f"WITH s AS (SELECT DISTINCT section_id, replace(replace(replace(replace(replace(coalesce(body, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS b FROM manual_sections) SELECT section_id, coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(b, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> ''), lambda p: '<p>' || replace(p, chr(10), '<br/>') || '</p>'), chr(10)), '') AS html FROM s",
    "section_placeholders": f"""WITH s AS (SELECT DISTINCT section_id, coalesce(body, '') AS body FROM manual_sections),
t AS (SELECT section_id, regexp_extract_all(body, '\\[\\[[^\\[\\]]+\\]\\]') AS t FROM s),
u AS (SELECT section_id, t, list_filter(t, lambda x, i: list_position(t, x) = i) AS d FROM t)
SELECT section_id, array_to_string(d, ' ') AS tokens, array_to_string(list_filter([{', '.join(f"CASE WHEN list_contains(d, {quoted(t)}) THEN {quoted(n)} END" for n, t, _ in SECTIONS)}], lambda x: x IS NOT NULL), ', ') AS missing FROM u WHERE len(d) > 0""",
    "document_path_tokens": r"SELECT DISTINCT t AS pattern FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_/.-]+')) AS t FROM documents) WHERE contains(t, '/') OR ends_with(t, '.py')",
    "path_parts": r"WITH p AS (SELECT doc_id, string_split(path, '/')[-1] AS name FROM documents WHERE path IS NOT NULL) SELECT doc_id, name, CASE WHEN regexp_matches(name, '.\.[^.]+$') THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END AS stem, regexp_extract(name, '.(\.[^.]+)$', 1) AS suffix FROM p",
    "long_slices": f"""WITH d AS (SELECT doc_id, text, length(text) AS n, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '')), 0) AS BIGINT) AS w FROM documents WHERE text <> ''),
s AS (SELECT *, CASE WHEN w <= 40 THEN n ELSE greatest(40 * greatest(n // w, 1), 1) END AS step FROM d),
x AS (SELECT *, unnest(range(0, (n + step - 1) // step)) AS pos FROM s)
SELECT doc_id, pos, substring(text, pos * step + 1, step) AS piece FROM x""",
    "document_blocks": f"""WITH d AS (SELECT doc_id, {_split('text')} AS l FROM documents WHERE text <> ''),
a AS (SELECT doc_id, {_SQL_LINES} AS l FROM d),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM a),
f AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x),
g AS (SELECT *, (NOT fence AND k % 2 = 1) OR fence AS code FROM f),
h AS (SELECT *, NOT code AND {_strip('line')} = '' AS blank, NOT code AND starts_with(regexp_replace(line, '^{BLANK}+', ''), '#') AS head FROM g),
b AS (SELECT *, CASE WHEN head OR (fence AND k % 2 = 1) OR lag(blank OR head OR (fence AND k % 2 = 0), 1, true) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS new FROM h),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS id FROM b),
e AS (SELECT doc_id, id, {_strip("string_agg(line, chr(10) ORDER BY n)")} AS block FROM c WHERE NOT blank GROUP BY doc_id, id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS pos, block FROM e WHERE block <> ''""",
    "sanitized_summaries": f"""WITH s AS (SELECT DISTINCT symbol_id, regexp_replace(coalesce(summary, ''), '<\\|fim_(prefix|middle|suffix)\\|>', '', 'g') AS t, {_strip("coalesce(summary, '')")} = 'project summary' AS shim FROM symbols),
d AS (SELECT symbol_id, shim, {_split(_strip('t'))} AS l FROM s),
x AS (SELECT symbol_id, shim, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM d),
y AS (SELECT symbol_id, shim, n, {_strip('line')} AS s FROM x),
k AS (SELECT symbol_id, string_agg(s, chr(10) ORDER BY n) AS t FROM y WHERE {_DROP} GROUP BY symbol_id)
SELECT s.symbol_id, CASE WHEN s.shim THEN 'It prints.' ELSE coalesce({_strip('k.t')}, '') END AS summary FROM s LEFT JOIN k USING (symbol_id)""",
    "section_evidence": _HITS
    + f""", w AS (SELECT *, CASE WHEN inside THEN [] ELSE l[n+1:n+20] END AS after FROM found),
v AS (SELECT *, list_position(list_transform(after, lambda y: {_strip('y')} = '' OR regexp_matches(y, '^\\s*(#|<h[1-6])')), true) AS stop FROM w),
u AS (SELECT *, list_transform(CASE WHEN stop > 0 THEN after[1:stop-1] ELSE after END, lambda y: {_strip('y')}) AS taken FROM v),
s AS (SELECT section, doc_id, n AS line_no, {_strip('l[n]')} || CASE WHEN len(taken) > 0 THEN chr(10) || array_to_string(taken, ' ') ELSE '' END AS snippet, CASE WHEN section = 'Overview' AND coalesce(parts[-1] = 'readme.md' OR list_contains(parts, 'docs'), false) THEN 0 ELSE 1 END AS prio FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY prio, length(snippet) DESC, doc_id, line_no) AS rank FROM s)
SELECT section, rank, doc_id, line_no, snippet FROM r WHERE rank <= 10""",
    "section_hits": _HITS + "SELECT section, count(*) AS snippets, count(DISTINCT doc_id) AS documents FROM found GROUP BY section",
    "section_coverage": _HITS
    + f", t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(n)}, {quoted(k)})' for i, (n, k, _) in enumerate(SECTIONS))}) AS v(ord, section, token)), c AS (SELECT section, count(*) AS n FROM found GROUP BY section) SELECT CAST(t.ord AS BIGINT) AS ord, t.section, coalesce(c.n, 0) AS snippets, c.n IS NULL AS inferred, CASE WHEN c.n IS NULL THEN t.token END AS body FROM t LEFT JOIN c USING (section)",
    "sections_by_path": _HITS + "SELECT path, string_agg(DISTINCT section, ', ' ORDER BY section) AS sections FROM found WHERE path IS NOT NULL GROUP BY path",
    "snippet_sections": "WITH e AS (SELECT DISTINCT evidence_id, lower(snippet) AS s FROM evidence WHERE snippet IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT {quoted(n)} AS section, evidence_id FROM e WHERE {' OR '.join(f'contains(s, {quoted(k)})' for k in w)}" for n, _, w in SECTIONS),
    "ranked_code_files": r"""WITH p AS (SELECT DISTINCT lower(t) AS ref FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_/.-]+')) AS t FROM documents) WHERE contains(t, '/') OR ends_with(t, '.py')),
f AS (SELECT DISTINCT relpath, lower(relpath) AS low, string_split(lower(relpath), '/') AS parts FROM modules WHERE relpath IS NOT NULL),
k AS (SELECT relpath, low FROM f WHERE regexp_matches(relpath, '\.(py|m|ipynb|cpp|h|java)$') AND NOT list_has_any(parts[1:len(parts)-1], ['venv', '.git', '__pycache__', 'node_modules', 'dist', 'build', 'tests', 'test', 'examples', 'example', 'samples', 'sample', 'fixtures', 'fixture']) AND len(list_filter(parts[1:len(parts)-1], lambda d: ends_with(d, '.egg-info'))) = 0),
s AS (SELECT k.relpath, CASE WHEN regexp_matches(low, 'run|main|cli|config|io|dataset|reader|writer|pipeline') THEN 2 ELSE 0 END + count(p.ref) AS score FROM k LEFT JOIN p ON contains(k.low, p.ref) GROUP BY k.relpath, low)
SELECT relpath, CAST(score AS BIGINT) AS score FROM s ORDER BY score DESC, relpath LIMIT 50""",
    "missing_references": r"""WITH n AS (SELECT DISTINCT relpath AS ref FROM modules WHERE relpath IS NOT NULL UNION SELECT DISTINCT string_split(relpath, '/')[-1] FROM modules WHERE relpath IS NOT NULL),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_./-]+')) AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(t, '^[./-]+', '') AS t FROM t),
r AS (SELECT DISTINCT doc_id, regexp_extract(t, '^(.*\.(?:py|m|md|rst|txt|json|yaml|yml|csv))(?:$|[./-])', 1) AS ref FROM u)
SELECT doc_id, ref FROM r WHERE ref <> '' AND ref NOT IN (SELECT ref FROM n)""",
    "page_phrases": f"""WITH h AS ({_PAGES}), p AS (SELECT section_id, html, regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) AS t FROM h),
x AS (SELECT section_id, html, unnest(t) AS t, unnest(range(0, len(t))) AS pos FROM p),
y AS (SELECT section_id, html, pos, {_strip("regexp_replace(t, '<[^>]+>', '', 'g')")} AS detail FROM x),
z AS (SELECT *, CASE {' '.join(f"WHEN contains(lower(detail), {quoted(w)}) THEN {quoted(w)}" for w in PHRASES)} END AS phrase FROM y),
l AS (SELECT *, list_position(list_transform({_split('html')}, lambda s: contains(lower(s), lower(detail))), true) AS n FROM z WHERE phrase IS NOT NULL)
SELECT section_id, pos, phrase, detail, CAST(CASE WHEN coalesce(n, 0) > 0 THEN n ELSE -1 END AS BIGINT) AS line FROM l""",
    "page_terms": f"""WITH h AS ({_PAGES}), p AS (SELECT section_id, regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) AS t FROM h),
x AS (SELECT section_id, lower(regexp_replace(unnest(t), '<[^>]+>', '', 'g')) AS t, unnest(range(0, len(t))) AS pos FROM p)
SELECT section_id, pos, term FROM x, (VALUES {', '.join(f'({quoted(w)})' for w in TERMS)}) AS v(term) WHERE contains(t, term)""",
    "page_contradictions": f"WITH h AS ({_PAGES}), {_CLAIMS} SELECT section_id, what, found FROM c",
    "inferred_sections": """WITH s AS (SELECT DISTINCT section_id, manual_id, regexp_replace(lower(trim(title)), '\\s*:$', '') AS t, body FROM manual_sections),
n AS (SELECT manual_id, CASE t WHEN 'overview' THEN 'Overview' WHEN 'how to run' THEN 'How To Run' WHEN 'inputs' THEN 'Inputs' WHEN 'outputs' THEN 'Outputs' WHEN 'examples' THEN 'Examples' END AS title, max(body) AS body FROM s GROUP BY 1, 2 HAVING title IS NOT NULL),
h AS (SELECT manual_id, title FROM n WHERE regexp_matches(body, '[^\\s\\x{a0}]')),
w AS (SELECT manual_id, title FROM (SELECT DISTINCT manual_id FROM n), (VALUES ('Overview'), ('How To Run'), ('Inputs'), ('Outputs'), ('Examples')) AS v(title))
SELECT title, false AS inferred, count(*) AS sections FROM h GROUP BY title UNION ALL SELECT title, true, count(*) FROM (SELECT * FROM w EXCEPT SELECT * FROM h) GROUP BY title""",
    "fallback_manuals": f"WITH d AS (SELECT {_strip("coalesce(text, '')")} = '' AS e FROM documents) SELECT title, count(*) FILTER (e) AS empty, count(*) AS sections FROM d, (VALUES {', '.join(f'({quoted(n)})' for n, _, _ in SECTIONS)}) AS v(title) GROUP BY title",
    "page_review": f"""WITH a AS ({_PAGES}), h AS (SELECT * FROM a WHERE contains(html, 'Generated by scriptoria') OR contains(html, '<h1>Project Documentation</h1>') OR regexp_matches(html, '<h2[^>]*>Class:|<h3[^>]*>Method:')), {_CLAIMS},
x AS (SELECT section_id, lower(regexp_replace(unnest(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)), '<[^>]+>', '', 'g')) AS t FROM h),
f AS (SELECT 'ASSISTANT' AS kind, section_id FROM x WHERE {' OR '.join(f'contains(t, {quoted(w)})' for w in PHRASES)}
 UNION ALL SELECT 'HALLUCINATION', section_id FROM x, (VALUES {', '.join(f'({quoted(w)})' for w in TERMS)}) AS v(term) WHERE contains(t, term)
 UNION ALL SELECT 'CONTRADICTION', section_id FROM c)
SELECT kind, count(*) AS findings, count(DISTINCT section_id) AS pages FROM f GROUP BY kind""",
    "generated_pages": f"WITH a AS ({_PAGES}) SELECT section_id, contains(html, 'Generated by scriptoria') OR contains(html, '<h1>Project Documentation</h1>') OR regexp_matches(html, '<h2[^>]*>Class:|<h3[^>]*>Method:') AS generated FROM a",
    "replaced_sidebars": """SELECT DISTINCT section_id, '<div class="sidebar" id="s">' || replace(coalesce(title, ''), '$', '') || '</div><main>' || coalesce(body, '') || '</main>' AS html FROM manual_sections""",
    "cli_builders": f"""WITH m AS (SELECT DISTINCT module_id, {_split("coalesce(source, '')")} AS l FROM modules), x AS (SELECT module_id, list_filter({_SQL_LINES}, lambda s: contains(s, 'ArgumentParser') OR contains(s, 'add_argument')) AS l FROM m) SELECT module_id, array_to_string(l, chr(10)) AS code FROM x WHERE len(l) > 0""",
    "main_blocks": "SELECT DISTINCT module_id, regexp_extract(source, '(?s)if __name__ == [''\"]__main__[''\"]:.*') AS block FROM modules WHERE regexp_matches(source, 'if __name__ == [''\"]__main__[''\"]:')",
    "project_progress": "WITH m AS (SELECT DISTINCT module_id, project, source IS NOT NULL AS done FROM modules) SELECT project, CASE WHEN count(*) = 0 THEN 100 ELSE CAST(floor(count(*) FILTER (done) * 100 / count(*)) AS INTEGER) END AS percent FROM m GROUP BY project",
    "open_files": "SELECT DISTINCT relpath FROM modules WHERE relpath IS NOT NULL AND relpath NOT IN (SELECT relpath FROM modules WHERE source IS NOT NULL AND relpath IS NOT NULL)",
    "folder_documents": "SELECT v.parent, count(*) AS documents FROM documents, (VALUES ('docs'), ('src'), ('README.md')) AS v(parent) WHERE path = v.parent OR starts_with(path, v.parent || '/') GROUP BY v.parent",
    "file_languages": r"SELECT DISTINCT relpath, CASE regexp_extract(relpath, '[^/](\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.m' THEN 'matlab' WHEN '.cpp' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.slx' THEN 'simulink' WHEN '.mdl' THEN 'simulink' END AS language FROM modules WHERE relpath IS NOT NULL",
    "collected_documents": r"SELECT * FROM (SELECT DISTINCT path AS relpath, CASE WHEN path = 'README.md' THEN 0 WHEN NOT contains(path, '/') AND path LIKE '_%.md' THEN 1 WHEN NOT contains(path, '/') AND path LIKE '_%.txt' THEN 2 WHEN NOT contains(path, '/') AND path LIKE '_%.html' THEN 3 WHEN NOT contains(path, '/') AND path LIKE '_%.docx' THEN 4 WHEN starts_with(path, 'docs/') AND regexp_matches(path, '[^/]\.html$') THEN 5 WHEN starts_with(path, 'docs/') AND regexp_matches(path, '[^/]\.md$') THEN 6 END::BIGINT AS place FROM documents WHERE path IS NOT NULL) WHERE place IS NOT NULL",
    "collected_files": r"SELECT * FROM (SELECT DISTINCT path AS relpath, CASE WHEN path = 'README.md' OR ends_with(path, '/README.md') THEN 0 WHEN regexp_matches(path, '[^/]\.txt$') THEN 1 WHEN regexp_matches(path, '[^/]\.html$') THEN 2 WHEN regexp_matches(path, '[^/]\.docx$') THEN 3 WHEN regexp_matches(path, '[^/]\.csv$') THEN 4 WHEN regexp_matches(path, '[^/]\.json$') THEN 5 END::BIGINT AS place FROM documents WHERE path IS NOT NULL) WHERE place IS NOT NULL",
    "markdown_paths": "WITH p AS (SELECT DISTINCT path AS relpath, string_split(lower(path), '/') AS f FROM documents WHERE path IS NOT NULL) SELECT relpath, relpath <> 'README.md' AS later FROM p WHERE relpath = 'README.md' OR (list_contains(f[1:len(f)-1], 'docs') AND ends_with(relpath, '.md'))",
    "unicode_slugs": f"WITH d AS (SELECT doc_id, {_split('text')}[1] AS l FROM documents WHERE text <> ''), s AS (SELECT doc_id, trim(regexp_replace(lower(l), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') AS s FROM d) SELECT doc_id, CASE WHEN s = '' THEN 'simulink-model' ELSE s END AS slug FROM s",
    "linked_indexes": f"""WITH s AS (SELECT DISTINCT section_id, replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM manual_sections)
SELECT section_id, '<ul><li>' || t || '</li><li><a href="user_manual.html">User Manual</a></li></ul>' || chr(10) || '<p>end</p>' AS last, '<ul><li><a href="user_manual.html">User Manual</a></li><li>' || t || '</li></ul>' || chr(10) || '<p>end</p>' AS first FROM s""",
}

#: The best snippets of each section as JSON; null paths are left out of it.
SQL["evidence_documents"] = f"""WITH e AS ({SQL['section_evidence']}), d AS (SELECT DISTINCT doc_id, path FROM documents),
j AS (SELECT section, rank, CASE WHEN path IS NULL THEN '{{"snippet":' || to_json(snippet) || '}}' ELSE '{{"file":' || to_json(path) || ',"snippet":' || to_json(snippet) || '}}' END AS j FROM e JOIN d USING (doc_id)),
g AS (SELECT section, string_agg(j, ',' ORDER BY rank) AS j FROM j GROUP BY section), s AS (SELECT * FROM (VALUES {', '.join(f'({quoted(n)})' for n, _, _ in SECTIONS)}) AS v(section))
SELECT section, '{{"inferred":' || CASE WHEN j IS NULL THEN 'true' ELSE 'false' END || ',"evidence":[' || coalesce(j, '') || ']}}' AS json FROM s LEFT JOIN g USING (section)"""

#: Packing is a fold: a recursive query walks the blocks of all documents side by side.
SQL["document_chunks"] = f"""WITH RECURSIVE blocks AS ({SQL['document_blocks']}),
b AS (SELECT doc_id, pos, block, len(list_filter(regexp_split_to_array(block, '{BLANK}+'), lambda w: w <> '')) AS n FROM blocks),
f AS (SELECT doc_id, pos, CASE WHEN n <= 120 THEN n ELSE 0 END AS used, 1 AS g FROM b WHERE pos = 0
  UNION ALL SELECT b.doc_id, b.pos, CASE WHEN b.n > 120 THEN 0 WHEN f.used > 0 AND f.used + b.n <= 120 THEN f.used + b.n ELSE b.n END,
    CASE WHEN b.n <= 120 AND f.used > 0 AND f.used + b.n <= 120 THEN f.g ELSE f.g + 1 END FROM f JOIN b ON b.doc_id = f.doc_id AND b.pos = f.pos + 1),
c AS (SELECT doc_id, g, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS t, max(n) AS n FROM f JOIN b USING (doc_id, pos) GROUP BY doc_id, g),
s AS (SELECT *, CASE WHEN n <= 120 THEN length(t) ELSE greatest(120 * greatest(length(t) // n, 1), 1) END AS step FROM c),
x AS (SELECT *, unnest(range(0, (length(t) + step - 1) // step)) AS i FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, i) - 1 AS pos, substring(t, i * step + 1, step) AS chunk FROM x"""

SQL["parsed_manuals"] = f"""WITH s AS (SELECT DISTINCT section_id, manual_id, ord, regexp_replace(trim(coalesce(title, 'x')), ':$', '') || ': ' || coalesce(body, '') AS t FROM manual_sections),
m AS (SELECT manual_id, string_agg(t, chr(10) ORDER BY ord, section_id) AS text FROM s GROUP BY manual_id),
d AS (SELECT manual_id, {_split('text')} AS l FROM m),
x AS (SELECT manual_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM d),
y AS (SELECT manual_id, n, {_strip('line')} AS s FROM x),
z AS (SELECT *, regexp_matches(s, '^[A-Za-z &]+:') AS h FROM y WHERE s <> ''),
g AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY manual_id ORDER BY n) AS g FROM z),
p AS (SELECT manual_id, g, max(CASE WHEN h THEN trim(regexp_extract(s, '^([A-Za-z &]+):', 1)) END) AS title,
  coalesce(string_agg(CASE WHEN h THEN trim(regexp_replace(s, '^[A-Za-z &]+:\\s*', '')) ELSE s END, chr(10) ORDER BY n) FILTER (NOT h OR trim(regexp_replace(s, '^[A-Za-z &]+:\\s*', '')) <> ''), '') AS body FROM g WHERE g > 0 GROUP BY manual_id, g)
SELECT manual_id, title, arg_max(body, g) AS body FROM p GROUP BY manual_id, title"""
