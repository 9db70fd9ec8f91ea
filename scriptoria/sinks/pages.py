"""Pages of a documented project and of a manual, as HTML rows, and their sink."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptoria.functions.text import escape_html, paragraphs_html, slug, strip
from scriptoria.operators.lint import MARKER
from scriptoria.operators.outline import listed

TEMPLATE = '<!DOCTYPE html>\n<html lang="{language}">\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n<link rel="stylesheet" href="static/style.css">\n</head>\n<body>\n<div class="sidebar">{navigation}</div>\n<main>\n<h1>{header}</h1>\n{body}\n</main>\n</body>\n</html>\n'


def filled(title: Column, header: Column, navigation: Column, body: Column, template: str = TEMPLATE, marker: str = MARKER, language: str = "en") -> Column:
    """The template with its slots filled, after a marker comment."""
    text = F.lit(f"<!-- {marker} -->\n" + template.replace("{language}", language))
    for slot, value in (("{title}", title), ("{header}", header), ("{navigation}", navigation), ("{body}", body)):
        text = F.replace(text, F.lit(slot), F.coalesce(value, F.lit("")))
    return text


def highlighted(code: Column, language: Column) -> Column:
    """Source code as HTML, by the lexer of its language; plain text without one, and without the library."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        try:
            from pygments import highlight
            from pygments.formatters import HtmlFormatter
            from pygments.lexers import get_lexer_by_name
            from pygments.util import ClassNotFound
        except ImportError:
            return texts.map(lambda t: f"<pre>{escape(t)}</pre>", na_action="ignore")

        def one(text: str, name: str | None) -> str | None:
            if text is None:
                return None
            try:
                lexer = get_lexer_by_name(name or "text")
            except ClassNotFound:
                lexer = get_lexer_by_name("text")
            return highlight(text, lexer, HtmlFormatter())

        return pd.Series([one(t, n) for t, n in zip(texts, names)], dtype=object)

    return run(code, F.lower(language))


def wrapped(label: str, width: int = 26, lines: int = 3) -> list[str]:
    """A label in up to ``lines`` lines of up to ``width`` characters; what is lost shows as an ellipsis."""
    out: list[str] = []
    held = ""
    for word in label.split():
        while len(word) > width:
            if held:
                out.append(held)
                held = ""
            out.append(word[:width])
            word = word[width:]
        joined = f"{held} {word}".strip()
        if len(joined) > width:
            out.append(held)
            held = word
        else:
            held = joined
    out += [held] if held else []
    if len(out) > lines:
        out = [*out[: lines - 1], out[lines - 1][: width - 1].rstrip() + "…"]
    return out or [""]


def module_pages(modules: DataFrame, symbols: DataFrame, navigation: Column | None = None) -> DataFrame:
    """``(module_id, path, html)``: a page per module, keyed by its whole path so that equal stems do not collide.

    Sections follow source order. Null summaries and docstrings are empty paragraphs.
    """
    s = symbols.where("module_id is not null").dropDuplicates(["symbol_id"])
    level = F.when(F.col("kind") == "class", "h2").when((F.col("kind") == "method"), "h3").otherwise("h3")
    title = F.when(F.col("kind") == "class", F.concat(F.lit("Class: "), "name")).when(F.col("kind") == "method", F.concat(F.lit("Method: "), F.coalesce("signature", "name"))).otherwise(F.coalesce("signature", "name"))
    piece = F.concat(F.lit("<"), level, F.lit(' id="'), escape_html(F.coalesce("qualname", "name", F.lit(""))), F.lit('">'), escape_html(F.coalesce(title, F.lit(""))), F.lit("</"), level, F.lit(">"), paragraphs_html(F.coalesce("summary", "docstring")))
    rank = F.when(F.col("kind") == "variable", 2).when(F.col("kind") == "statement", 3).when(F.col("kind") == "function", 1).otherwise(0)
    order = s.select("module_id", rank.alias("r"), F.coalesce("parent_id", "symbol_id").alias("g"), F.col("parent_id").isNotNull().alias("inner"), F.coalesce("ord", F.lit(0)).alias("ord"), "symbol_id", piece.alias("l"))
    body = listed(order, ["module_id"], F.col("l"), ["r", "g", "inner", "ord", "symbol_id"], "body")
    text = paragraphs_html(F.coalesce("module_docstring", "header"))
    joined = modules.dropDuplicates(["module_id"]).join(body, "module_id", "left")
    name = escape_html(F.coalesce("name", F.lit("")))
    html = filled(name, name, navigation if navigation is not None else F.lit(""), F.concat_ws("\n", text, "body"))
    return joined.select("module_id", F.concat(F.regexp_replace(F.coalesce("relpath", "module_id"), r"\.[^./]+$", ""), F.lit(".html")).alias("path"), html.alias("html"))


def index_page(modules: DataFrame, summary: str) -> Column:
    """Body of the index: the project's summary; links come from the navigation."""
    return F.concat(F.lit("<h1>Project Documentation</h1>"), paragraphs_html(F.lit(summary)))


def manual_pages(sections: DataFrame, id_col: str, evidence: DataFrame | None = None) -> DataFrame:
    """``(id, html)``: a manual with contents and its sections; one without text shows its evidence instead.

    ``sections``: id, ord, title, body. ``evidence``: id, title, path, snippet.
    """
    empty = strip(F.lower(F.coalesce("body", F.lit("")))).isin("", "no information provided.")
    rows = sections
    if evidence is not None:
        shown = listed(evidence, [id_col, "title"], F.concat(F.lit("<li><code>"), escape_html(F.coalesce("path", F.lit(""))), F.lit("</code>: "), escape_html(F.coalesce("snippet", F.lit(""))), F.lit("</li>")), ["path", "snippet"], "__ev", "")
        rows = sections.join(shown, [id_col, "title"], "left")
    else:
        rows = rows.withColumn("__ev", F.lit(None).cast("string"))
    text = F.when(empty & F.col("__ev").isNotNull(), F.concat(F.lit("<ul>"), "__ev", F.lit("</ul>"))).otherwise(paragraphs_html(F.col("body")))
    anchor = slug(F.coalesce("title", F.lit("")), "-", "section")
    name = escape_html(F.coalesce("title", F.lit("")))
    rows = rows.select(id_col, "ord", F.concat(F.lit('<li><a href="#'), anchor, F.lit('">'), name, F.lit("</a></li>")).alias("toc"), F.concat(F.lit('<h2 id="'), anchor, F.lit('">'), name, F.lit("</h2>\n"), text).alias("part"))
    both = F.sort_array(F.collect_list(F.struct("ord", "toc", "part")))
    made = rows.groupBy(id_col).agg(both.alias("p"))
    body = F.concat(F.lit("<ul>"), F.array_join(F.transform("p", lambda x: x["toc"]), ""), F.lit("</ul>\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n"))
    return made.select(id_col, filled(F.lit("User Manual"), F.lit("User Manual"), F.lit(""), body).alias("html"))


def evidence_json(spark, evidence: DataFrame) -> DataFrame:
    """``(section, json)``: the evidence of each section as a JSON object."""
    from scriptoria.operators.evidence import section_table

    lists = evidence.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("path").alias("file"), "snippet"))).alias("e"))
    shown = F.transform(F.coalesce("e", F.array().cast("array<struct<rank:int,file:string,snippet:string>>")), lambda x: F.struct(x["file"].alias("file"), x["snippet"].alias("snippet")))
    return section_table(spark).join(lists, "section", "left").select("section", F.to_json(F.struct(F.col("e").isNull().alias("inferred"), shown.alias("evidence"))).alias("json"))


def write_pages(pages: DataFrame, folder: str, path_col: str = "path", html_col: str = "html") -> None:
    """Write each page (text or bytes) to its path below ``folder``, in the tasks; an existing page is replaced.

    ``folder`` must be shared by the executors. Paths that leave it are refused.
    """
    root = os.path.abspath(folder)

    def write(rows: Iterator) -> None:
        for row in rows:
            target = os.path.abspath(os.path.join(root, row[0]))
            if not target.startswith(root + os.sep):
                raise ValueError(f"{row[0]} leaves the folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "wb") as f:
                f.write(row[1].encode() if isinstance(row[1], str) else row[1])
            os.replace(target + ".part", target)

    pages.where(F.col(path_col).isNotNull() & F.col(html_col).isNotNull()).select(path_col, html_col).foreachPartition(write)


#: The look of all pages, for ``static/style.css``.
STYLE = "body { display: flex; margin: 0; font-family: sans-serif; line-height: 1.5 }\n.sidebar { width: 16rem; padding: 1rem; background: #f3f4f6 }\nmain { padding: 1rem 2rem; max-width: 60rem }\npre { overflow-x: auto }\n"


def write_assets(folder: str, source: str | None = None) -> None:
    """Write the style sheet below ``folder``, and copy the files of ``source``, if given, over it; existing files are replaced."""
    static = os.path.join(folder, "static")
    os.makedirs(static, exist_ok=True)
    with open(os.path.join(static, "style.css"), "w", encoding="utf-8") as f:
        f.write(STYLE)
    if source:
        shutil.copytree(source, static, dirs_exist_ok=True)


def clean_folder(folder: str, marker: str = MARKER) -> list[str]:
    """Delete the top-level pages whose first line holds the marker; their names."""
    gone = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if name.endswith(".html") and os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                if marker not in f.readline():
                    continue
            os.remove(path)
            gone.append(name)
    return gone


_SIDEBAR = re.compile(r'<div\b[^>]*class="[^"]*\bsidebar\b[^"]*"[^>]*>', re.I)
_DIV = re.compile(r"<(/?)div\b[^>]*>", re.I)


def with_sidebar(html: str, navigation: str) -> str:
    """A page with what stands between its first sidebar and the tag that closes it replaced; a sidebar that is never closed stays."""
    m = _SIDEBAR.search(html)
    if not m:
        return html
    depth = 1
    for tag in _DIV.finditer(html, m.end()):
        depth += -1 if tag[1] else 1
        if not depth:
            return html[: m.end()] + navigation + html[tag.start() :]
    return html


def replace_sidebar(html: Column, navigation: Column) -> Column:
    """``with_sidebar`` as a column; a null page stays null, a null navigation is empty."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else with_sidebar(h, n or "") for h, n in zip(pages, links)], dtype=object)

    return run(html, navigation)


def insert_link(html: Column, href: str, label: str, first: bool = False) -> Column:
    """An index page with a link added to its navigation list, at most once."""
    item = f'<li><a href="{escape(href)}">{escape(label)}</a></li>'
    place = r"(?s)(<ul[^>]*>)" if first else r"(?s)(</ul>)"
    new = f"$1{item}" if first else f"{item}$1"
    pattern = place if first else r"(?s)(</ul>)(?!.*</ul>)"
    return F.when(F.contains(html, F.lit(f'href="{escape(href)}"')), html).otherwise(F.regexp_replace(html, pattern, new.replace("\\", "\\\\")))
