"""Lint of generated pages and rewriting of their texts."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptoria.functions.sanitize import sanitize_text
from scriptoria.functions.text import line_of, strip, tag_bodies, without_tags
from scriptoria.functions.vocabulary import ASSISTANT_PHRASES, FOREIGN_TERMS

MARKER = "Generated by scriptoria"


def is_generated(html: Column, marker: str = MARKER) -> Column:
    """Whether a page was generated: by its marker or by its headings. False for null."""
    heads = html.rlike("<h2[^>]*>Class:") | html.rlike("<h3[^>]*>Method:")
    return F.coalesce(F.contains(html, F.lit(marker)) | F.contains(html, F.lit("<h1>Project Documentation</h1>")) | heads, F.lit(False))


def assistant_phrasing(pages: DataFrame, id_col: str, html_col: str, phrases: list[str] = ASSISTANT_PHRASES) -> DataFrame:
    """``(id, pos, phrase, detail, line)``: the first phrase, in the order of ``phrases``, of each paragraph that has one.

    A paragraph of more than a line has line -1. Null pages have no paragraphs.
    """
    p = pages.select(F.col(id_col), F.col(html_col).alias("__h"), F.posexplode(F.transform(tag_bodies(F.col(html_col), "p"), lambda x: strip(without_tags(x)))).alias("pos", "detail"))
    low = F.lower("detail")
    first = F.coalesce(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in phrases])
    return p.withColumn("phrase", first).where("phrase is not null").select(id_col, "pos", "phrase", "detail", line_of(F.col("__h"), F.col("detail")).alias("line"))


def foreign_terms(pages: DataFrame, id_col: str, html_col: str, terms: list[str] = FOREIGN_TERMS) -> DataFrame:
    """``(id, pos, term)``: every pair of a paragraph and a term it holds; duplicates stay."""
    p = pages.select(id_col, F.posexplode(F.transform(tag_bodies(F.col(html_col), "p"), lambda x: F.lower(without_tags(x)))).alias("pos", "__t"))
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("__t"), t))
    return p.select(id_col, "pos", F.explode(hits).alias("term"))


def contradictions(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, what, found)``: pages whose first two paragraphs deny methods, functions or classes that headings show."""
    html = F.col(html_col)
    lead = F.array_join(F.slice(F.transform(tag_bodies(html, "p"), lambda x: F.lower(without_tags(x))), 1, 2), " ")
    count = lambda tag, mark, has: F.size(F.filter(tag_bodies(html, tag), lambda x: F.startswith(strip(x), F.lit(mark)) == F.lit(has)))
    claims = F.array(
        *[
            F.struct(F.lit(w).alias("what"), F.when(F.contains(lead, F.lit(f"no {w}")), count(tag, mark, has)).otherwise(0).alias("found"))
            for w, tag, mark, has in (("methods", "h3", "Method:", True), ("functions", "h3", "Method:", False), ("classes", "h2", "Class:", True))
        ]
    )
    return pages.select(id_col, F.explode(claims).alias("c")).select(id_col, "c.what", "c.found").where("found > 0")


def review(pages: DataFrame, id_col: str, html_col: str, marker: str = MARKER, phrases: list[str] = ASSISTANT_PHRASES, terms: list[str] = FOREIGN_TERMS) -> DataFrame:
    """``(id, kind, detail, line)``: all findings of the generated pages."""
    made = pages.where(is_generated(F.col(html_col), marker))
    none = F.lit(None).cast("int").alias("line")
    parts = [
        assistant_phrasing(made, id_col, html_col, phrases).select(id_col, F.lit("ASSISTANT").alias("kind"), "detail", "line"),
        contradictions(made, id_col, html_col).select(id_col, F.lit("CONTRADICTION").alias("kind"), F.format_string("'no %s' stated but found %d", "what", "found").alias("detail"), none),
        foreign_terms(made, id_col, html_col, terms).select(id_col, F.lit("HALLUCINATION").alias("kind"), F.col("term").alias("detail"), none),
    ]
    return reduce(DataFrame.unionByName, parts)


_PLAIN = {"paragraphs": re.compile(r"<p>(.*?)</p>", re.S), "all": re.compile(r"<(p|li|h[1-6])>(.*?)</\1>", re.S | re.I)}


def rewrite_page(html: str, what: str = "all") -> str:
    """A page whose plain ``p`` (and ``li`` and headings) hold their sanitised texts without inner tags."""

    def one(m: re.Match) -> str:
        tag = "p" if what == "paragraphs" else m[1]
        return f"<{tag}>{sanitize_text(re.sub('<[^>]+>', '', m[m.lastindex]))}</{tag}>"

    return _PLAIN[what].sub(one, html)


def rewritten(html: Column, what: str = "all") -> Column:
    """``rewrite_page`` as a column; null stays null."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: rewrite_page(h, what), na_action="ignore")

    return run(html)
