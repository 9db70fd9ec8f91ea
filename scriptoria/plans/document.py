"""The documentation of a source tree: scan, parse, summarise in waves, render.

Waves: module chunks and members (they need the parse only); the project summary (outline and readme); classes (they
need their members' summaries); rewritten docstrings of methods and variables (they need their class's). Prompts repeated
between waves are answered by the cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.text import escape_html, file_name, stem, word_count
from scriptoria.operators.chunking import count_words
from scriptoria.operators.outline import function_prompt, member_bullets, module_outline
from scriptoria.parsers import modules_of, parse_files, rejects_of, symbols_of
from scriptoria.plans.models import Summariser
from scriptoria.plans.summarise import CONTEXT, LEVELS, budget, summarise
from scriptoria.runtime import cut_lineage
from scriptoria.sinks.pages import filled, index_page, module_pages, write_assets, write_pages
from scriptoria.sources.extract import document_text
from scriptoria.sources.tree import markdown_files, scan, with_language


#: Words of all outlines that are joined into one text; more are summarised first.
WHOLE = 200_000


@dataclass
class Documented:
    """What a run produced."""

    modules: DataFrame
    symbols: DataFrame
    rejects: DataFrame
    project: str
    pages: DataFrame


def parse_tree(spark: SparkSession, base: str, ignore: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modules (with name, paths and source), symbols and rejects of a tree; files are keyed by their relative path."""
    files = with_language(scan(spark, base, ignore)).withColumn("module_id", F.col("relpath"))
    parsed = cut_lineage(parse_files(files, content_col="content", path_col="relpath"))
    about = files.select("module_id", stem(F.col("relpath")).alias("name"), "path", "relpath", F.when(F.col("language") != "simulink", F.col("content").cast("string")).alias("source"))
    modules = modules_of(parsed).join(about, "module_id")
    return modules, symbols_of(parsed), rejects_of(parsed)


def module_parts(modules: DataFrame, symbols: DataFrame, class_words: int) -> DataFrame:
    """``(module_id, parts)``: the pieces a long module is packed from, in order.

    Its docstring, its classes (of a class above ``class_words`` its methods and variables instead), variables, statements and functions.
    """
    large = symbols.where("kind = 'class' and parent_id is null").select(F.col("symbol_id").alias("parent_id"), (word_count(F.col("source")) > class_words).alias("large"))
    rank = F.when(F.col("parent_id").isNotNull() | (F.col("kind") == "class"), 1).when(F.col("kind") == "variable", 2).when(F.col("kind") == "statement", 3).otherwise(4)
    whole = symbols.where("parent_id is null").join(large.select(F.col("parent_id").alias("symbol_id"), "large"), "symbol_id", "left").where("not coalesce(large, false)")
    inner = symbols.where("kind in ('method', 'variable') and parent_id is not null").join(large.where("large"), "parent_id", "left_semi")
    keep = ["module_id", rank.alias("r"), F.coalesce("lineno", "ord", F.lit(0)).alias("at"), "symbol_id", F.coalesce("source", "signature", "name", F.lit("")).alias("t")]
    pieces = whole.select(*keep).unionByName(inner.select(*keep)).unionByName(modules.select("module_id", F.lit(0).alias("r"), F.lit(0).alias("at"), F.lit("").alias("symbol_id"), F.coalesce("module_docstring", F.lit("")).alias("t")))
    return pieces.where("t <> ''").groupBy("module_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "at", "symbol_id", "t"))), lambda x: x["t"]).alias("parts"))


def rewrite_docstrings(symbols: DataFrame, classes: DataFrame, model: Summariser, cache: str | None, context: int) -> DataFrame:
    """``(id, summary)`` of the methods and variables with a docstring, told what their class does."""
    rows = symbols.where("parent_id is not null and coalesce(docstring, '') <> ''").join(classes.select(F.col("id").alias("parent_id"), F.col("summary").alias("about")), "parent_id")
    text = F.concat_ws("\n", F.concat(F.lit("Class: "), F.coalesce("about", F.lit(""))), F.concat(F.lit("Member: "), F.coalesce("signature", "name", F.lit(""))), F.concat(F.lit("Docstring: "), F.col("docstring")))
    return summarise(rows.select(F.col("symbol_id").alias("id"), text.alias("text")), model, "docstring", cache, context)


def joined(rows: DataFrame, order: str, text: str) -> DataFrame:
    """One row with the texts of ``rows`` in order."""
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def condensed(rows: DataFrame, model: Summariser, kind: str, cache: str | None, context: int, most: int = WHOLE) -> DataFrame:
    """``rows`` (ord, text) with at most about ``most`` words in all: beyond that, neighbours are packed and summarised, in waves."""
    room = budget(kind, context)[1]

    def pack_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held, used = None, [], 0
        for pdf in batches:
            out = []
            for at, text in zip(pdf["ord"], pdf["text"]):
                n = count_words(text)
                if held and used + n > room:
                    out.append((first, "\n".join(held)))
                    held, used = [], 0
                first = first if held else at
                held.append(text)
                used += n
            yield pd.DataFrame(out, columns=["ord", "text"])
        if held:
            yield pd.DataFrame([(first, "\n".join(held))], columns=["ord", "text"])

    for _ in range(LEVELS):
        size = rows.agg(F.sum(word_count(F.col("text"))).alias("n"), F.count("*").alias("rows")).first()
        if (size["n"] or 0) <= most or size["rows"] < 2:
            break
        parts = max(1, size["n"] // (8 * room))
        packed = cut_lineage(rows.repartitionByRange(parts, "ord").sortWithinPartitions("ord").mapInPandas(pack_rows, "ord string, text string"))
        rows = cut_lineage(summarise(packed.select(F.col("ord").alias("id"), "text"), model, kind, cache, context).select(F.col("id").alias("ord"), F.col("summary").alias("text")))
    return rows


def document(spark: SparkSession, base: str, model: Summariser, out: str | None = None, ignore: list[str] | tuple[str, ...] = (), cache: str | None = None, context: int = CONTEXT) -> Documented:
    """Document the tree at ``base``; pages are written below ``out`` if given. Files that do not parse are rejects."""
    modules, symbols, rejects = parse_tree(spark, base, [*ignore, *([out] if out else [])])
    modules, symbols = cut_lineage(modules), cut_lineage(symbols)
    told = modules.select("module_id", F.coalesce("source", "module_docstring").alias("text")).join(module_parts(modules, symbols, budget("module", context)[1]), "module_id", "left")
    by_module = summarise(told.withColumnRenamed("module_id", "id"), model, "module", cache, context)
    members = symbols.where(F.col("kind") != "class")
    texts = function_prompt(members).select(F.col("symbol_id").alias("id"), F.col("prompt").alias("text"))
    by_member = summarise(texts, model, "function", cache, context)
    with_summary = symbols.join(by_member.withColumnRenamed("id", "symbol_id"), "symbol_id", "left")
    bullets = member_bullets(with_summary).select(F.col("parent_id").alias("symbol_id"), F.col("text").alias("bullets"))
    classes = symbols.where("kind = 'class'").join(bullets, "symbol_id", "left")
    by_class = summarise(classes.select(F.col("symbol_id").alias("id"), F.concat_ws("\n", F.concat(F.lit("Class: "), F.col("name")), "docstring", "bullets").alias("text")), model, "class", cache, context)
    outlines = module_outline(modules, symbols)
    readme = markdown_files(scan(spark, base, ignore, suffixes=[".md"])).select(F.lit("readme").alias("id"), "ord", document_text(F.col("content"), F.lit(".md")).alias("t"))
    about = joined(readme, "ord", "t").select(F.lit("readme").alias("id"), "text").where("text <> ''")
    parts = summarise(about, model, "readme", cache, context).unionByName(summarise(joined(condensed(outlines.select(F.col("module_id").alias("ord"), F.col("outline").alias("text")), model, "project", cache, context), "ord", "text").select(F.lit("outline").alias("id"), "text"), model, "project", cache, context))
    project = "\n".join(r["summary"] for r in sorted(parts.collect(), key=lambda r: r["id"] != "readme") if r["summary"])
    rewritten = rewrite_docstrings(symbols, by_class, model, cache, context)
    summaries = by_member.unionByName(by_class).select(F.col("id").alias("symbol_id"), "summary")
    final = cut_lineage(symbols.join(summaries, "symbol_id", "left").join(rewritten.select(F.col("id").alias("symbol_id"), F.col("summary").alias("__doc")), "symbol_id", "left").withColumn("docstring", F.coalesce("__doc", "docstring")).drop("__doc"))
    told = cut_lineage(modules.join(by_module.withColumnRenamed("id", "module_id"), "module_id", "left"))
    pages = module_pages(told.withColumn("module_docstring", F.coalesce("summary", "module_docstring", "header")), final)
    links = pages.agg(F.array_join(F.transform(F.sort_array(F.collect_list("path")), lambda p: F.concat(F.lit('<li><a href="'), escape_html(p), F.lit('">'), escape_html(file_name(p)), F.lit("</a></li>"))), "").alias("l"))
    index = links.select(F.lit(None).cast("string").alias("module_id"), F.lit("index.html").alias("path"), filled(F.lit("Project Documentation"), F.lit("Project Documentation"), F.concat(F.lit("<ul>"), "l", F.lit("</ul>")), index_page(told, project)).alias("html"))
    pages = pages.unionByName(index)
    if out:
        write_pages(pages, out)
        write_assets(out)
    return Documented(told, final, rejects, project, pages)
