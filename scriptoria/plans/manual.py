"""A user manual from documents and code: evidence per section, a model call each, filling of what is missing."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptoria.functions.vocabulary import IO_WORDS, SECTIONS
from scriptoria.operators.evidence import document_patterns, map_evidence, rank_files, section_table, sections_of_snippets
from scriptoria.plans.models import Summariser
from scriptoria.plans.summarise import CONTEXT, summarise
from scriptoria.runtime import cut_lineage
from scriptoria.sources.extract import document_text
from scriptoria.sources.tree import collected, scan


def code_snippet(source: str | None, suffix: str | None) -> str:
    """What a code file tells about its use: docstrings, the first assignments and statements, signatures with files, the CLI.

    Files of other languages, and Python files that do not parse, are taken whole.
    """
    if source is None or suffix != ".py":
        return source or ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return source
    lines = source.splitlines()
    cut = lambda node, n: "\n".join(lines[node.lineno - 1 : node.end_lineno][:n])
    parts = [ast.get_docstring(tree) or ""]
    assigned = [n for n in tree.body if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign))]
    parts += [cut(n, 5) for n in assigned[:10]] + [cut(n, 10) for n in [n for n in tree.body if n not in assigned][:10]]
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            parts.append(ast.get_docstring(node) or "")
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(w in a.arg.lower() for a in node.args.args for w in IO_WORDS):
            parts.append(f"{node.name}({ast.unparse(node.args)})")
    parts += [x for x in lines if "ArgumentParser" in x or "add_argument" in x]
    at = next((i for i, x in enumerate(lines) if x.startswith("if __name__")), None)
    return "\n".join([p for p in parts if p] + ([] if at is None else lines[at:]))


def code_snippets(files: DataFrame, max_files: int = 12, max_bytes: int = 200_000, patterns: DataFrame | None = None) -> DataFrame:
    """``(relpath, text)`` of the best ranked files; ``max_files`` counts ranked files, larger ones than ``max_bytes`` are left out."""
    best = rank_files(files, "relpath", patterns, top=max_files)
    take = F.pandas_udf(lambda c, s: pd.Series([code_snippet(x, y) for x, y in zip(c, s)], dtype=object), StringType())
    return files.join(best, "relpath", "left_semi").where(F.col("size") <= max_bytes).select("relpath", take(F.try_validate_utf8(F.col("content").cast("string")), "suffix").alias("text"))


def scan_code(spark: SparkSession, base: str, sections: list[str] | None = None, max_files: int = 12, max_bytes: int = 200_000) -> DataFrame:
    """``(section, path, text)``: snippets of code by the sections they may serve; no sections give no rows."""
    files = scan(spark, base, suffixes=[".py", ".m", ".ipynb", ".cpp", ".h", ".java"])
    docs = collected(scan(spark, base, suffixes=[".md", ".txt", ".html", ".docx"]))
    patterns = document_patterns(docs.select(document_text(F.col("content"), F.col("suffix")).alias("text")), "text")
    found = code_snippets(files, max_files, max_bytes, patterns).withColumnRenamed("relpath", "path")
    return sections_of_snippets(found, "path", "text", wanted=sections)


def write_manual(spark: SparkSession, base: str, model: Summariser, use_code: bool = True, cache: str | None = None, context: int = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """``(ord, title, body)`` of the manual and its evidence.

    Sections with evidence are summarised together in one wave. The others are filled from code, if allowed, one after the other, since each
    sees the manual so far; that is a loop over at most seven sections. What stays open is marked as inferred.
    """
    docs = collected(scan(spark, base, suffixes=[".md", ".txt", ".html", ".docx"])).select(F.struct("group", "relpath").alias("id"), F.col("relpath").alias("path"), document_text(F.col("content"), F.col("suffix")).alias("text"))
    evidence = cut_lineage(map_evidence(docs, "id", "path", "text"))
    texts = evidence.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]), "\n\n").alias("text"))
    told = summarise(texts.select(F.col("section").alias("id"), "text"), model, "user_manual", cache, context)
    table = section_table(spark).join(told.withColumnRenamed("id", "section"), "section", "left")
    bodies = {r["section"]: (r["ord"], (r["summary"] or "").strip(), r["token"]) for r in table.select("section", "ord", "summary", "token").collect()}
    lacking = [s for s, _, _ in SECTIONS if not bodies[s][1] or bodies[s][1] == bodies[s][2]]
    if lacking and use_code:
        code = cut_lineage(scan_code(spark, base, lacking))
        for section in lacking:
            so_far = "\n".join(f"{s}: {b[1]}" for s, b in bodies.items() if b[1])
            rows = code.where(F.col("section") == section).groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
            filled = summarise(rows.select(F.col("section").alias("id"), F.concat(F.lit(so_far + "\n\n"), "text").alias("text")), model, "user_manual", cache, context).collect()
            if filled and filled[0]["summary"]:
                bodies[section] = (bodies[section][0], filled[0]["summary"], None)
    rows = [(o, s, b or f"{s} details (inferred)") for s, (o, b, _) in bodies.items()]
    return spark.createDataFrame(sorted(rows), "ord int, title string, body string"), evidence
