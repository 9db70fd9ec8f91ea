"""Command line: ``python -m scriptoria.cli document|manual|review|sanitize|sidebar ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptoria.operators.lint import review, rewritten
from scriptoria.plans.document import document
from scriptoria.plans.manual import write_manual
from scriptoria.plans.models import Extractive, HttpModel
from scriptoria.runtime import ship_package
from scriptoria.sinks.pages import clean_folder, evidence_json, manual_pages, replace_sidebar, write_assets, write_pages
from scriptoria.sinks.pdf import write_pdfs
from scriptoria.sources.tree import scan


def _html(spark: SparkSession, folder: str):
    files = scan(spark, folder, suffixes=[".html"])
    return files.select("relpath", F.try_validate_utf8(F.col("content").cast("string")).alias("html")).where("html is not null")


def main(argv: list[str] | None = None) -> int:
    """Run a command; 0 if it succeeded."""
    parser = argparse.ArgumentParser(prog="scriptoria")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("document", "manual"):
        p = commands.add_parser(name)
        p.add_argument("source")
        p.add_argument("--output", required=True)
        p.add_argument("--ignore", nargs="*", default=[])
        p.add_argument("--model-url")
        p.add_argument("--cache")
        p.add_argument("--context", type=int, default=4096)
        p.add_argument("--no-code", action="store_true")
        p.add_argument("--pdf", action="store_true", help="also write the manual as a PDF")
    for name in ("review", "sanitize", "sidebar"):
        p = commands.add_parser(name)
        p.add_argument("folder")
        p.add_argument("--autofix", action="store_true")
        p.add_argument("--navigation", help="HTML of the new sidebar")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("scriptoria").getOrCreate()
    ship_package(spark)
    if args.command in ("document", "manual"):
        if os.path.abspath(args.output) == os.path.abspath(args.source):
            print("the output must not be the source", file=sys.stderr)
            return 2
        model = HttpModel(args.model_url) if args.model_url else Extractive()
        if isinstance(model, HttpModel) and not model.ping():
            print("the model does not answer", file=sys.stderr)
            return 1
        os.makedirs(args.output, exist_ok=True)
        if args.command == "document":
            clean_folder(args.output)
            document(spark, args.source, model, args.output, args.ignore, args.cache, args.context)
        else:
            sections, evidence = write_manual(spark, args.source, model, not args.no_code, args.cache, args.context)
            page = manual_pages(sections.withColumn("id", F.lit("user_manual")), "id")
            made = page.select(F.lit("user_manual.html").alias("path"), "html")
            write_pages(made, args.output)
            write_assets(args.output)
            if args.pdf:
                write_pdfs(made, args.output)
            write_pages(evidence_json(spark, evidence).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "json")))).alias("html")).select(F.lit("user_manual_evidence.json").alias("path"), "html"), args.output)
        return 0
    pages = _html(spark, args.folder)
    if args.command == "review":
        findings = review(pages, "relpath", "html").orderBy("relpath", "kind", "detail")
        for row in findings.toLocalIterator():
            print(f"[{row['kind']}] {row['relpath']}: {row['detail']}" + (f" (line {row['line']})" if row["line"] is not None else ""))
        if args.autofix:
            bad = pages.join(findings.select("relpath").distinct(), "relpath", "left_semi")
            write_pages(bad.select(F.col("relpath").alias("path"), rewritten(F.col("html"), "paragraphs").alias("html")), args.folder)
    elif args.command == "sanitize":
        write_pages(pages.select(F.col("relpath").alias("path"), rewritten(F.col("html")).alias("html")), args.folder)
    else:
        top = pages.where(~F.contains("relpath", F.lit("/")))
        write_pages(top.select(F.col("relpath").alias("path"), replace_sidebar(F.col("html"), F.lit(args.navigation or "")).alias("html")), args.folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
