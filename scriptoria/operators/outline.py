"""Outlines, member bullets, navigation trees and prompts: ordered aggregation of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import file_name, stem


def listed(rows: DataFrame, keys: list[str], line: Column, order: list[str], out: str = "text", separator: str = "\n") -> DataFrame:
    """Lines of each group joined in order.

    Each task sorts only its groups' lines; groups are modules, classes or sections.
    """
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("__l")))), lambda s: s["__l"]), separator).alias(out))


def module_outline(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(module_id, outline)``: a module's name with its classes, their methods and its functions, in source order.

    A module without any says so. Symbols nested in functions are not listed.
    """
    s = symbols.where("module_id is not null").select("module_id", "symbol_id", "parent_id", "kind", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ord", F.lit(0)).alias("ord"))
    methods = listed(s.where("kind = 'method' and parent_id is not null"), ["module_id", "parent_id"], F.concat(F.lit("    - method "), F.col("name")), ["ord", "symbol_id"], "m")
    classes = s.where("kind = 'class' and parent_id is null").join(methods.withColumnRenamed("parent_id", "symbol_id"), ["module_id", "symbol_id"], "left")
    lines = classes.select("module_id", F.lit(0).alias("r"), "ord", "symbol_id", F.concat_ws("\n", F.concat(F.lit("  - class "), F.col("name")), "m").alias("l")).unionByName(
        s.where("kind = 'function' and parent_id is null").select("module_id", F.lit(1).alias("r"), "ord", "symbol_id", F.concat(F.lit("  - function "), F.col("name")).alias("l"))
    )
    body = listed(lines, ["module_id"], F.col("l"), ["r", "ord", "symbol_id"], "body")
    return modules.select("module_id", "name").join(body, "module_id", "left").select("module_id", F.concat(F.lit("- module "), F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("  (no classes or functions defined)"))).alias("outline"))


def member_bullets(symbols: DataFrame) -> DataFrame:
    """``(parent_id, text)``: the members of each class as bullets with their summaries, in source order."""
    s = symbols.where("parent_id is not null")
    text = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), F.col("summary"))).otherwise(""))
    return listed(s.select("parent_id", "symbol_id", F.coalesce("ord", F.lit(0)).alias("ord"), text.alias("l")), ["parent_id"], F.col("l"), ["ord", "symbol_id"])


def last_summaries(modules: DataFrame, order: str) -> DataFrame:
    """``(name, summary)``: of modules of one name the last by ``order``."""
    return modules.where("name is not null").groupBy("name").agg(F.max_by("summary", order).alias("summary"))


def navigation(files: DataFrame, path_col: str) -> DataFrame:
    """``(folder, depth, entries)``: each folder's files, then its folders, by name; the root is the empty folder."""
    p = files.where(F.coalesce(path_col, F.lit("")) != "").select(F.split(path_col, "/").alias("parts")).distinct()
    steps = p.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("parts")),
                lambda n: F.struct(F.array_join(F.slice("parts", 1, n - 1), "/").alias("folder"), (n - 1).alias("depth"), (n < F.size("parts")).alias("dir"), F.col("parts")[n - 1].alias("name")),
            )
        ).alias("s")
    ).select("s.*").distinct()
    entry = F.concat(F.col("name"), F.when(F.col("dir"), "/").otherwise(""))
    return listed(steps, ["folder", "depth"], entry, ["dir", "name"], "entries", " ")


def page_links(files: DataFrame, path_col: str) -> DataFrame:
    """``(path, link)``: the page of each file, keyed by its whole path so that equal stems do not collide."""
    p = F.col(path_col)
    folder = F.regexp_extract(p, r"^(.*/)", 1)
    return files.where(F.coalesce(p, F.lit("")) != "").select(path_col, F.concat(folder, stem(p), F.lit(".html")).alias("link")).distinct()


def name_collisions(files: DataFrame, path_col: str) -> DataFrame:
    """``(stem, n)``: stems that name the page of more than one path."""
    p = F.col(path_col)
    return files.where(p.isNotNull()).select(stem(p).alias("stem"), p.alias("p")).distinct().groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


def function_prompt(symbols: DataFrame) -> DataFrame:
    """``(symbol_id, prompt)``: the parts of a symbol that a model is shown, absent ones left out."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return symbols.select(
        "symbol_id",
        F.concat_ws("\n", part("Name: ", F.col("qualname")), part("Signature: ", F.col("signature")), part("Returns: ", F.col("returns")), part("Docstring: ", F.col("docstring")), part("Code:\n", F.col("source"))).alias("prompt"),
    )


def first_of_each(rows: DataFrame, key: Column, order: list[str], columns: list[str], out: str = "key") -> DataFrame:
    """Ordered distinct: the first row of each key."""
    return rows.groupBy(key.alias(out)).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"), F.count("*").alias("n")).select(out, "r.*", "n")


def folder_sizes(files: DataFrame, path_col: str) -> DataFrame:
    """``(folder, files)``: number of files directly in each folder."""
    p = F.col(path_col)
    return files.where(F.coalesce(p, F.lit("")) != "").select(F.regexp_extract(p, r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), file_name(p).alias("name")).distinct().groupBy("folder").agg(F.count("*").alias("files"))
