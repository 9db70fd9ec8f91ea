"""Source trees as a Spark data source.

Spark's file sources drop files whose names begin with an underscore or a dot, so package files would
vanish. ``source_tree`` walks folders itself, prunes ignored ones before descending, and reads contents in its
partitions. Options: path, ignore (lines), suffixes (comma-separated, empty for all), content (true), files (per partition).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scriptoria.functions.vocabulary import SCAN_SUFFIXES

SCHEMA = "path string, relpath string, suffix string, size long, content binary"


def walk(base: str, ignore: list[str], suffixes: list[str]) -> Iterator[str]:
    """Files below ``base`` in the order of the walk; ``.git`` and ignored paths are not entered."""
    skip = {os.path.abspath(p) for p in ignore}
    for folder, dirs, files in os.walk(os.path.abspath(base)):
        dirs[:] = sorted(d for d in dirs if d != ".git" and os.path.join(folder, d) not in skip)
        for name in sorted(files):
            path = os.path.join(folder, name)
            if path not in skip and not any(path.startswith(s + os.sep) for s in skip) and (not suffixes or any(name.endswith(s) for s in suffixes)):
                yield path


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base = os.path.abspath(options["path"])
        self.ignore = [x for x in options.get("ignore", "").split("\n") if x]
        self.suffixes = [x for x in options.get("suffixes", ",".join(SCAN_SUFFIXES)).split(",") if x]
        self.content = options.get("content", "true").lower() == "true"
        self.per_part = max(1, int(options.get("files", "256")))

    def partitions(self) -> list[_Part]:
        paths = list(walk(self.base, self.ignore, self.suffixes))
        return [_Part(paths[i : i + self.per_part]) for i in range(0, len(paths), self.per_part)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                size = os.path.getsize(path)
                content = open(path, "rb").read() if self.content else None  # noqa: SIM115
            except OSError:
                continue
            yield path, os.path.relpath(path, self.base).replace(os.sep, "/"), os.path.splitext(path)[1], size, content


class SourceTree(DataSource):
    """The ``source_tree`` format."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, base: str, ignore: list[str] | tuple[str, ...] = (), suffixes: list[str] | None = None, content: bool = True) -> DataFrame:
    """Files of a tree, a row each; ``suffixes`` None takes the source suffixes, an empty list all files."""
    spark.dataSource.register(SourceTree)
    kinds = list(SCAN_SUFFIXES) if suffixes is None else suffixes
    return spark.read.format("source_tree").option("path", base).option("ignore", "\n".join(ignore)).option("suffixes", ",".join(kinds)).option("content", str(content).lower()).load()


def with_language(files: DataFrame) -> DataFrame:
    """``files`` with ``language`` by suffix, null for others."""
    table = F.create_map(*[F.lit(x) for pair in SCAN_SUFFIXES.items() for x in pair])
    return files.withColumn("language", F.try_element_at(table, F.col("suffix")))


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with valid UTF-8 as ``text``, and the rejected others."""
    text = files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    binary = F.col("language") == "simulink" if "language" in files.columns else F.lit(False)
    ok = F.is_valid_utf8(F.col("content").cast("string")) | F.coalesce(binary, F.lit(False))
    return text.where(ok), text.where(~ok).drop("text")


def markdown_files(files: DataFrame) -> DataFrame:
    """The root readme, then every ``.md`` below a folder called docs in any letter case; ``ord`` is their order."""
    folders = F.split(F.lower("relpath"), "/")
    below = F.array_contains(F.slice(folders, 1, F.size(folders) - 1), "docs") & F.endswith("relpath", F.lit(".md"))
    root = F.col("relpath") == "README.md"
    return files.where(root | below).withColumn("ord", F.struct((~root).alias("later"), F.col("relpath").alias("path")))


#: Groups of documents in the order in which they are collected, as patterns of relative paths.
DOCUMENT_GROUPS = [r"README\.md", r"[^/]+\.md", r"[^/]+\.txt", r"[^/]+\.html", r"[^/]+\.docx", r"docs/(?:.*/)?[^/]+\.html", r"docs/(?:.*/)?[^/]+\.md"]
#: The same for a search of the whole tree.
FILE_GROUPS = [rf"(?:.*/)?{name}" for name in (r"README\.md", r"[^/]+\.txt", r"[^/]+\.html", r"[^/]+\.docx", r"[^/]+\.csv", r"[^/]+\.json")]


def collected(files: DataFrame, groups: list[str] = DOCUMENT_GROUPS) -> DataFrame:
    """Files that a group matches, each once, with ``group`` (the first that matches); order them by group, then path."""
    which = F.coalesce(*[F.when(F.col("relpath").rlike(f"^{g}$"), F.lit(i)) for i, g in enumerate(groups)])
    return files.withColumn("group", which).where("group is not null")
