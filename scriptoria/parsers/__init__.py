"""Source files to rows: ``parse_files`` reads (module_id, language, content) and gives modules, symbols and rejects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from scriptoria.parsers import line_source, python_source, simulink
from scriptoria.parsers.rows import MODULES, SYMBOLS, Parsed

PARSERS = {"python": python_source.parse, "cpp": line_source.parse_cpp, "java": line_source.parse_java, "javascript": line_source.parse_script, "typescript": line_source.parse_script, "matlab": line_source.parse_matlab}


def parse_one(module_id: str, language: str | None, content: str | bytes | None, suffix: str = "") -> tuple[Parsed | None, str | None]:
    """What a file holds, or why it was rejected. Any failure of a parser rejects its file alone."""
    try:
        if content is None:
            return None, "no content"
        if language == "simulink":
            return simulink.parse(module_id, content.encode() if isinstance(content, str) else content, suffix), None
        if language not in PARSERS:
            return None, f"unknown language {language}"
        return PARSERS[language](module_id, content.decode("utf-8") if isinstance(content, bytes) else content), None
    except (SyntaxError, UnicodeDecodeError, ValueError, RecursionError, MemoryError, IndexError) as e:
        return None, f"{type(e).__name__}: {e}"


_ROWS = StructType([*MODULES.fields, StructField("symbols", ArrayType(SYMBOLS))])


def parse_files(files: DataFrame, id_col: str = "module_id", language_col: str = "language", content_col: str = "content", path_col: str | None = None) -> DataFrame:
    """One row per file: module fields, ``ok`` and ``error``, and its symbols as an array.

    Null content, unknown languages and files that do not parse have ``ok`` false and no symbols.
    """
    suffix = F.regexp_extract(F.lower(path_col), r"(\.\w+)$", 1) if path_col else F.lit("")
    chosen = files.select(F.col(id_col).cast("string").alias("id"), F.lower(language_col).alias("language"), F.col(content_col).alias("content"), suffix.alias("suffix"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, language, content, ending in pdf.itertuples(index=False):
                parsed, error = parse_one(key, language, content, ending)
                module = dict.fromkeys(MODULES.names) | {"module_id": key, "language": language, "ok": parsed is not None, "error": error}
                rows.append(module | (parsed.module | {"symbols": parsed.symbols} if parsed else {"symbols": []}))
            yield pd.DataFrame(rows, columns=_ROWS.names)

    return chosen.mapInPandas(run, _ROWS)


def symbols_of(parsed: DataFrame) -> DataFrame:
    """The symbols of parsed files, a row each."""
    return parsed.select(F.explode("symbols").alias("s")).select("s.*")


def modules_of(parsed: DataFrame) -> DataFrame:
    """The files that parsed."""
    return parsed.where("ok").drop("symbols", "ok", "error")


def rejects_of(parsed: DataFrame) -> DataFrame:
    """``(module_id, language, error)`` of the files that did not."""
    return parsed.where("not ok").select("module_id", "language", "error")
