"""Flat rows of parsed source files: one per file and one per symbol."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S = T.StringType()

SYMBOLS = T.StructType(
    [T.StructField("module_id", _S), T.StructField("symbol_id", _S), T.StructField("parent_id", _S)]
    + [T.StructField(n, _S) for n in ("kind", "name", "qualname", "signature", "returns")]
    + [T.StructField("args", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in ("vartype", "stmt_kind", "docstring", "source")]
    + [T.StructField(n, T.IntegerType()) for n in ("ord", "depth", "lineno")]
    + [T.StructField("calls", T.ArrayType(_S))]
)
MODEL = T.StructType(
    [
        T.StructField("name", _S),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("type", _S), T.StructField("parameters", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("value", _S)])))]))),
        T.StructField("connections", T.ArrayType(T.StructType([T.StructField("source", _S), T.StructField("target", _S)]))),
    ]
)
MODULES = T.StructType([T.StructField("module_id", _S), T.StructField("language", _S), T.StructField("ok", T.BooleanType()), T.StructField("error", _S), *(T.StructField(n, _S) for n in ("module_docstring", "header", "namespace", "package")), T.StructField("model", MODEL)])


@dataclass
class Parsed:
    """What a parser found in one file; symbols are dicts with keys of ``SYMBOLS``."""

    module_id: str
    module: dict = field(default_factory=dict)
    symbols: list[dict] = field(default_factory=list)
    children: dict[str | None, int] = field(default_factory=dict)

    def add(self, kind: str, name: str, parent: dict | None = None, **more: object) -> dict:
        """A new symbol under ``parent``; its place among its siblings and its qualified name follow."""
        base = parent["qualname"] if parent else None
        above = parent["symbol_id"] if parent else None
        place = self.children.get(above, 0)
        self.children[above] = place + 1
        row = dict.fromkeys(SYMBOLS.names) | {
            "module_id": self.module_id,
            "symbol_id": f"{self.module_id}:{len(self.symbols)}",
            "parent_id": above,
            "kind": kind,
            "name": name,
            "qualname": f"{base}.{name}" if base else name,
            "ord": place,
            "depth": parent["depth"] + 1 if parent else 0,
        }
        self.symbols.append(row | more)
        return self.symbols[-1]
