"""Python files to symbol rows."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

from scriptoria.parsers.rows import Parsed

Function = (ast.FunctionDef, ast.AsyncFunctionDef)
# How kinds of statements are called; others go by the name of their class.
KINDS = {
    "Assign": "assignment", "AnnAssign": "annotated assignment", "AugAssign": "augmented assignment", "Import": "import", "ImportFrom": "import",
    "If": "if statement", "For": "for loop", "AsyncFor": "async for loop", "While": "while loop", "With": "with statement", "AsyncWith": "async with statement",
    "Try": "try statement", "Expr": "expression", "Return": "return statement", "Delete": "delete statement", "Raise": "raise statement",
    "Assert": "assertion", "Global": "global declaration", "Nonlocal": "nonlocal declaration", "Pass": "pass statement",
}


def arguments(a: ast.arguments) -> str:
    """Parameters as text; the positional-only mark sticks to the last such parameter."""
    plain = [*a.posonlyargs, *a.args]
    given = dict(zip(plain[len(plain) - len(a.defaults) :], a.defaults)) | {k: d for k, d in zip(a.kwonlyargs, a.kw_defaults) if d is not None}

    def one(arg: ast.arg) -> str:
        note = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
        return arg.arg + note + (f"={ast.unparse(given[arg])}" if arg in given else "")

    out = [one(x) + ("/" if x is a.posonlyargs[-1] else "") for x in a.posonlyargs] + [one(x) for x in a.args]
    if a.vararg or a.kwonlyargs:
        out.append("*" + (one(a.vararg) if a.vararg else ""))
    out += [one(x) for x in a.kwonlyargs]
    return ", ".join(out + (["**" + one(a.kwarg)] if a.kwarg else []))


def callee(node: ast.expr) -> str | None:
    """The dotted name of what is called: names, attributes, results of calls and string literals only."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Call(func=f):
            return callee(f)
        case ast.Attribute(value=ast.Constant(value=v), attr=attr):
            return f"{v}.{attr}" if isinstance(v, str) else attr
        case ast.Attribute(value=(ast.Name() | ast.Attribute()) as inner, attr=attr):
            head = callee(inner)
            return f"{head}.{attr}" if head else None
        case ast.Attribute(value=ast.Call(func=f), attr=attr):
            head = callee(f)
            return f"{head}.{attr}" if head else attr
    return None


def calls(body: list[ast.stmt]) -> list[str]:
    """Distinct callees in order; nested definitions keep theirs, the callee's own expression is not searched."""
    found: dict[str, None] = {}

    def visit(node: ast.AST) -> None:
        if isinstance(node, (*Function, ast.ClassDef)):
            return
        if isinstance(node, ast.Call):
            if name := callee(node.func):
                found[name] = None
            for part in [*node.args, *(k.value for k in node.keywords)]:
                visit(part)
            return
        for child in ast.iter_child_nodes(node):
            visit(child)

    for statement in body:
        visit(statement)
    return list(found)


def _title(node: ast.stmt) -> str:
    """A short name of a statement."""
    text = lambda x: ast.unparse(x).strip()
    loop = "async " if isinstance(node, (ast.AsyncFor, ast.AsyncWith)) else ""
    match node:
        case ast.Assign():
            return ", ".join(map(text, node.targets))
        case ast.AnnAssign() | ast.AugAssign():
            return text(node.target)
        case ast.Import():
            return "import " + ", ".join(map(text, node.names))
        case ast.ImportFrom():
            return f"from {node.module or '.'} import " + ", ".join(map(text, node.names))
        case ast.If() | ast.While():
            return f"{type(node).__name__.lower()} {text(node.test)}"
        case ast.For() | ast.AsyncFor():
            return f"{loop}for {text(node.target)} in {text(node.iter)}"
        case ast.With() | ast.AsyncWith():
            return f"{loop}with " + ", ".join(map(text, node.items))
        case ast.Try():
            return "try block"
        case ast.Expr():
            return text(node.value)
        case ast.Assert():
            return f"assert {text(node.test)}"
        case ast.Raise() if node.exc is not None:
            return f"raise {text(node.exc)}"
        case ast.Return() | ast.Pass():
            return type(node).__name__.lower()
        case ast.Delete():
            return "del " + ", ".join(map(text, node.targets))
        case ast.Global() | ast.Nonlocal():
            return ", ".join(node.names)
    return f"{type(node).__name__} at line {node.lineno}"


#: Lines with their ends, as the parser counts them.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def _literal(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def parse(module_id: str, source: str) -> Parsed:
    """All classes, functions, methods, variables and statements of a file.

    Classes within methods appear under the method and again under the class. Raises SyntaxError.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    out = Parsed(module_id, {"module_docstring": ast.get_docstring(tree)})

    lines = _LINE.findall(source)

    def segment(node: ast.AST) -> str:
        """The text of a statement; columns count bytes."""
        part = lines[node.lineno - 1 : node.end_lineno]
        if not part:
            return ast.unparse(node)
        part[-1] = part[-1].encode()[: node.end_col_offset].decode()
        part[0] = part[0].encode()[node.col_offset :].decode()
        return "".join(part) or ast.unparse(node)

    def nested_classes(body: list[ast.stmt], path: str) -> Iterator[tuple[ast.ClassDef, str]]:
        for item in body:
            if isinstance(item, ast.ClassDef):
                yield item, path
            elif isinstance(item, Function):
                yield from nested_classes(item.body, f"{path}.{item.name}" if path else item.name)

    def function(node, parent: dict | None, kind: str) -> None:
        row = out.add(
            kind, node.name, parent,
            signature=f"{node.name}({arguments(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""),
            returns=ast.unparse(node.returns) if node.returns else None,
            args=[x.arg for x in ast.walk(node.args) if isinstance(x, ast.arg)],
            docstring=ast.get_docstring(node), source=segment(node), lineno=node.lineno, calls=calls(node.body),
        )
        for item in node.body:
            if isinstance(item, Function):
                function(item, row, "function")
            elif isinstance(item, ast.ClassDef):
                klass(item, row)

    def klass(node: ast.ClassDef, parent: dict | None, path: str | None = None) -> None:
        row = out.add("class", node.name, parent, docstring=ast.get_docstring(node), source=segment(node), lineno=node.lineno)
        if path is not None:
            row["qualname"] = f"{path}.{node.name}"
        for item in node.body:
            if isinstance(item, Function):
                function(item, row, "method")
        for item, where in nested_classes(node.body, row["qualname"]):
            klass(item, row, where)

    for node in tree.body:
        if isinstance(node, Function):
            function(node, None, "function")
        elif isinstance(node, ast.ClassDef):
            klass(node, None)
        elif not _literal(node):
            name = type(node).__name__
            label = KINDS.get(name, f"{name.replace('_', ' ').lower()} statement")
            out.add("variable" if name in ("Assign", "AnnAssign", "AugAssign") else "statement", _title(node), stmt_kind=label, source=segment(node), lineno=node.lineno)
    return out
