"""Problem 4: pair functions and methods with their documentation comments.

Each file becomes a table of symbols with qualified names and normalised signatures. Definitions
without a comment of their own are joined with documented declarations of the same project, name and
signature (a header's prototypes, overload signatures); then pairs whose documentation is trivial are
dropped. Only the parsing is Python, one file at a time; the rest is joins and filters.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from scriptoria.runtime import cut_lineage, salted_join, table, widen

LANGUAGES = ("python", "java", "cpp", "javascript", "typescript", "matlab")
#: Languages whose functions may be declared apart from their definition.
DECLARING = ("cpp", "typescript")
#: Language by file suffix, for rows without one.
SUFFIXES = {"py": "python", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "c": "cpp", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "m": "matlab"}

_PARENS = r"\((?P<p>(?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+)\)"
_GENERIC = r"(?:<[^(){};]*>)?"
_STRINGS = r"\"(?:[^\"\\\n]++|\\.)*+\"|(?<![0-9A-Za-z_])'(?:[^'\\\n]++|\\.)*+'"
_COMMENTS = r"(?P<c>//[^\n]*+|/\*.*?(?:\*/|\Z))"
_REGEX = r"|(?:(?<=[=(,:;!&|?{}\[\n])|(?<=return)) *+/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*"
_LEXERS = {
    "java": re.compile(rf"{_COMMENTS}|\"\"\".*?\"\"\"|{_STRINGS}", re.S),
    "cpp": re.compile(rf"{_COMMENTS}|R\"(?P<d>[^(\s\\]{{0,16}})\(.*?\)(?P=d)\"|{_STRINGS}", re.S),
    "javascript": re.compile(rf"{_COMMENTS}|`(?:[^`\\]++|\\.)*+`|{_STRINGS}{_REGEX}", re.S),
}
_LEXERS["typescript"] = _LEXERS["javascript"]
_ANNOTATION = r"(?:@(?!interface\b)[\w.]+(?:[ \t]*\((?:[^()]++|\([^()]*+\))*+\))?\s*+)*+"
_ARROW = rf"(?:async\b\s*)?(?:function\b\s*\*?\s*(?P<own>[\w$]*)\s*{_GENERIC}\s*{_PARENS}|{_GENERIC}\s*(?:{_PARENS.replace('?P<p>', '?P<q>')}\s*(?::[^={{}};]*+)?|(?P<one>[\w$]+)\s*)=>)"
_HEADS = {
    "java": [
        re.compile(
            rf"{_ANNOTATION}(?P<t>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*+(?:<[^(){{}};]*>\s*)?(?:[\w.$]+{_GENERIC}(?:\s*\[\])*\s+)?)(?P<n>[A-Za-z_$][\w$]*)\s*{_PARENS}\s*(?:throws\s+[\w.,\s]+?)?\s*(?P<e>[{{;])"
        )
    ],
    "cpp": [
        re.compile(
            rf"(?:(?:template\s*<[^(){{}};]*>|\[\[[^\]]*\]\])\s*)*(?P<t>(?:[\w:]+{_GENERIC}[\s*&]+)*)(?P<n>(?:\w+{_GENERIC}::)*~?(?:operator\s*[^\s\w(]+|[A-Za-z_]\w*))\s*{_PARENS}\s*(?:(?:const|noexcept|override|final|volatile|&&?|throw\s*\(\)|->\s*[\w:<>,*& ]+)\s*)*(?::(?!:)[^;{{]*)?(?P<e>[{{;])"
        )
    ],
    "javascript": [
        re.compile(rf"{_ANNOTATION}(?P<t>(?:(?:export|default|declare|async)\s+)*+)function\b\s*\*?\s*(?P<n>[\w$]+)\s*{_GENERIC}\s*{_PARENS}\s*(?::[^{{;]*(?:\{{[^{{}}]*\}}[^{{;]*)?)?(?P<e>[{{;])"),
        re.compile(rf"(?P<t>(?:(?:export|default|declare)\s+)*+)(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::(?:[^=]|=>)*)?=\s*{_ARROW}"),
        re.compile(rf"(?P<t>)(?:[\w$]+\.)+(?P<n>[\w$]+)\s*=\s*{_ARROW}"),
        re.compile(
            rf"{_ANNOTATION}(?P<t>(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set|declare)\s+)*+)\*?\s*(?P<n>\#?[\w$]+)\s*\??{_GENERIC}\s*{_PARENS}\s*(?::\s*[^{{;=]*(?:\{{[^{{}}]*\}}\s*(?=\{{))?)?(?P<e>[{{;])"
        ),
        re.compile(rf"{_ANNOTATION}(?P<t>(?:(?:public|private|protected|static|readonly)\s+)*+)[\"']?(?P<n>\#?[\w$]+)[\"']?\s*(?::(?!:)\s*|(?::[^=;{{}}()]*)?=\s*){_ARROW}"),
    ],
}
_HEADS["typescript"] = _HEADS["javascript"]
# Words that look like a name before parentheses but are not.
_KEYWORDS = frozenset("if for while switch catch return sizeof throw new else do case assert yield await typeof delete in of instanceof function class super this with synchronized try import".split())
_NOT_TYPES = frozenset("return new throw else case assert yield await goto delete".split())

# What documentation without content says.
_DIRECTIVE = re.compile(
    r"^[@#!]*(?:eslint|tslint|jshint|jslint|jscs|prettier-|istanbul|c8 |v8 |ts-(?:ignore|expect|nocheck)|noqa|nosonar|nolint|nosec|pylint|flake8|mypy|pyright|type: ?ignore|pragma|clang-|cppcheck|iwyu|checkstyle|spotless|sonar|noinspection|region\b|endregion\b|coverage|fmt: ?o|isort|yapf|ruff|lint|suppress|flow|globals? |webpack|ok<|#ok|cspell|codespell|formatter:)"
)
_STAND_IN = re.compile(
    r"^(?:(?:todo|fixme|xxx|tbd|tba|tbc|wip|hack|to ?do)\b(?:\([^)]*\))?[\s:.\-]*(?:(?:describe|document|write|add|fill in|explain|complete|do|finish)?\s*(?:this|me|it|docs?|documentation|description|a description|the docs?|comment|function|method)?\s*(?:function|method|here|later|properly|soon|in|some day)?)[\s.!]*|"
    r"n/?a|none|null|nothing|empty|undocumented|missing|(?:no|missing|without) (?:description|documentation|docs?|comment|docstring|summary|details?)(?: (?:yet|available|given|provided|here))?|(?:auto-?)?generated (?:method |function |constructor )?stub|"
    r"(?:add|insert|write|put|enter|fill in) (?:the |a |your |some )?(?:docs?|documentation|description|comment|docstring|text)(?: here| later| this)?|(?:documentation|description|docs?|comment)(?: (?:goes|to go|comes) here| here| follows| pending| to follow| missing)?|"
    r"(?:self-?explanatory|obvious|stub|placeholder|dummy|ditto|same|inherited|internal|deprecated|done|\{?@?inheritdoc\}?|to be (?:documented|described|written|done|completed)|document(?:ed)? (?:me|later|elsewhere|this))|"
    r"(?:please )?(?:see|refer to|cf|same as|documented in|described in|docs? (?:are |is )?(?:in|at)|documentation (?:is )?(?:in|at)|for (?:details|more|documentation),? see|as (?:above|below|in the (?:base|parent|super)\w*))\b(?:(?!\b(?:but|except|which|that|returns?|only|without|if|whether|how|when|unless)\b)[^.!?]|\.(?=\w))*)[\s.!]*$"
)
_TAG = re.compile(r"[@\\](?:param|arg|argument|tparam)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?(?:\[[^\]\n]*\]|[\w.$*]+)?|^[ \t]*[\w*]+[ \t]*(?:\([^)\n]*\))?[ \t]*:[ \t]*$|[@\\](?:param|arg|argument|tparam|returns?|throws?|exception|brief|details?|since|author|version|see|link|code|type|name|function|method|memberof|public|private|protected|static|async|override|deprecated|inheritdoc)\b|:(?:param|type|returns?|rtype|raises?|arg|key|keyword)\b[^:\n]*:|^\s*(?:args|arguments|parameters|params|returns?|raises|yields|inputs?|outputs?|examples?|notes?|syntax|throws)\s*:", re.I | re.M)
_EMPTY_WORDS = frozenset(
    "the a an this that function functions method methods func procedure routine subroutine docs doc docstring documentation comment for of to and or is it does do implements implementation param params parameter parameters arg args argument arguments return returns none void str int float bool".split()
)
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_A-Za-z]+")


@lru_cache(maxsize=50_000)
def _stem(word: str) -> str:
    for end in ("ies", "ing", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 2:
            return word[: -len(end)]
    return word


def words(text: str) -> list[str]:
    """Words of ``text`` in lower case; names are split at underscores and capitals."""
    return [w.lower() for w in _CAMEL.findall(text)]


_MARKUP = re.compile(r"^\s*(?:/\*+!?<?|//+[!<]?|\*+(?!/)|%+[{}]?|#+(?=\s|$))|\*+/\s*$")
_CLOSE = re.compile(r"^\s*\*+/")
_POINTERS = re.compile(r"(?mi)^\s*[@\\](?:see|link|copydoc|seealso)\b.*$|\{@(?:see|link|inheritdoc)[^}]*\}")


def plain(comment: str) -> str:
    """A comment or docstring without its markup."""
    lines = []
    for line in comment.replace("\r", "").split("\n"):
        line = line.strip()
        if line and not line[0].isalnum() or line.endswith("/"):
            line = _CLOSE.sub("", _MARKUP.sub("", line)).strip()
        if not _DIRECTIVE.match(line.lower()):
            lines.append(line)
    return "\n".join(lines).strip()


@lru_cache(maxsize=20_000)
def _says_nothing(text: str) -> bool:
    low = " ".join(text.lower().split()).strip(" *_-=#~<>/`\"'")
    return not any(c.isalnum() for c in low) or bool(_STAND_IN.match(low)) or bool(re.fullmatch(r"<p>|</?\w+>", low))


@lru_cache(maxsize=50_000)
def _known(name: str, parameters: str) -> frozenset[str]:
    """What the names of a function and its parameters say."""
    return frozenset({_stem(w) for w in words(name)} | {_stem(w) for w in words(parameters)} | {name.lower()})


def trivial(doc: str | None, name: str, parameters: str) -> bool:
    """Whether ``doc`` says nothing beyond the names of the function and its parameters."""
    if not doc:
        return True
    text = plain(doc)
    if "@" in text or "\\" in text:
        text = _POINTERS.sub(" ", text)
    untagged = _TAG.sub(" ", text)
    if _says_nothing(text) or _says_nothing(untagged):
        return True
    known = _known(name, parameters)
    return all(w in _EMPTY_WORDS or w in known or _stem(w) in known for w in words(untagged))


_BRACKETED = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")


@lru_cache(maxsize=50_000)
def normalised(parameters: str, language: str) -> str:
    """Parameter types of a signature (their number where the language has no types), without names and defaults."""
    if language not in ("cpp", "java", "typescript"):
        # only their number counts, of those that are not in brackets
        flat = parameters
        while (less := _BRACKETED.sub("", flat)) != flat:
            flat = less
        return ",".join("_" for part in flat.split(",") if part.split("=")[0].strip())
    parts, depth, part = [], 0, ""
    for c in parameters + ",":
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth <= 0:
            parts.append(part)
            part = ""
        else:
            part += c
    types = []
    for part in parts:
        part = re.sub(r"/\*.*?\*/|//[^\n]*", " ", part).split("=")[0].strip()
        if not part or part == "void":
            continue
        if language in ("cpp", "java"):
            part = re.sub(r"\b(?:const|final|volatile|struct|class|typename)\b|@\w+", " ", part)
            m = re.match(r"^(.*[\w>\]*&.])[\s*&]*?(?<![\w:<])\s*\b(\w+)\s*((?:\[\])*)$", part.strip()) if re.search(r"[\s*&>]\w+\s*(?:\[\])*$", part.strip()) else None
            part = re.sub(r"\s+\w+$|(?<=[*&>])\w+$", "", part.strip()) if m or re.search(r"[*&>]\w+$", part.strip()) else part
            types.append(re.sub(r"[\s&]+", "", part))
        elif language == "typescript" and ":" in part:
            types.append(re.sub(r"\s+", "", part.split(":", 1)[1]))
        else:
            types.append("_")
    return ",".join(types)


Symbol = tuple[int, str, str, str, str, str | None, str | None, str]  # lineno, name, qualname, signature, parameters, doc, source, kind


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def _segment(lines: list[str], node: ast.stmt) -> str:
    """The text of a statement, given the lines of its file."""
    part = lines[node.lineno - 1 : node.end_lineno]
    part[-1] = part[-1].encode()[: node.end_col_offset].decode(errors="ignore")
    part[0] = part[0].encode()[node.col_offset :].decode(errors="ignore")
    return "".join(part)


def python_functions(source: str, bodies: bool, undocumented: bool) -> Iterator[Symbol]:
    """Functions of a Python file; a file that does not parse has none."""
    if "def " not in source:
        return
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = _LINE.findall(source) if bodies else []
    stack = [(tree, "")]
    while stack:
        node, prefix = stack.pop()
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):
            for child in getattr(node, field, None) or ():
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    stack.append((child, f"{prefix}{child.name}."))
                elif isinstance(child, (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith, ast.ExceptHandler, ast.TryStar, ast.Match, ast.match_case)):
                    stack.append((child, prefix))
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        first = node.body[0]
        doc = first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None
        if doc is None and not undocumented:
            continue
        a = node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x]
        head = ("async def " if isinstance(node, ast.AsyncFunctionDef) else "def ") + node.name
        signature = head + "(" + ast.unparse(a) + ")" + (f" -> {ast.unparse(node.returns)}" if node.returns else "") if bodies else head
        yield node.lineno, node.name, prefix[:-1], signature, ", ".join(names), doc, _segment(lines, node) if bodies else None, "definition"


def _blocks(source: str, lexer: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of comments that stand alone, neighbouring ones joined."""
    start = end = -1
    for m in lexer.finditer(source):
        if m["c"] is None:
            continue
        a, b = m.span()
        if start >= 0:
            gap = source[end:a]
            if not gap.strip() and gap.count("\n") <= 1:
                end = b
                continue
            yield start, end
            start = -1
        if not source[source.rfind("\n", 0, a) + 1 : a].strip():
            start, end = a, b
    if start >= 0:
        yield start, end


def _masked(source: str, lexer: re.Pattern) -> str:
    """``source`` with comments and strings blanked out, offsets kept."""
    return lexer.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_SCOPE = re.compile(r"\b(?:namespace|class|struct|interface|enum)\s+(?:\[\[.*?\]\]\s*)?(?P<n>[\w:]+)[^;{}()=]*\{|[{}]")
#: A line that may open a definition: not a statement, and with a parenthesis or an arrow.
_CANDIDATE = re.compile(r"^[ \t]*+(?!(?:if|else|for|while|do|switch|case|catch|return|throw|new|delete|goto|using|await|yield)\b|#(?!\w+\s*\())(?=[\w~@\[#$*\"'])(?=[^\n;{}]*(?:\(|=>))", re.M)


#: From the end of a comment to what stands directly below it.
_BELOW = re.compile(r"[ \t\r]*(?:\n[ \t]*)?(?=\S)")


class Scopes:
    """The braces of a file whose comments and strings are blanked: what closes each, and the named scopes around any place."""

    def __init__(self, masked: str) -> None:
        self.closes: dict[int, int] = {}
        self.starts: list[int] = [0]
        self.names: list[tuple[str, ...]] = [()]
        open_at: list[tuple[int, tuple[str, ...]]] = []
        for m in _SCOPE.finditer(masked):
            at, now = m.end() - 1, self.names[-1]
            if m[0] != "}":
                open_at.append((at, now))
                if m["n"]:
                    self._enter(m.end(), (*now, m["n"]))
            elif open_at:
                opened, before = open_at.pop()
                self.closes[opened] = m.end()
                if before != now:
                    self._enter(at, before)
        self.end = len(masked)

    def _enter(self, at: int, names: tuple[str, ...]) -> None:
        self.starts.append(at)
        self.names.append(names)

    def around(self, at: int) -> tuple[str, ...]:
        """Names of the scopes around ``at``, outermost first."""
        return self.names[bisect_right(self.starts, at) - 1]

    def closing(self, at: int) -> int:
        """Offset after the brace that closes the one at ``at``."""
        return self.closes.get(at, self.end)


def brace_functions(source: str, language: str, bodies: bool, undocumented: bool) -> Iterator[Symbol]:
    """Functions of a C++, Java, JavaScript or TypeScript file, with the comment that stands directly above; in linear time."""
    lexer, heads = _LEXERS[language], _HEADS[language]
    if "*/" not in source and "//" not in source and not undocumented:
        return
    masked = _masked(source, lexer)
    scopes = Scopes(masked)
    line_starts = [0, *accumulate(len(line) + 1 for line in source.split("\n"))]
    starts: dict[int, tuple[int, int]] = {}
    for a, b in _blocks(source, lexer):
        if m := _BELOW.match(source, b):
            starts[m.end()] = (a, b)
    places = [(at, starts[at]) for at in starts]
    if undocumented:
        places += [(m.end(), None) for m in _CANDIDATE.finditer(masked) if m.end() not in starts]
    for at, span in places:
        for head in heads:
            m = head.match(masked if span is None else source, at)
            if not m:
                continue
            name = m["n"]
            groups = m.groupdict()
            last = name.rpartition("::")[2]
            before = m["t"].split()
            if last in _KEYWORDS or (before and before[-1] in _NOT_TYPES):
                break
            ends = groups.get("e")
            if ends == ";" and (not before or span is None):
                break
            parameters = next((groups[g] for g in ("p", "q", "one") if groups.get(g) is not None), "")
            kind = "declaration" if ends == ";" and language != "java" else "definition"
            doc = source[span[0] : span[1]] if span else None
            place = m.start("n")
            inside = scopes.around(place)
            qualified = "::".join([*inside, name]) if language == "cpp" else ".".join([*inside, last])
            body = None
            if bodies:
                brace = m.end() - 1 if ends else masked.find("{", m.end())
                if ends != ";" and brace >= 0 and (ends or not masked[m.end() : brace].strip()):
                    stop = scopes.closing(brace)
                else:
                    stop = source.find("\n", m.end())
                body = source[at : stop if stop >= 0 else len(source)]
            yield bisect_right(line_starts, place), last, qualified, source[at : m.end()].rstrip("{; \n\t") if bodies else last, parameters, doc, body, kind
            break


_MATLAB = re.compile(r"^[ \t]*function\b[ \t]*(?:(?:\[[^\]\n]*\]|\w+)[ \t]*=[ \t]*)?(?P<n>[A-Za-z][\w.]*)[ \t]*(?:\((?P<p>[^)\n]*)\))?")


def matlab_functions(source: str, bodies: bool, undocumented: bool) -> Iterator[Symbol]:
    """Functions of a MATLAB file with the comment directly above or below their line."""
    lines = source.split("\n")
    comment, block = [False] * len(lines), False
    for i, line in enumerate(lines):
        text = line.strip()
        block |= text in ("%{", "#{")
        comment[i] = block or text.startswith("%")
        if text in ("%}", "#}"):
            block = False
    at = [i for i, line in enumerate(lines) if not comment[i] and "function" in line and _MATLAB.match(line)]
    for k, i in enumerate(at):
        m = _MATLAB.match(lines[i])
        last = i
        while lines[last].split("%")[0].rstrip().endswith("...") and last + 1 < len(lines):
            last += 1
        a, b = i, last + 1
        while a and comment[a - 1]:
            a -= 1
        while b < len(lines) and comment[b]:
            b += 1
        name, parameters = m["n"].rpartition(".")[2], m["p"] or ""
        docs = ["\n".join(part) for part in (lines[last + 1 : b], lines[a:i]) if part]
        doc = next((d for d in docs if not trivial(d, name, parameters)), docs[0] if docs else None)
        if doc is None and not undocumented:
            continue
        stop = at[k + 1] if k + 1 < len(at) else len(lines)
        yield i + 1, name, name, lines[i].strip(), parameters, doc, "\n".join(lines[i:stop]).rstrip() if bodies else None, "definition"


def functions_of(source: str, language: str, bodies: bool = True, undocumented: bool = False) -> Iterator[Symbol]:
    """The functions of one file."""
    if language == "python":
        return python_functions(source, bodies, undocumented)
    if language == "matlab":
        return matlab_functions(source, bodies, undocumented)
    return brace_functions(source, language, bodies, undocumented)


def language_of(language: Column, path: Column) -> Column:
    """The language of a row, by its label or else the suffix of its path."""
    suffix = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    named = F.lower(F.trim(language))
    by_suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.when(named.isin(*LANGUAGES), named).otherwise(F.try_element_at(by_suffix, suffix))


_SCHEMA = StructType(
    [
        StructField("module_id", StringType()),
        StructField("scope", StringType()),
        StructField("language", StringType()),
        StructField("lineno", IntegerType()),
        *(StructField(n, StringType()) for n in ("name", "qualname", "signature", "key", "kind")),
        StructField("documented", BooleanType()),
        *(StructField(n, StringType()) for n in ("docstring", "source")),
    ]
)


def symbols(modules: DataFrame, bodies: bool = True) -> DataFrame:
    """The functions of ``modules`` (module_id, project, language, relpath, source) as one symbol table.

    A key is the qualified name with the normalised signature. Functions without documentation are listed in the languages
    where it may stand at a separate declaration, and declarations only with theirs. ``bodies``: also signatures, documentation and
    source texts, which are null otherwise. Null and empty sources, unknown languages and files that do not parse have no functions.
    """
    files = modules.select("module_id", F.col("project").alias("scope"), language_of(F.col("language"), F.col("relpath")).alias("language"), "source").where("source <> '' and language is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for pdf in batches:
            rows = []
            for module, scope, language, source in zip(pdf["module_id"], pdf["scope"], pdf["language"], pdf["source"]):
                bare = language in DECLARING
                for lineno, name, qualname, signature, parameters, doc, body, kind in functions_of(source, language, bodies, bare):
                    empty = trivial(doc, name, parameters)
                    if empty and not (bare and kind == "definition"):
                        continue
                    key = f"{qualname.replace('::', '.')}({normalised(parameters, language)})"
                    rows.append((module, scope, language, lineno, name, qualname, signature if bodies else None, key, kind, not empty, plain(doc) if bodies and not empty else None, body))
            yield pd.DataFrame(rows, columns=_SCHEMA.names)

    return files.mapInPandas(run, _SCHEMA)


def pairs(modules: DataFrame, bodies: bool = True) -> DataFrame:
    """``(module_id, lineno, name, qualname, signature, docstring, source, documented_at)`` of the documented functions.

    ``documented_at`` is definition, or declaration if the documentation stands at a separate declaration of the
    same project, qualified name and normalised signature; only rows of languages that have such meet in the join. Functions whose documentation is missing or trivial at
    both places are left out. Repeated files give one result per function. Without ``bodies`` the three texts are null.
    """
    found = cut_lineage(symbols(modules, bodies=bodies))
    at = ["scope", "language", "key"]
    apart = F.col("language").isin(*DECLARING)
    declared = found.where(apart & F.expr("kind = 'declaration' and scope is not null")).groupBy(*at).agg(F.min(F.coalesce("docstring", F.lit(""))).alias("__doc"))
    defined = found.where("kind = 'definition'")
    joined = salted_join(defined.where(apart), declared, at, "left")
    out = joined.unionByName(defined.where(~apart).withColumn("__doc", F.lit(None).cast("string")))
    place = F.when(F.col("documented"), "definition").when(F.col("__doc").isNotNull(), "declaration")
    out = out.select("module_id", "lineno", "name", "qualname", "signature", F.when(F.col("documented"), F.col("docstring")).otherwise(F.col("__doc")).alias("docstring"), "source", place.alias("documented_at"))
    return out.where("documented_at is not null").dropDuplicates(["module_id", "lineno", "name"])


def _modules(spark, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "modules").select("module_id", "project", "language", "relpath", "source"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Functions and methods with documentation of their own that is not trivial; of those documented at a declaration elsewhere, none."""
    return pairs(_modules(spark, sf_dir), bodies=False).where("documented_at = 'definition'").select("module_id", "lineno", "name")


def p4_pairs(spark, sf_dir: str) -> DataFrame:
    """All code-description pairs, those documented at a separate declaration included."""
    return pairs(_modules(spark, sf_dir))
