"""Problem 2: tell hand-written source files from generated, minified, vendored ones and from data.

A file is judged first by the statistics of its layout against thresholds of its language: line lengths, white-space share,
alphanumeric share, density of numeric literals and of digits, long encoded runs, and lines that repeat once numbers are gone. What they leave is judged by
what the comment at its head and its folder say. Shares are shrunk towards those of ordinary code, so that small files need
clearer evidence and no size is left out. All of it is built-in expressions over the lines of a file; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.runtime import table, widen


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language; shares are of a file's characters, tokens or lines."""

    digits: float = 0.055  # of the characters outside the longest line, at least: tables, generated code
    literals: float = 0.3  # numeric literals of all words and literals, at least: tables
    alike: float = 0.4  # of the lines that differ once numbers are masked, at most: generated code
    blank: float = 0.105  # of white space, at most: minified code
    sparse: float = 0.6  # of alphanumeric characters, those of words and numbers, among what is not blank, at most: data in brackets and quotes
    dense: float = 0.95  # of the same, at least, with few blanks: encoded data
    long_line: int = 600  # code line of a minified file or of data, at least
    mean_line: float = 110.0  # characters a line, at least: minified code


#: Thresholds by language; a null or unknown language takes those of "". Indented languages have more white space, and numeric ones more literals.
LAYOUTS = {
    "": Layout(),
    "python": Layout(blank=0.12, literals=0.35),
    "java": Layout(blank=0.11, literals=0.25),
    "cpp": Layout(literals=0.25, sparse=0.62),
    "javascript": Layout(literals=0.27, long_line=500),
    "typescript": Layout(literals=0.25, sparse=0.62, long_line=500),
    "matlab": Layout(digits=0.065, literals=0.3, blank=0.09, sparse=0.65, dense=0.97),
}
#: Characters, tokens and lines of ordinary code that every share is shrunk by, and its shares of white space, letters and digits, and digits.
CHARS, TOKENS, LINES, BLANKS, LETTERS, DIGITS = 100, 10, 1, 25, 80, 2

# What the head of a file says about its origin, one line at a time, in lower case.
GENERATED = (
    r"@generated\b|<auto-?generated\b|^\W*auto-?generated\b|^\W*(?:this (?:file|code|module|source) (?:was|is|has been) |(?:file|code) )?(?:auto(?:matically)?[- ])?(?:generated|produced|created|written|emitted)"
    r" (?:automatically )?(?:by|with|from|using) \S.*(?:do not (?:edit|modify|change)|will be (?:lost|overwritten)|don't edit)|^\W*machine-(?:written|generated)\b|automatisch (?:erzeugt|generiert)|nicht von hand|"
    r"généré automatiquement|generado autom[aá]ticamente|сгенерировано|自动生成|自動生成|^\W*(?:do not edit|do not modify)\b.*\bgenerated\b|^\W*this file (?:was|is) (?:produced|generated) by \S+"
)
KEPT_BY_HAND = r"\b(?:maintained|kept|edited|written|changed) by hand\b|\bonce generated\b|\b(?:originally|formerly|initially|no longer) generated\b|\boutput must\b|\bchecks? for\b|\btests? (?:for|of) the\b"
VENDORED = (
    r"@license \S+|\(c\) (?:\d{4}(?:-\d{4})?,? )?.*\b(?:contributors|authors)\b|copyright (?:\(c\) )?\d{4}(?:-\d{4})?,? (?:by )?(?:the )?\S+ (?:authors|contributors|developers|project)\b|^\W*upstream: \S+|\bbundled copy of\b|"
    r"\b(?:copied|taken|vendored|imported) (?:verbatim |unchanged |as is )?from \S+ v?\d|\bcopied verbatim\b|\blocal copy, do not patch\b|^\s*/\*!\s*[\w.@/-]+ v?\d+\.\d+|^\W*[\w.-]+ - version \d|\bdo not (?:patch|change) here\b|\bvendored\b"
)
OWN = r"\bpart of this project\b"
FOLDER = r"(?:^|/)(?:node_modules|bower_components|vendor|vendored|_vendor|third[_-]?party|deps|external|contrib)/[^/]+/"
MINIFIED_NAME = r"\.(?:min|bundle)\.[a-z]+$"
#: The start of the first line that is neither blank nor a comment.
CODE = r"(?m)^(?![ \t]*(?:$|//|#(?!include|define|if|ifdef|ifndef|pragma)|%|/?\*|--|;|<!--))"
#: Characters of a run without blanks or marks that encodes data, at least, and the share of a file that such runs hold.
RUN, ENCODED = 60, 0.2


def layout(files: DataFrame, source: str = "__s") -> DataFrame:
    """``files`` with the layout statistics of ``source``; it runs in steps so that no expression is evaluated twice.

    Only plain replacements and counts touch every character; what needs the content of the longest line is evaluated for the
    few files whose lines are long or that hold many digits.
    """
    t, lines, masked, head = F.col("__t"), F.col("__lines"), F.col("__masked"), F.col("__head")
    step = files.withColumn("__t", F.replace(F.col(source), F.lit("\r"), F.lit(""))).drop(source)
    step = step.withColumns({"__lines": F.split(t, "\n"), "__masked": F.regexp_replace(t, "[0-9]+", ""), "__head": F.regexp_instr(t, F.lit(CODE))})
    step = step.withColumns(
        {
            "chars": F.length(t),
            "lines": F.size(lines),
            "max_line": F.array_max(F.transform(lines, F.length)),
            "digits": F.length(t) - F.length(masked),
            "__bare": F.regexp_replace(t, "[A-Za-z_][0-9A-Za-z_.]*", "\u0001"),
            "blanks": F.length(t) - F.length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))) + F.size(lines) - 1,
            "__filled": F.filter(F.split(masked, "\n"), lambda x: x != ""),
            "head": F.split(F.lower(F.when(head > 0, F.substring(t, F.lit(1), head - 1)).otherwise(t)), "\n"),
        }
    )
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    # words leave a mark each, then numbers outside of words
    step = step.withColumns({"words": count("__bare", "\u0001"), "__signs": F.regexp_replace("__bare", "[0-9][0-9.]*", "\u0002"), "__wide": F.array_join(F.filter(lines, lambda x: F.length(x) >= RUN), "\n")})
    step = step.withColumns({"literals": count("__signs", "\u0002")}).withColumn("letters", F.length(t) - F.length("__signs") + F.col("words") + F.col("literals"))
    longest = F.element_at(F.filter(lines, lambda x: F.length(x) == F.col("max_line")), 1)
    step = step.withColumns(
        {
            "filled": F.size("__filled"),
            "kinds": F.size(F.array_distinct("__filled")),
            "longest": F.when((F.col("max_line") >= 180) | (F.col("digits") >= 0.03 * F.col("chars")), longest),
            "encoded": F.when(F.col("max_line") >= RUN, F.aggregate(F.regexp_extract_all("__wide", F.lit(f"[A-Za-z0-9+/=]{{{RUN},}}"), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))).otherwise(0),
        }
    )
    return step.drop("__t", "__lines", "__masked", "__head", "__filled", "__bare", "__signs", "__wide")


def _threshold(language: Column, name: str) -> Column:
    """The threshold of the row's language."""
    out = None
    for key, values in LAYOUTS.items():
        if key:
            out = (F.when if out is None else out.when)(language == key, getattr(values, name))
    return out.otherwise(getattr(LAYOUTS[""], name))


def classify(modules: DataFrame, id_col: str = "module_id", source_col: str = "source", language_col: str = "language", path_col: str = "relpath") -> DataFrame:
    """``(id, kind, max_line, mean_line, blank_share, letter_share, literal_share, digit_share)`` of every file with a source.

    ``kind``: vendored, generated, minified, data or handwritten. Null, empty and blank sources give no row; null
    languages take the default thresholds, null paths say nothing. Repeated rows give repeated results.
    """
    base = modules.select(F.col(id_col), F.col(source_col).alias("__s"), F.lower(language_col).alias("__l"), F.col(path_col).alias("__p")).where("trim(translate(__s, '\\r\\n\\t', '   ')) <> ''")
    m = layout(base)
    at = lambda name: _threshold(F.col("__l"), name)
    in_longest = F.coalesce(F.length("longest") - F.length(F.regexp_replace("longest", "[0-9]+", "")), F.lit(0))
    beside = F.when(F.col("longest").isNull(), F.col("chars")).otherwise(F.col("chars") - F.col("max_line"))
    m = m.withColumns(
        {
            "mean_line": F.col("chars") / F.col("lines"),
            "blank_share": (F.col("blanks") + BLANKS) / (F.col("chars") + CHARS),
            "letter_share": (F.col("letters") + LETTERS) / (F.col("chars") - F.col("blanks") + CHARS),
            "literal_share": F.col("literals") / (F.col("literals") + F.col("words") + TOKENS),
            "digit_share": (F.col("digits") - in_longest + DIGITS) / (beside + CHARS),
            "all_digits": (F.col("digits") + DIGITS) / (F.col("chars") + CHARS),
            "alike": (F.col("kinds") + LINES) / (F.col("filled") + LINES),
        }
    )
    says = lambda what, unless: F.exists("head", lambda x: x.rlike(what) & ~x.rlike(unless))
    code_line = (F.col("max_line") >= at("long_line")) & ~F.col("longest").rlike(r"^\s*(?://|#|%|/?\*)")
    data = (F.col("encoded") >= ENCODED * F.col("chars")) & (F.col("encoded") > 0) | (F.col("letter_share") >= at("dense")) & (F.col("blank_share") < 0.14)
    table_like = (F.col("literal_share") >= at("literals")) | (F.col("digit_share") >= at("digits")) | (F.greatest("digit_share", "all_digits") >= 0.2) | (F.col("letter_share") <= at("sparse"))
    minified = (F.col("blank_share") <= at("blank")) & (F.col("mean_line") >= 40) | code_line | (F.col("mean_line") >= at("mean_line")) & (F.col("blank_share") < 0.14)
    kind = (
        F.when(data, "data")
        .when(minified & (F.col("all_digits") < 0.12), "minified")
        .when(minified, "data")
        .when(F.col("alike") <= at("alike"), "generated")
        .when(table_like, "data")
        .when(says(VENDORED, OWN), "vendored")
        .when(says(GENERATED, KEPT_BY_HAND), "generated")
        .when(F.col("__p").rlike(FOLDER), "vendored")
        .when(F.col("__p").rlike(MINIFIED_NAME) & (F.col("blank_share") < 0.15), "minified")
        .otherwise("handwritten")
    )
    return m.select(id_col, kind.alias("kind"), "max_line", "mean_line", "blank_share", "letter_share", "literal_share", "digit_share")


def _judged(spark, sf_dir: str) -> DataFrame:
    return classify(widen(table(spark, sf_dir, "modules").select("module_id", "source", "language", "relpath")))


def p2_kinds(spark, sf_dir: str) -> DataFrame:
    """Every module with a source and its kind, once."""
    return _judged(spark, sf_dir).groupBy("module_id").agg(F.min("kind").alias("kind"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Ids of the modules whose source is generated, minified, vendored or data.

    The filter stands above the aggregate: below it, it would be pushed through the steps of ``layout`` and
    repeat their work for each of its terms.
    """
    other = F.max((F.col("kind") != "handwritten").cast("int"))
    return _judged(spark, sf_dir).groupBy("module_id").agg(other.alias("other")).where("other = 1").select("module_id")


def p2_handwritten(spark, sf_dir: str) -> DataFrame:
    """Ids of the modules that remain as hand-written source."""
    return p2_kinds(spark, sf_dir).where("kind = 'handwritten'").select("module_id")


def sql(select: str) -> str:
    """The classification in SQL, for comparison; ``select`` reads the table ``judged`` (module_id, kind). The thresholds stand here once more."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def says(what: str, unless: str) -> str:
        return f"len(list_filter(head, lambda x: regexp_matches(x, {quoted(what)}) AND NOT regexp_matches(x, {quoted(unless)}))) > 0"

    comment = "(regexp_matches(x, '^[ \\t]*($|//|%|/?\\*|--|;|<!--)') OR (regexp_matches(x, '^[ \\t]*#') AND NOT regexp_matches(x, '^[ \\t]*#(include|define|if|ifdef|ifndef|pragma)')))"
    return f"""WITH h (l, digits_at, literals_at, blank_at, sparse_at, dense_at, long_at) AS (VALUES ('python', 0.055, 0.35, 0.12, 0.6, 0.95, 600), ('java', 0.055, 0.25, 0.11, 0.6, 0.95, 600), ('cpp', 0.055, 0.25, 0.105, 0.62, 0.95, 600),
  ('javascript', 0.055, 0.27, 0.105, 0.6, 0.95, 500), ('typescript', 0.055, 0.25, 0.105, 0.62, 0.95, 500), ('matlab', 0.065, 0.3, 0.09, 0.65, 0.97, 600)),
a AS (SELECT module_id, lower(language) AS l, relpath AS p, replace(source, chr(13), '') AS t FROM modules WHERE regexp_matches(source, '[^ \\r\\n\\t]')),
b AS (SELECT *, string_split(t, chr(10)) AS lines, regexp_replace(t, '[0-9]+', '', 'g') AS masked FROM a),
c AS (SELECT *, list_filter(string_split(masked, chr(10)), lambda x: x <> '') AS filled, list_max(list_transform(lines, lambda x: length(x))) AS max_line,
  length(t) - length(replace(replace(t, ' ', ''), chr(9), '')) + len(lines) - 1 AS blanks, length(t) AS chars, length(t) - length(masked) AS digits,
  regexp_replace(t, '[A-Za-z_][0-9A-Za-z_.]*', chr(1), 'g') AS bare, list_sum(list_transform(regexp_extract_all(t, '[A-Za-z0-9+/=]{{60,}}'), lambda x: length(x))) AS encoded, coalesce(list_position(list_transform(lines, lambda x: NOT {comment}), true), 0) AS code FROM b),
d AS (SELECT *, list_transform(CASE WHEN code > 0 THEN lines[1:code-1] ELSE lines END, lambda x: lower(x)) AS head, CASE WHEN max_line >= 180 OR digits >= 0.03 * chars THEN list_filter(lines, lambda x: length(x) = max_line)[1] END AS longest,
  length(bare) - length(replace(bare, chr(1), '')) AS words, regexp_replace(bare, '[0-9][0-9.]*', chr(2), 'g') AS signs FROM c),
n AS (SELECT *, length(signs) - length(replace(signs, chr(2), '')) AS literals, length(t) - length(signs) + words + length(signs) - length(replace(signs, chr(2), '')) AS letters FROM d),
e AS (SELECT *, chars / len(lines) AS mean_line, (blanks + 25) / (chars + 100) AS blank_share, (letters + 80) / (chars - blanks + 100) AS letter_share, literals / (literals + words + 10) AS literal_share, (digits + 2) / (chars + 100) AS all_digits,
  (len(list_distinct(filled)) + 1) / (len(filled) + 1) AS alike,
  (digits - coalesce(length(longest) - length(regexp_replace(longest, '[0-9]+', '', 'g')), 0) + 2) / (CASE WHEN longest IS NULL THEN chars ELSE chars - max_line END + 100) AS digit_share FROM n),
g AS (SELECT e.*, coalesce(digits_at, 0.055) AS digits_at, coalesce(literals_at, 0.3) AS literals_at, coalesce(blank_at, 0.105) AS blank_at, coalesce(sparse_at, 0.6) AS sparse_at, coalesce(dense_at, 0.95) AS dense_at, coalesce(long_at, 600) AS long_at FROM e LEFT JOIN h USING (l)),
f AS (SELECT *, (blank_share <= blank_at AND mean_line >= 40) OR (max_line >= long_at AND NOT coalesce(regexp_matches(longest, '^\\s*(//|#|%|/?\\*)'), false)) OR (mean_line >= 110 AND blank_share < 0.14) AS minified FROM g),
judged AS (SELECT module_id, CASE WHEN coalesce(encoded, 0) > 0 AND encoded >= 0.2 * chars OR (letter_share >= dense_at AND blank_share < 0.14) THEN 'data' WHEN minified AND all_digits < 0.12 THEN 'minified' WHEN minified THEN 'data' WHEN alike <= 0.4 THEN 'generated'
  WHEN literal_share >= literals_at OR digit_share >= digits_at OR greatest(digit_share, all_digits) >= 0.2 OR letter_share <= sparse_at THEN 'data'
  WHEN {says(VENDORED, OWN)} THEN 'vendored' WHEN {says(GENERATED, KEPT_BY_HAND)} THEN 'generated' WHEN coalesce(regexp_matches(p, {quoted(FOLDER)}), false) THEN 'vendored'
  WHEN coalesce(regexp_matches(p, {quoted(MINIFIED_NAME)}), false) AND blank_share < 0.15 THEN 'minified' ELSE 'handwritten' END AS kind FROM f)
{select}"""
