"""Scalar text functions as built-in column expressions.

Python's notion of white space and line ends is spelled out as explicit classes, since ``\\s`` and ``trim``
differ between engines. Unless stated otherwise null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` and ``str.strip`` see it.
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Line ends as ``str.splitlines`` sees them.
LINE_END = r"\x0d\x0a|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FIM = r"<\|fim_(?:prefix|middle|suffix)\|>"


def strip(c: Column) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, an empty text has no lines."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, rf"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.size(split_words(c)), F.lit(0))


def strip_fim(c: Column) -> Column:
    """Without fill-in-the-middle markers; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), FIM, "")


def content_key(prefix: Column | str, content: Column) -> Column:
    """``prefix:sha256``; a null content has the key ``prefix:null``, which no text has."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat_ws(":", head, F.coalesce(F.sha2(content, 256), F.lit("null")))


def placeholders(c: Column) -> Column:
    """Distinct ``[[...]]`` tokens in order of first occurrence; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[[^\[\]]+\]\]"), F.lit(0)))


def slug(c: Column, separator: str = "_", default: str = "user_manual") -> Column:
    """Lower case with runs of other characters than ASCII letters and digits replaced; ``default`` if nothing remains."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", separator)
    s = F.regexp_replace(s, f"^{separator}+|{separator}+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def unicode_slug(c: Column, default: str = "simulink-model") -> Column:
    """Like ``slug`` with dashes, keeping letters and digits of all scripts."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def escape_html(c: Column) -> Column:
    """With ``& < > " '`` escaped."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def paragraphs_html(c: Column) -> Column:
    """Escaped text as ``<p>`` paragraphs, single line breaks as ``<br/>``; empty for null."""
    parts = F.filter(F.transform(F.split(escape_html(F.coalesce(c, F.lit(""))), "\n\n"), strip), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))), "\n")


def tag_bodies(html: Column, tag: str) -> Column:
    """Inner texts of ``tag`` by the lenient pattern: an opening tag is anything that begins with its name."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


def without_tags(c: Column) -> Column:
    """Without anything between angle brackets."""
    return F.regexp_replace(c, "<[^>]+>", "")


def line_of(text: Column, phrase: Column) -> Column:
    """1-based number of the first line that contains ``phrase``, letter case aside, else -1."""
    wanted = F.lower(phrase)
    at = F.array_position(F.transform(split_lines(text), lambda x: F.contains(F.lower(x), wanted)), F.lit(True))
    return F.when(at > 0, at).otherwise(F.lit(-1)).cast("int")


def path_tokens(c: Column) -> Column:
    """Tokens that look like paths: with a slash, or ending in ``.py``."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_/.-]+"), F.lit(0)), lambda t: F.contains(t, F.lit("/")) | F.endswith(t, F.lit(".py")))


def cli_lines(c: Column) -> Column:
    """Lines that build a command line interface."""
    return F.filter(split_lines(F.coalesce(c, F.lit(""))), lambda x: F.contains(x, F.lit("ArgumentParser")) | F.contains(x, F.lit("add_argument")))


def main_block(c: Column) -> Column:
    """The text from the main guard to the end; empty without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)if __name__ == ['\"]__main__['\"]:.*", 0)


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, else empty."""
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def is_under(path: Column, parent: Column) -> Column:
    """Whether ``path`` is ``parent`` or lies inside it, part by part."""
    return (path == parent) | F.startswith(path, F.concat(parent, F.lit("/")))


def percent(current: Column, total: Column) -> Column:
    """Whole percents; a total of nothing is complete."""
    return F.when(total <= 0, F.lit(100)).otherwise(F.floor(current * 100 / F.greatest(total, F.lit(1)))).cast("int")
