"""Cutting texts into blocks and packing them into chunks under a token budget.

Blocks and packing are folds whose state resets, so they run per row in Arrow batches: linear in
the text and without a shuffle. Token counts default to words; any tokenizer can be plugged in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

Counter = Callable[[str], int]


def count_words(text: str) -> int:
    """The default token count."""
    return len(text.split())


def blocks_of(text: str | None) -> list[str]:
    """Paragraphs, headings and fenced blocks of a Markdown text, stripped; an unclosed fence runs to the end."""
    out: list[str] = []
    held: list[str] = []
    fenced = False

    def close() -> None:
        if held:
            out.append("\n".join(held).strip())
            held.clear()

    for line in (text or "").splitlines():
        if line.startswith("```"):
            if not fenced:
                close()
            held.append(line)
            if fenced:
                close()
            fenced = not fenced
        elif fenced:
            held.append(line)
        elif not line.strip():
            close()
        elif line.lstrip().startswith("#"):
            close()
            out.append(line.strip())
        else:
            held.append(line)
    close()
    return [b for b in out if b]


def slices_of(block: str, tokens: int, budget: int) -> list[str]:
    """A block above the budget in slices of as many characters as the budget's tokens have on average."""
    if tokens <= budget:
        return [block]
    step = max(budget * max(len(block) // tokens, 1), 1)
    return [block[i : i + step] for i in range(0, len(block), step)]


def pack(blocks: Iterable[str], budget: int, count: Counter = count_words, separator: int = 0, separator_chars: int = 0, max_chars: int | None = None, oversize: Callable[[str], list[str]] | None = None, flush_first: bool = True) -> list[str]:
    """Greedy packing in order: a chunk is closed as soon as the next block would exceed ``budget`` or ``max_chars``.

    A block that is too large by itself is handed to ``oversize`` (default: ``slices_of``). ``flush_first``: the open
    chunk is closed before such a block; otherwise it is closed only if the budget asks for it.
    """
    out: list[str] = []
    held: list[str] = []
    used = chars = 0
    for block in blocks:
        n, c = count(block), len(block)
        large = n > budget or (max_chars is not None and c > max_chars)
        more, wide = n + (separator if held else 0), c + (separator_chars if held else 0)
        if held and ((large and flush_first) or used + more > budget or (max_chars is not None and chars + wide > max_chars)):
            out.append("\n\n".join(held))
            held, used, chars, more, wide = [], 0, 0, n, c
        if large:
            out += oversize(block) if oversize else slices_of(block, n, budget)
            continue
        held.append(block)
        used, chars = used + more, chars + wide
    if held:
        out.append("\n\n".join(held))
    return out


def chunks_of(text: str | None, budget: int, count: Counter = count_words) -> list[str]:
    """Chunks of a Markdown text; separators cost nothing."""
    return pack(blocks_of(text), budget, count, flush_first=False)


def limited_chunks_of(text: str | None, budget: int = 2000, max_chars: int = 6000, count: Counter = count_words) -> list[str]:
    """Chunks of paragraphs under a limit of tokens and of characters; a separator costs a token and two characters."""
    paragraphs = [p.strip() for p in re.split(r"\n{2,}", (text or "").strip()) if p.strip()]
    return pack(paragraphs, budget, count, separator=max(count("\n\n"), 1), separator_chars=2, max_chars=max_chars, oversize=lambda p: [c.strip() for c in chunks_of(p, budget, count)])


def structural_chunks_of(parts: list[str], budget: int, count: Counter = count_words) -> list[str]:
    """Chunks of the parts of a module, which are kept whole where they fit; separators count."""
    return pack(parts, budget, count, separator=count("\n\n"), oversize=lambda p: chunks_of(p, budget, count))


def groups_of(items: list[str], budget: int, count: Counter = count_words) -> list[list[str]]:
    """Items in order, grouped so that their bullets stay within the budget; a group holds one at least."""
    out: list[list[str]] = []
    held: list[str] = []
    used = 0
    for item in items:
        n = count(f"- {item}\n")
        if held and used + n > budget:
            out.append(held)
            held, used = [], 0
        held.append(item)
        used += n
    return [*out, held] if held else out


def _column(function: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action=None)

    return run


def blocks(text: Column) -> Column:
    """``blocks_of`` as a column; null and blank texts have none."""
    return _column(lambda t: blocks_of(t if isinstance(t, str) else None))(text)


def chunks(text: Column, budget: int, count: Counter = count_words) -> Column:
    """``chunks_of`` as a column."""
    return _column(lambda t: chunks_of(t if isinstance(t, str) else None, budget, count))(text)


def limited_chunks(text: Column, budget: int = 2000, max_chars: int = 6000, count: Counter = count_words) -> Column:
    """``limited_chunks_of`` as a column."""
    return _column(lambda t: limited_chunks_of(t if isinstance(t, str) else None, budget, max_chars, count))(text)


def fixed_slices(text: Column, budget: int) -> Column:
    """``slices_of`` of whole texts by word counts, as built-in expressions; null and empty texts have none."""
    from scriptoria.functions.text import word_count

    n, size = word_count(text), F.length(text)
    step = F.when(n <= budget, size).otherwise(F.greatest(budget * F.greatest(F.floor(size / n), F.lit(1)), F.lit(1))).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1, step), lambda i: F.substring(text, i + 1, step))).otherwise(F.array().cast("array<string>"))
