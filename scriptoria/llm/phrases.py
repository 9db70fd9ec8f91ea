"""A naive Bayes classifier of short texts over words, pairs of words and shape, and the literals that a pattern needs.

The classifier is trained here from lines with a kind: a few given ones of each, and lines of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from math import log
from re import _parser as grammar  # the parse tree of patterns

#: Counts that every feature has before any, and log odds of words and pairs that were never seen.
SMOOTH, UNSEEN_WORD, UNSEEN_PAIR = 0.05, -3.0, -1.0
_PART = re.compile(r"<[a-z]+>|<\*>|[぀-ヿ㐀-鿿]|[^\W_]+(?:['’][^\W_]+)*|[?!:{}\[\]]")


def features(text: str) -> list[str]:
    """Words, pairs of neighbouring words with the edges, and the shape of a text; wildcards tell nothing, nor do pairs with one."""
    words = _PART.findall(text.lower())
    pairs = [f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"]) if "<*>" not in (a, b)]
    shape = [] if text.endswith("<*>") else [f"#end {'a' if text[-1:].isalnum() else text[-1:]}"]
    return [*(w for w in words if w != "<*>"), *pairs, f"#size {min(len(words), 15) // 3}", *shape]


class Classifier:
    """Log probabilities of features by kind; ``None`` is the kind of sound texts."""

    def __init__(self, lines: Iterable[tuple[str, str | None]]) -> None:
        counts: dict[str | None, Counter] = {}
        for text, kind in lines:
            counts.setdefault(kind, Counter()).update(features(text))
        vocabulary = {f for c in counts.values() for f in c}
        self.kinds = sorted(k for k in counts if k is not None)
        totals = {k: c.total() + SMOOTH * len(vocabulary) for k, c in counts.items()}
        sound = counts.get(None, Counter())
        self.odds = {f: [log((counts[k][f] + SMOOTH) / totals[k]) - log((sound[f] + SMOOTH) / totals.get(None, 1.0)) for k in self.kinds] for f in vocabulary}

    def best(self, text: str) -> tuple[str | None, float]:
        """The likeliest kind other than sound, and its log odds against sound.

        Residue says much the same everywhere, so words and pairs never seen speak for sound text. A text of one word tells nothing.
        """
        mine = features(text)
        found = [self.odds[f] for f in mine if f in self.odds]
        if not found or not self.kinds or sum(f[0].isalnum() and " " not in f for f in mine) < 2:
            return None, 0.0
        new = sum(UNSEEN_PAIR if " " in f else UNSEEN_WORD for f in mine if f not in self.odds and f[0] != "#")
        sums = [sum(x) for x in zip(*found)]
        k = max(range(len(sums)), key=sums.__getitem__)
        return self.kinds[k], sums[k] + new


def literals(pattern: str) -> set[str] | None:
    """Texts in lower case of which every match of ``pattern`` holds one; None if none can be told."""

    def of(tree) -> set[str] | None:
        best: set[str] | None = None
        run = ""

        def offer(found: set[str] | None) -> None:
            nonlocal best
            if found and (best is None or min(map(len, found)) > min(map(len, best))):
                best = found

        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                run += chr(value).lower()
                continue
            if run:
                offer({run})
                run = ""
            if name == "SUBPATTERN":
                offer(of(value[-1]))
            elif name == "BRANCH":
                each = [of(x) for x in value[1]]
                offer(set().union(*each) if all(each) else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                offer(of(value[2]))
        if run:
            offer({run})
        return best

    return of(grammar.parse(pattern))


def alternatives(pattern: str) -> list[str]:
    """The parts of ``pattern`` between its outermost bars."""
    parts, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


class Patterns:
    """Patterns by kind, of which only those are tried on a text whose literals it holds."""

    def __init__(self, kinds: dict[str, list[str]]) -> None:
        self.patterns = [(kind, re.compile(p)) for kind, patterns in kinds.items() for p in patterns]
        needs: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, (_, p) in enumerate(self.patterns):
            found = literals(p.pattern)
            if found and min(map(len, found)) > 1:
                for text in found:
                    needs.setdefault(text, []).append(i)
            else:
                self.always.append(i)
        self.needs = needs
        try:
            import ahocorasick
        except ImportError:  # then every literal is looked for
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for text, which in needs.items():
            self.automaton.add_word(text, which)
        if needs:
            self.automaton.make_automaton()

    def first(self, text: str) -> str | None:
        """The kind of the first pattern found in ``text``, which is in lower case."""
        may = set(self.always)
        if self.automaton is None:
            may.update(i for literal, which in self.needs.items() if literal in text for i in which)
        elif self.needs:
            for _, which in self.automaton.iter(text):
                may.update(which)
        return next((self.patterns[i][0] for i in sorted(may) if self.patterns[i][1].search(text)), None)
