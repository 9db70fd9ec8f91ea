"""Problem 8: sentence units of texts in any script.

A text is first cut into units that layout alone decides: fenced code, headings, list items,
paragraphs. Inside a unit a hidden-event n-gram model places boundary tokens between words. It holds how likely a boundary follows
the word and mark on the left, backed off to the class of that word, and how likely a word follows a boundary
or none. A point may belong to a boundary or to its word: each word type is an abbreviation with a probability that rests on
how often it stands without a point, on what follows it, and, before any count, on its shape. Forward and
backward probabilities over the gaps of a unit give each gap's posterior, which decides it. Gaps without an end mark hold a
boundary in Thai and Lao, at blanks, and in units of Chinese characters or kana without any mark, where the counts of the
characters before and after marks elsewhere decide.

The model is trained here on all documents without labels: units start with a sentence for certain, words away
from marks follow none, and the gaps are counted by their posteriors, in rounds. Gaps influence each other only where they
lie close together, so one pass over the texts counts words and runs of close gaps, and the rounds go over these counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scriptoria.runtime import cut_lineage, table, widen

#: Rounds of training, and most words on either side that the model remembers: those seen at gaps first, then the most frequent.
ROUNDS, WORDS = 3, 60_000
#: Weights, in counts, of the rate of a class before its own counts, and of a class in the rate of its words.
CLASS_WEIGHT, WORD_WEIGHT = 50.0, 4.0
#: Before any count: the rate of boundaries after words, and of words that are abbreviations without their point.
RATE, POINTLESS = 0.07, 0.02
#: Log odds against further boundaries in a unit without any mark, and the weight of the general rate for the characters before one.
UNMARKED, CHARACTER_WEIGHT = -2.0, 20.0
#: Gaps at most so many characters apart influence each other; parts of one that posteriors are counted in, so that sums do
#: not depend on their order; keys a task counts before it hands them on; longest word that stands for itself.
NEAR, GRAIN, HELD, LONG_WORD = 3, 1 << 20, 200_000, 64

_MARKS = ".!?…。！？｡।॥؟۔។៕။፧።։"
_WIDE = "。！？｡…។៕။፧።։"
_CLOSERS = "\"'”’»›)]}」』）】》〉*_`"
_OPENERS = "\"'“„‚‘«‹([{「『（【《〈*_`¿¡"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}

_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦]|\d{1,9}[.)]|[a-zA-Z][.)])[ \t]+(?=\S)")
_LETTER_ITEM = re.compile(r"[ \t]*[a-zA-Z][.)]")
_NUMBER_ITEM = re.compile(r"[ \t]*(\d{1,9})[.)]")
_RULE = re.compile(r"[ \t]*(?:-{3,}|\*{3,}|_{3,}|={3,})[ \t]*$")
_GAP = re.compile(
    rf"(?P<wide>[{_WIDE}][{_MARKS}]*+[{re.escape(_CLOSERS)}]*+)(?P<ws1>\s*+)(?=\S)|"
    rf"(?<![{_MARKS}])(?P<mark>[{_MARKS}]++(?:[ \u00a0\u202f]?[»›]|[{re.escape(_CLOSERS)}])*+)(?P<ws2>\s++)(?=\S)|"
    r"(?<=[฀-\u0eff])(?P<thai>[ \t]*\r?\n?[ \t]*(?<=\s))(?=[฀-\u0eff])"
)
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿][぀-ヿ㐀-鿿]")
_IDEOGRAPHS = re.compile(r"[぀-ヿ㐀-鿿]{4,}")
_ASCII_RUN = re.compile(r"[!-~]*")
#: What ends the word before a mark, looking back.
_STOPS = frozenset("“”„«»()[]\"「」『』（）。！？｡।॥؟۔")
_RIGHT = re.compile(rf"[{re.escape(_OPENERS)}]*([^\W_]+(?:['’][^\W_]+)?|.)?", re.S)

# Abbreviations that seldom end a sentence, and those that may; they set the odds before any count.
NEVER = frozenset(
    "e.g i.e cf vs v approx fig figs eq no nos vol ch sect pp ed eds dr prof mr mrs ms mx st mt gen col sgt capt rev hon ext tel incl excl resp viz dept univ est ca c.f op cit art al.z "
    "z.b d.h u.a o.ä bzw nr abb tab bd hrsg hr fr str vgl ggf evtl inkl exkl zzgl bspw sog geb s.o s.u i.d.r u.u z.t z b "
    "p.ex c.-à-d c.à.d m mme mlle mm mgr env chap p n n° réf tél av boul "
    "sr sra srta dra d dña ud uds p.ej núm nº pág págs ej tel.e aprox fig.e "
    "т.е т.к т.н рис п пп стр гл г-н г-жа проф акад ул им см ср напр тел табл ст "
    "डॉ श्री पं सं क्र د أ م ص".split()
)
SOMETIMES = frozenset(
    "etc al a.m p.m min mins sec secs hr hrs h s kg km cm mm ml mb gb kb corp ltd inc co plc llc bros jr sr.e ph.d m.d b.a u.s u.k jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun dept. max avg "
    "usw etc. u.s.w bsp std sek mio mrd jh gmbh ag "
    "etc.f cie s.a ee.uu s.l cía "
    "т.д т.п др пр г гг в вв руб коп тыс млн млрд д н э".split()
)
# Words before a number that a point makes an ordinal.
ORDINALS = [[w] for w in "am im der die das dem den des vom zum zur beim bis ab seit jeder jede jedes jeden ein eine einer einem einen dieser diese dieses ihr sein und oder".split()]
#: Rate of boundaries by kind of left context before any count; words with a point: if they are none or an abbreviation.
PRIORS = {"word": 0.9, "abbreviation": 0.1, "never": 0.01, "sometimes": 0.45, "initial": 0.01, "letter": 0.02, "number": 0.55, "ordinal": 0.004, "dots": 0.65, "strong": 0.95, "wide": 0.995, "closed": 0.6, "wide_closed": 0.02, "thai": 0.98}
#: Shares of the kinds of words after a boundary, and after a gap without one by its kind, before any count; other kinds tell nothing.
STARTS = {"upper": 0.8, "lower": 0.003, "digit": 0.025, "code": 0.03, "name": 0.03}
_USUAL = {"upper": 0.1, "lower": 0.75, "digit": 0.1, "code": 0.005, "name": 0.005}
FOLLOWS = {
    "mark": _USUAL,
    "word": _USUAL,
    "abbreviation": {"upper": 0.4, "lower": 0.4, "digit": 0.15, "code": 0.005, "name": 0.03},
    "initial": {"upper": 0.9, "lower": 0.05, "digit": 0.01, "code": 0.005, "name": 0.01},
    "letter": {"upper": 0.3, "lower": 0.5, "digit": 0.1, "code": 0.005, "name": 0.03},
    "number": _USUAL | {"upper": 0.15},
    "ordinal": {"upper": 0.6, "lower": 0.3, "digit": 0.01, "code": 0.005, "name": 0.005},
}
#: Largest log odds by a following word; weight of its kind against its counts.
LEAST, KIND_WEIGHT = 6.0, 2.0


_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèùâêîôûëïœæаеёиоуыэюя]")
_SPELT = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")


@lru_cache(maxsize=100_000)
def _shape(word: str) -> tuple[float, float]:
    """Before any count: the log odds that ``word`` is an abbreviation, and the rate of boundaries after it if it is."""
    low = word.lower()
    if low in NEVER:
        return 4.0, PRIORS["never"]
    if low in SOMETIMES:
        return 4.0, PRIORS["sometimes"]
    if not low.isalpha():
        return -9.0, PRIORS["abbreviation"]
    odds = (-3.0, -3.0, -3.5, -4.0, -5.0, -6.5)[len(low) - 1] if len(low) < 7 else -8.0
    odds += 4.5 * word[0].isupper() - 2.5 * bool(_VOWELS.match(low[-1])) + (len(low) > 3 and not _VOWELS.search(low[-3:]))
    return odds + 3.0 * (not _VOWELS.search(low)), PRIORS["abbreviation"]


def _weight(word: str) -> float:
    """How much the counts of a word tell whether it is an abbreviation: long words seldom are, however seldom they go without a point."""
    return 1.0 if len(word) < 5 or word.lower() in NEVER or word.lower() in SOMETIMES else (0.5, 0.25, 0.1)[min(len(word), 7) - 5]


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, x))))


@dataclass
class Gap:
    """A place where a boundary may lie: text[end:start] is white space."""

    end: int
    start: int
    kind: str
    left: str
    right: str
    follows: str


def units(text: str) -> Iterator[tuple[int, int, bool]]:
    """Spans of the units of ``text``, and whether a unit is one sentence whatever it holds."""
    at, start, fence, n, item = 0, -1, None, len(text), 0
    if text.startswith("﻿"):
        at = 1
    end = at
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        blank = not line.strip()
        if fence is not None:
            end = stop
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                yield start, end, True
                start, fence = -1, None
        elif m := _FENCE.match(line):
            if start >= 0:
                yield start, end, False
            start, end, fence = at, stop, m[1]
        elif blank:
            if start >= 0:
                yield start, end, False
            start = -1
        elif _HEADING.match(line) or _RULE.match(line):
            if start >= 0:
                yield start, end, False
            yield at, stop, True
            start = -1
        else:
            number = _NUMBER_ITEM.match(line)
            # inside a paragraph a number opens an item only if it begins or continues a list: else it was wrapped there
            opens = start < 0 or not (_LETTER_ITEM.match(line) or number and int(number[1]) not in (1, item + 1))
            if _ITEM.match(line) and opens:
                if start >= 0:
                    yield start, end, False
                start, item = at, int(number[1]) if number else 0
            elif start < 0:
                start = at
            end = stop
        at = stop + 1
    if start >= 0:
        yield start, end, fence is not None


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _word_before(text: str, a: int, at: int) -> str:
    """The word of text[a:at] that ends at ``at``."""
    i = at
    while i > a and not text[i - 1].isspace() and text[i - 1] not in _STOPS:
        i -= 1
    return text[i:at]


def _left_kind(text: str, a: int, mark_at: int, mark: str) -> tuple[str, str]:
    """The kind of context before a mark, and what stands for its word in the counts."""
    plain = mark.rstrip(_CLOSERS + " \u00a0\u202f")
    closed = plain != mark and any(c in "\"”’»›」』“" for c in mark)
    if mark[0] in _WIDE and mark[0] != "…":
        return "wide_closed" if closed or len(plain) < len(mark) else "wide", text[max(a, mark_at - 2) : mark_at]
    if mark[0] == "…" or plain.startswith(".."):
        return "dots", ""
    if closed:
        return "closed", ""
    if mark[0] != ".":
        return "strong", ""
    word = _word_before(text, a, mark_at)
    low = word.lower().lstrip("¿¡*_`'")
    if not low:
        return "word", ""
    if len(low) == 1 and low.isalpha():
        # t. d., z. B.: the abbreviation may have been spaced
        i = mark_at - 1
        while i > a and text[i - 1].isspace():
            i -= 1
        before = text[max(a, i - 3) : i]
        if before.endswith(".") and len(before) > 1 and not (word.isupper() and before[-2].isupper()) and before[-2].isalpha() and (len(before) < 3 or before[-3].isspace() or before[-3] in _OPENERS):
            spaced = f"{before[-2]}.{low}".lower()
            if spaced in SOMETIMES or spaced in NEVER:
                return "word", spaced
        if word.isupper():
            return "initial", ""
        return ("word", low) if low in NEVER else ("letter", "")
    if "'" in low or "’" in low:  # l'art.
        word = re.split("['’]", word)[-1]
        low = word.lower()
    if low in NEVER or low in SOMETIMES:
        return "word", low
    if low.replace(",", "").replace(".", "").isdigit():
        i = mark_at - len(word)
        while i > a and text[i - 1].isspace():
            i -= 1
        before = _word_before(text, a, i).lower()
        if low.isdigit() and len(low) < 3 and [before] in ORDINALS:
            return "ordinal", before
        return "number", before if before.isalpha() and len(before) <= LONG_WORD else ""
    if _SPELT.fullmatch(low):
        return "initial" if word.isupper() else "letter", ""
    word = word.lstrip("¿¡*_`'")
    if not word.isalpha() or len(word) > LONG_WORD:
        return "word", ""
    i = mark_at - len(word)
    while i > a and text[i - 1].isspace():
        i -= 1
    # a capital at the start of a sentence is none of the word's own
    return "word", low.lstrip("¿¡*_`'") if i <= a or text[i - 1] in _MARKS else word


_IDENTIFIER = re.compile(r"[^\s_./()]*(?:_\w|\.[A-Za-z]\w|\(|/\w|[a-z][A-Z])")


def _follow_kind(word: str, opener: str, token: str) -> str:
    """The kind of a word, its opening marks and the whole token from the word on considered."""
    if "`" in opener:
        return "code"
    if word[:1].islower() and _IDENTIFIER.match(token):
        return "name"
    if not word:
        return "other"
    c = word[0]
    if c.isdigit():
        return "digit"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        return "lower"
    return "caseless" if c.isalpha() else "other"


def _key(word: str) -> str:
    """What stands for a word in the counts: scripts without blanks by two characters."""
    if word and ("぀" <= word[0] <= "鿿" or "฀" <= word[0] <= "๿"):
        return word[:2]
    return word if len(word) <= LONG_WORD else blake2b(word.encode(), digest_size=16).hexdigest()


def gaps(text: str, a: int, b: int) -> list[Gap]:
    """The gaps of text[a:b] at which a boundary may lie."""
    m = _ITEM.match(text, a, b)
    first = m.end() if m else a
    out, last = [], b
    # a run of marks at the end is followed by nothing, and no place in it need be tried
    while last > first and (text[last - 1] in _MARKS or text[last - 1] in _CLOSERS or text[last - 1].isspace()):
        last -= 1
    for m in _GAP.finditer(text, first, last):
        if m["thai"] is not None:
            if not m["thai"]:
                continue
            kind, left = "thai", text[max(a, m.start() - 2) : m.start()]
            end = m.start()
        else:
            mark = m["wide"] or m["mark"]
            at = m.start("wide") if m["wide"] else m.start("mark")
            end = at + len(mark)
            kind, left = _left_kind(text, first, at, mark)
        r = _RIGHT.match(text, m.end(), b)
        word = r[1] or ""
        follows = _follow_kind(word, text[m.end() : r.start(1)], _ASCII_RUN.match(text, r.start(1), b)[0] if word[:1].islower() else "") if word else "other"
        out.append(Gap(end, m.end(), kind, left, _key(word), follows))
    return out


@dataclass
class EventModel:
    """What the rounds have counted; empty tables leave what holds before any count."""

    #: Counts of words after a boundary and after none, and their totals if there are more words than these.
    after: dict[str, float] = field(default_factory=dict)
    inside: dict[str, float] = field(default_factory=dict)
    totals: tuple[float, float] | None = None
    #: Rates of boundaries by kind of left context and by its word, and shares of the kinds of words that follow where none is.
    kinds: dict[str, float] = field(default_factory=dict)
    lefts: dict[tuple[str, str], float] = field(default_factory=dict)
    follows: dict[tuple[str, str], float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    #: Abbreviations: how likely a word is one, the rate of boundaries if it is, and the shares of what follows its point.
    points: dict[str, tuple[float, float, dict[str, float]]] = field(default_factory=dict)
    #: Rates of ends after two characters of a script without blanks, marks aside.
    ends: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.totals = self.totals or (sum(self.after.values()), sum(self.inside.values()))
        self.total_after, self.total_inside = self.totals[0] + 1.0, self.totals[1] + 1.0
        self.rate = (self.total_after + 100 * RATE) / (self.total_after + self.total_inside + 100)
        self.kinds = PRIORS | self.kinds
        self.starts = STARTS | self.starts
        self.memory: dict[tuple, tuple[float, float]] = {}
        self.follows = {(group, k): x for group, shares in FOLLOWS.items() for k, x in shares.items()} | self.follows

    def evidence(self, word: str, follows: str, group: str, shares: dict[str, float] | None = None) -> float:
        """Log odds that ``word`` follows a boundary and not a gap of ``group`` without one, or one with these ``shares``."""
        a, i = self.after.get(word, 0.0), self.inside.get(word, 0.0)
        if follows == "caseless" and not a + i:
            return -0.5
        odds = 0.0
        if follows in STARTS:
            odds = max(-LEAST, min(LEAST, log(self.starts[follows]) - log(shares[follows] if shares else self.follows[group, follows])))
        if follows in ("lower", "code", "name") or not a + i or len(word) == 1 and follows != "caseless":
            return odds
        # the counts of a word speak for themselves, the more there are; else its kind does
        seen = max(-LEAST, min(LEAST, log((a + 0.5) / self.total_after) - log((i + 0.5) / self.total_inside)))
        return (seen * (a + i) + odds * KIND_WEIGHT) / (a + i + KIND_WEIGHT)

    def belongs(self, word: str, right: str, follows: str) -> float:
        """Log likelihood ratio, for one point after ``word``, that the word is an abbreviation and not an ordinary one that ends a sentence."""
        a, o = _shape(word)[1], self.kinds["word"]
        common = 0.0
        if follows in STARTS:
            n = 0.0 if follows in ("lower", "code", "name") or len(right) == 1 else self.after.get(right, 0.0) + self.inside.get(right, 0.0)
            common = (log(self.follows["abbreviation", follows]) - log(self.follows["word", follows])) * KIND_WEIGHT / (n + KIND_WEIGHT)
        x, y = exp(self.evidence(right, follows, "abbreviation")), exp(self.evidence(right, follows, "word"))
        return common + log((a * x + 1.0 - a) / (self.rate * (o * y + 1.0 - o)))

    def weigh(self, gap: Gap) -> tuple[float, float]:
        """Likelihoods of no boundary and of a boundary at ``gap``, up to a common factor; those met before are remembered."""
        key = (gap.kind, gap.left, gap.right, gap.follows)
        if (known := self.memory.get(key)) is None:
            if len(self.memory) > HELD:
                self.memory.clear()
            known = self.memory[key] = self._weighed(gap)
        return known

    def _weighed(self, gap: Gap) -> tuple[float, float]:
        kind, word = gap.kind, gap.left
        if kind == "word":
            z, a, shares = self.points.get(word) or ((_sigmoid(_shape(word)[0] - log(self.rate)), _shape(word)[1], None) if word else (0.0, 0.0, None))
            o = self.kinds["word"]
            x, y = exp(self.evidence(gap.right, gap.follows, "abbreviation", shares)) if word else 1.0, exp(self.evidence(gap.right, gap.follows, "word"))
            return z * (1.0 - a) + (1.0 - z) * (1.0 - o), z * a * x + (1.0 - z) * o * y
        if kind == "bare":
            p = self.ends[word] * exp(UNMARKED)
        else:
            p = self.lefts.get((kind, word)) or self.kinds["wide_closed" if kind == "closed" and gap.follows == "caseless" else kind]
        return 1.0 - p, p * exp(self.evidence(gap.right, gap.follows, kind if kind in FOLLOWS else "mark"))

    def posteriors(self, found: list[Gap]) -> list[float]:
        """Posterior probability of a boundary at each gap, by forward and backward passes."""
        n = len(found)
        if not n:
            return []
        local = [self.weigh(g) for g in found]
        # a boundary right after a boundary would leave a sentence of a word or less
        near = [i > 0 and found[i].end - found[i - 1].start <= NEAR for i in range(n)]
        forward = [[0.0, 0.0] for _ in range(n)]
        for i in range(n):
            for e in (0, 1):
                if i == 0:
                    s = 1.0
                else:
                    s = forward[i - 1][0] + forward[i - 1][1] * (0.15 if e and near[i] else 1.0)
                forward[i][e] = s * local[i][e]
            z = forward[i][0] + forward[i][1] or 1.0
            forward[i] = [forward[i][0] / z, forward[i][1] / z]
        out, back = [0.0] * n, [1.0, 1.0]
        for i in range(n - 1, -1, -1):
            x, y = forward[i][0] * back[0], forward[i][1] * back[1]
            out[i] = y / (x + y) if x + y else 0.0
            stay, go = local[i][0] * back[0], local[i][1] * back[1]
            back = [stay + go, stay + go * (0.15 if near[i] else 1.0)]
            z = back[0] + back[1] or 1.0
            back = [back[0] / z, back[1] / z]
        return out


#: Words without a point.
_WORD = re.compile(r"[^\W_]++(?:['’][^\W_]++)?+(?!\.(?:\s|$))")


class Tally:
    """What training needs of texts: words that open units, all words, those that open units or follow gaps, and runs of near gaps."""

    def __init__(self) -> None:
        self.after, self.heard, self.opening, self.runs = Counter(), Counter(), Counter(), Counter()

    def __len__(self) -> int:
        return len(self.after) + len(self.heard) + len(self.opening) + len(self.runs)

    def add(self, text: str) -> None:
        for a, b, whole in units(text):
            if whole:
                continue
            m = _ITEM.match(text, a, b)
            first = m.end() if m else a
            found = gaps(text, a, b)
            r = _RIGHT.match(text, first, b)
            if r and r[1]:
                self.after[_key(r[1])] += 1
            self.heard.update(_WORD.findall(text, first, b))
            opens = {r.start(1): r[1]} if r and r[1] and _WORD.match(text, r.start(1), b) else {}
            for g in found:
                x = _RIGHT.match(text, g.start, b)
                if x and x[1] and _WORD.match(text, x.start(1), b):
                    opens[x.start(1)] = x[1]
            self.opening.update(opens.values())
            at = 0
            for i in range(1, len(found) + 1):
                if i == len(found) or found[i].end - found[i - 1].start > NEAR:
                    self.runs[tuple((g.kind, g.left, g.follows, g.right) for g in found[at:i])] += 1
                    at = i

    def inside(self) -> Counter:
        """Words that follow no boundary for certain."""
        out = Counter()
        for word, n in self.heard.items():
            n -= self.opening[word]
            if n <= 0:
                continue
            if "぀" <= word[0] <= "鿿":
                for i in range(len(word) - 1):
                    out[word[i : i + 2]] += n
            else:
                out[word if len(word) <= LONG_WORD else _key(word)] += n
        return out


#: Kinds of gaps whose posteriors count for the words that follow.
SURE = ("strong", "wide", "thai", "closed", "wide_closed", "dots")
#: What a round sums up by key. Words on the right (right): counts after a boundary and after none. Kinds (kind), words on the left (left),
#: kinds of followers by kind (follow): boundaries, gaps. Words before a point (point): boundaries, gaps, log likelihood ratios that
#: they are abbreviations. What follows their points (next): gaps.
SUMS = "what string, key string, x long, y long, z long"


def _expected(run: tuple, n: int, model: EventModel) -> Iterator[tuple[str, str, int, int, int]]:
    """The rows of ``SUMS`` of a run of gaps that was seen ``n`` times, in parts of ``GRAIN``."""
    found = [Gap(0, 0, kind, left, right, follows) for kind, left, follows, right in run]
    for g, p in zip(found, model.posteriors(found)):
        y = round(p * GRAIN)
        # a word met only after one abbreviation would confirm whatever is believed of that: points teach nothing of what follows
        sure = g.kind in SURE
        yield "right", g.right, n * y * sure, n * (GRAIN - y) * sure, 0
        yield "kind", g.kind, n * y, n * GRAIN, 0
        if g.kind == "word" and g.left:
            # repeats of one context say little more than the first
            yield "point", g.left, n * y, n * GRAIN, round((1.0 + log(n)) * model.belongs(g.left, g.right, g.follows) * GRAIN)
            if g.follows in STARTS:
                yield "next", f"{g.left} {g.follows}", n * GRAIN, 0, 0
        elif g.left:
            yield "left", f"{g.kind} {g.left}", n * y, n * GRAIN, 0
        if g.follows in STARTS and g.kind != "word":
            yield "follow", f"{g.kind if g.kind in FOLLOWS else 'mark'} {g.follows}", n * y, n * GRAIN, 0


def _next_model(rights: list[tuple[str, int, int]], totals: tuple[int, int], small: list[tuple[str, str, int, int]], lefts: list[tuple[str, int, int]], points: list[tuple], ends: list[tuple[str, int, int]]) -> EventModel:
    """The model after a round.

    ``rights``: word, after, inside. ``small``: what, key, boundaries, gaps of kinds and followers. ``lefts``: key, boundaries, gaps.
    ``points``: word, boundaries, gaps, ratios, how often heard away from openings, gaps by kind of follower. ``ends``: characters,
    boundaries, how often heard.
    """
    kinds = {key: (x / GRAIN + CLASS_WEIGHT * PRIORS[key]) / (n / GRAIN + CLASS_WEIGHT) for what, key, x, n in small if what == "kind" and key != "word"}
    counts = {tuple(key.split(" ")): (x / GRAIN, n / GRAIN) for what, key, x, n in small if what == "follow"}
    follows = {}
    for group in sorted({g for g, _ in counts}):
        i = sum(n - x for (g, _), (x, n) in counts.items() if g == group)
        for k, q in FOLLOWS[group].items():
            x, n = counts.get((group, k), (0.0, 0.0))
            follows[group, k] = (n - x + CLASS_WEIGHT * q) / (i + CLASS_WEIGHT)
    new = EventModel({w: a / GRAIN for w, a, _ in rights if a}, {w: i / GRAIN for w, _, i in rights if i}, (totals[0] / GRAIN, totals[1] / GRAIN), kinds, {}, follows)
    for key, x, n in lefts:
        kind, word = key.split(" ", 1)
        new.lefts[kind, word] = (x / GRAIN + WORD_WEIGHT * new.kinds[kind]) / (n / GRAIN + WORD_WEIGHT)
    for word, x, n, ratio, heard, nexts in points:
        odds, rate = _shape(word)
        x, n = x / GRAIN, n / GRAIN
        odds += _weight(word) * (ratio / GRAIN + heard / GRAIN * log(POINTLESS / (1.0 - new.rate)))
        shares = {k: (nexts.get(k, 0) / GRAIN + WORD_WEIGHT * q) / (n + WORD_WEIGHT) for k, q in FOLLOWS["abbreviation"].items()}
        new.points[word] = (_sigmoid(odds), (x + 5 * WORD_WEIGHT * rate) / (n + 5 * WORD_WEIGHT), shares)
    for word, x, heard in ends:
        new.ends[word] = (x / GRAIN + CHARACTER_WEIGHT * new.rate / 3) / (max(heard, x) / GRAIN + CHARACTER_WEIGHT)
    return new


def fit(texts: list[str]) -> EventModel:
    """A model of ``texts``; posteriors of one round are the counts of the next."""
    tally, model = Tally(), EventModel()
    for text in texts:
        tally.add(text)
    sure = tally.inside()
    for _ in range(ROUNDS):
        after, inside = Counter({w: n * GRAIN for w, n in tally.after.items()}), Counter({w: n * GRAIN for w, n in sure.items()})
        sums: dict[tuple[str, str], list[int]] = {}
        for run, n in tally.runs.items():
            for what, key, *values in _expected(run, n, model):
                total = sums.setdefault((what, key), [0, 0, 0])
                for k, v in enumerate(values):
                    total[k] += v
        for (what, key), (x, y, _) in sums.items():
            if what == "right":
                after[key] += x
                inside[key] += y
        first = sorted(after.keys() | inside.keys(), key=lambda w: (("right", w) not in sums, -after[w] - inside[w], w))[:WORDS]
        nexts: dict[str, dict[str, int]] = {}
        for (what, key), (x, _, _) in sums.items():
            if what == "next":
                nexts.setdefault(key.split(" ")[0], {})[key.split(" ")[1]] = x
        kept = lambda kind: sorted(((key, *v) for (what, key), v in sums.items() if what == kind), key=lambda r: (-r[2], r[0]))[:WORDS]
        model = _next_model(
            [(w, after[w], inside[w]) for w in first],
            (after.total(), inside.total()),
            [(what, key, x, y) for (what, key), (x, y, _) in sorted(sums.items()) if what in ("kind", "follow")],
            [r[:3] for r in kept("left") if not r[0].startswith("wide")],
            [(*r, sure[r[0]] * GRAIN, nexts.get(r[0], {})) for r in kept("point")],
            [(w, x, sure[w] * GRAIN) for key, x, _, _ in kept("left") if key.startswith("wide ") and _IDEOGRAPH.fullmatch(w := key[5:])],
        )
    return model


def bare_gaps(text: str, a: int, b: int, model: EventModel) -> list[Gap]:
    """The gaps between Chinese characters or kana of text[a:b], which holds no mark, at which a boundary is not out of the question."""
    if not model.ends:
        return []
    out = []
    for run in _IDEOGRAPHS.finditer(text, a, b):
        for i in range(run.start() + 2, run.end() - 1):
            left = text[i - 2 : i]
            if left in model.ends:
                out.append(Gap(i, i, "bare", left, text[i : i + 2], "caseless"))
    return out


_QUOTE = re.compile(f"[{re.escape(''.join({'\"', *_PAIRS, *''.join(_PAIRS.values())}))}]")


def _quotations(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of paired quotation marks and brackets in text[a:b]."""
    spans, stack, straight = [], [], -1
    for m in _QUOTE.finditer(text, a, b):
        i, c = m.start(), m[0]
        if c == '"':
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i))
                straight = -1
        elif stack and c in _PAIRS[text[stack[-1]]]:
            spans.append((stack.pop(), i))
        elif c in _PAIRS:
            stack.append(i)
    return spans


def sentences(text: str | None, model: EventModel) -> list[tuple[int, int]]:
    """Code point spans of the sentences of ``text``, in order; null and blank texts have none."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for a, b, whole in units(text):
        a, b = _trim(text, a, b)
        if a >= b:
            continue
        if whole:
            out.append((a, b))
            continue
        found = gaps(text, a, b) or bare_gaps(text, a, b, model)
        if not found:
            out.append((a, b))
            continue
        spans = _quotations(text, a, b)
        m = _ITEM.match(text, a, b)
        begin, base = a, m.end() if m else a
        for g, p in zip(found, model.posteriors(found)):
            if p < 0.5:
                continue
            # within a quotation that began after the sentence did, the enclosing sentence goes on
            head = base if begin == a else begin
            if any(head < o < g.end <= c for o, c in spans):
                continue
            x, y = _trim(text, begin, g.end)
            if x < y:
                out.append((x, y))
            begin = g.start
        x, y = _trim(text, begin, b)
        if x < y:
            out.append((x, y))
    return out


def restored(tables: dict) -> EventModel:
    """The model with these tables."""
    model = EventModel.__new__(EventModel)
    vars(model).update(tables)
    return model


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of the texts of a task; a tally is handed on before it grows large."""

    def rows(tally: Tally) -> pd.DataFrame:
        out = [("after", w, n) for w, n in tally.after.items()] + [("inside", w, n) for w, n in tally.inside().items()]
        return pd.DataFrame(out + [("run", json.dumps(run, ensure_ascii=False), n) for run, n in tally.runs.items()], columns=["what", "key", "n"])

    tally = Tally()
    for pdf in batches:
        for text in pdf["t"]:
            tally.add(text)
            if len(tally) > HELD:
                yield rows(tally)
                tally = Tally()
    yield rows(tally)


def train(docs: DataFrame, text_col: str = "text") -> EventModel:
    """A model of all texts of ``docs``, the same as ``fit`` gives at any partitioning.

    One pass counts the texts by task, the counts are summed by key, and each round goes over the distinct runs. Only the table
    of at most ``WORDS`` words of at most ``LONG_WORD`` characters and its two totals reach the driver.
    """
    texts = docs.select(F.col(text_col).alias("t")).where("t <> ''")
    counts = cut_lineage(texts.mapInPandas(_tallied, "what string, key string, n long").groupBy("what", "key").agg(F.sum("n").alias("n")))
    part = lambda what: F.when(F.col("what") == what, F.col("n") * GRAIN).otherwise(F.lit(0).cast("long"))
    sure = counts.where("what <> 'run'").select(F.lit("sure").alias("what"), "key", part("after").alias("x"), part("inside").alias("y"), F.lit(0).cast("long").alias("z"))
    bare = counts.where("what = 'inside'").select(F.col("key").alias("word"), (F.col("n") * GRAIN).alias("bare"))
    runs = counts.where("what = 'run'").select("key", "n")
    model = EventModel()
    for _ in range(ROUNDS):
        known = vars(model)

        def expect(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            now = restored(known)
            for pdf in batches:
                rows = [x for key, n in zip(pdf["key"], pdf["n"]) for x in _expected(json.loads(key), int(n), now)]
                yield pd.DataFrame(rows, columns=["what", "key", "x", "y", "z"])

        sums = cut_lineage(runs.mapInPandas(expect, SUMS).groupBy("what", "key").agg(*[F.sum(c).alias(c) for c in "xyz"]))
        words = sure.unionByName(sums.where("what = 'right'")).groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max(F.col("what") == "right").alias("at_gap"))
        total = words.agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
        first = words.orderBy(F.desc("at_gap"), F.desc(F.col("x") + F.col("y")), "key").limit(WORDS).select("key", "x", "y")
        kept = lambda what: sums.where(F.col("what") == what).orderBy(F.desc("y"), "key").limit(WORDS)
        lefts, ends = kept("left").where("key not like 'wide%'"), kept("left").where("key like 'wide %'").withColumn("word", F.expr("substring(key, 6)"))
        nexts = sums.where("what = 'next'").groupBy(F.substring_index("key", " ", 1).alias("word")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.substring_index("key", " ", -1).alias("k"), "x")))).alias("nexts"))
        points = kept("point").withColumnRenamed("key", "word").join(bare, "word", "left").join(nexts, "word", "left")
        small = sums.where("what in ('kind', 'follow')").orderBy("what", "key")
        zero = F.lit(0).cast("long")
        model = _next_model(
            [tuple(r) for r in first.collect()],
            (total["x"] or 0, total["y"] or 0),
            [(r["what"], r["key"], r["x"], r["y"]) for r in small.collect()],
            [(r["key"], r["x"], r["y"]) for r in lefts.collect()],
            [(*r[:5], r["nexts"] or {}) for r in points.select("word", "x", "y", "z", F.coalesce("bare", zero), "nexts").collect()],
            [tuple(r) for r in ends.join(bare, "word", "left").select("word", "x", F.coalesce("bare", zero)).collect() if _IDEOGRAPH.fullmatch(r["word"])],
        )
    return model


def split_sentences(docs: DataFrame, model: EventModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start_char, end_char)``: one row per sentence of each row of ``docs``, as 0-based code points, end exclusive.

    Null, empty and blank texts give no rows. Each row is cut by itself, without a shuffle; repeated rows give
    repeated sentences. A text is processed whole, in time proportional to its length.
    """
    schema = StructType([docs.schema[id_col], StructField("start_char", IntegerType(), False), StructField("end_char", IntegerType(), False)])
    tables = vars(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = restored(tables)
        for pdf in batches:
            rows = [(i, a, b) for i, t in zip(pdf[id_col], pdf[text_col]) for a, b in sentences(t, known)]
            yield pd.DataFrame(rows, columns=[id_col, "start_char", "end_char"])

    return docs.select(id_col, text_col).where(F.col(text_col) != "").mapInPandas(run, schema)


def p8_found(spark, sf_dir: str) -> DataFrame:
    """All sentences of all documents."""
    docs = widen(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return split_sentences(docs, train(docs))


def p8_lengths(spark, sf_dir: str) -> DataFrame:
    """Number of sentences by power of two of their length in characters."""
    docs = widen(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = split_sentences(docs, train(docs))
    return found.groupBy(F.floor(F.log2(F.col("end_char") - F.col("start_char"))).cast("int").alias("band")).agg(F.count("*").alias("sentences"))
