"""Problem 6: byte-level BPE encoding of whole columns by speculation and verification.

A text is cut into words by the vocabulary's pattern. Per batch, each distinct word unknown so far
gets a proposal by greedy longest match; one vectorised pass then tests every pair of neighbouring
tokens of all proposals, and only words with a failing pair are merged exactly.

Why the test suffices: merges happen in the order of their ids. Tokens a, b stay neighbours exactly
if no merge spans the seam between them, and what lies at the seam at any time is one node of the
right spine of a and one of the left spine of b. A proposal all of whose pairs pass is the result of
the merges (and a token of the vocabulary is the result for its own bytes).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from scriptoria.runtime import table, widen

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how the vocabulary's words are cut.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Words remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 300_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items() if all(c in symbols for c in s)}
        size = max(vocab.values()) + 1
        # rank 0 is a byte, rank r the r-th merge: ids need not follow the order of the merges
        self.rank = np.zeros(size, np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        pairs = np.empty((len(merges), 3), np.int64)
        for r, (a, b) in enumerate(merges, 1):
            whole = vocab[a + b]
            pairs[r - 1] = vocab[a], vocab[b], r
            self.rank[whole], self.left[whole], self.right[whole] = r, vocab[a], vocab[b]
        self.whole = {(a, b): (r, vocab["".join(m)]) for (a, b, r), m in zip(pairs.tolist(), merges)}
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], pairs[order, 2]
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each a[i] and b[i] stay neighbours when their bytes are merged together.

        The merges are undone from the last: of the two seam nodes the later one is opened, and a pair
        merge counts if it would have come before that opening. Of equal ranks the left one came first.
        """
        good = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), np.iinfo(np.int64).max)  # the seam merge must have a smaller rank than this
        while len(at):
            keys = x << 32 | y
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            spans = (self.keys[i] == keys) & (self.ranks[i] < before)
            good[at[spans]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~spans & ((rx > 0) | (ry > 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            opens_x = rx > ry
            before = np.where(opens_x, rx, ry + 1)
            x, y = np.where(opens_x, self.right[x], x), np.where(opens_x, y, self.left[y])
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, ids = [], 0, self.ids
        while at < len(word):
            end = min(len(word), at + self.longest)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The merges of a word in their order, by a heap over a linked list: O(n log n)."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.whole[p][0], i, p) for i, p in enumerate(pairwise(ids)) if p in self.whole]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.whole[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for k in (prior[i], i):
                if k >= 0 and after[k] < n and (hit := self.whole.get(p := (ids[k], ids[after[k]]))):
                    heappush(heap, (hit[0], k, p))
        return [i for i in ids if i >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not known yet."""
        fresh, proposals = [], []
        for word in words:
            raw = word.encode("utf-8", "replace")
            if (i := self.ids.get(raw)) is not None:
                self.known[word] = [i]
            else:
                fresh.append((word, raw))
                proposals.append(self.propose(raw))
        if not fresh:
            return
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        tokens = np.fromiter(chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[1:] == owner[:-1]
        seams, which = np.unique(tokens[:-1][inside] << 32 | tokens[1:][inside], return_inverse=True)
        fine = self.compatible(seams >> 32, seams & 0xFFFFFFFF)[which]
        failed = np.zeros(len(sizes), bool)
        failed[owner[1:][inside][~fine]] = True
        for (word, raw), proposal, bad in zip(fresh, proposals, failed):
            self.known[word] = self.merge(raw) if bad else proposal

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set(chain.from_iterable(cut)) - self.known.keys())
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once per worker."""
    return Bpe(path)


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", path: str = f"{TOKENIZERS}/{VOCABULARY}", count_only: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` replaced by the ids ``out`` (array<int>), or their number if ``count_only``.

    Null and empty texts give an empty list (0). Text that looks like a control token is plain text. One
    pass without a shuffle; a text is encoded whole. Other columns pass through, save one named ``out``.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text_col, out)]
    kind = IntegerType() if count_only else ArrayType(IntegerType(), False)
    schema = StructType([*keep, StructField(out, kind, False)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = bpe.encode(part.column(text_col).to_pylist())
                sizes = np.fromiter(map(len, found), np.int32, len(found))
                if count_only:
                    column = pa.array(sizes)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    values = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], names=[*names, out])

    return docs.select(*names, text_col).mapInArrow(run, schema)


def p6_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return encode(widen(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_length_histogram(spark, sf_dir: str) -> DataFrame:
    """Documents and tokens by power of two of the length in tokens (-1 for none)."""
    lengths = encode(widen(table(spark, sf_dir, "documents").select("doc_id", "text")), out="n", count_only=True)
    band = F.when(F.col("n") == 0, -1).otherwise(F.floor(F.log2("n")).cast("int"))
    return lengths.groupBy(band.alias("band")).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
