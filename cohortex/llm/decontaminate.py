"""Benchmark decontamination by spaced-seed hashing.

A mask names the positions of a short window that count and ignores the
others, so a window still matches after substitutions at ignored places;
13 to 24 words of which 80 % are equal have a window that matches.
Every window of the benchmark is hashed under every mask; in the tasks
every window of every whole document is hashed too and joined with the
benchmark's hashes. Around each hit the item is laid over the document
without gaps; the best-scoring stretch is taken if it is long and equal
enough, else the longest stretch that is.

The benchmark is read in blocks of a bounded number of bytes, each
broadcast for one scan of the documents; a usual benchmark is one block.
Documents are never shuffled.

Words are runs between ASCII white space and punctuation, in lower case;
in scripts that are written without spaces every character is a word.
Items of up to ``WHOLE`` words also have masks of their own length, of which
one at least misses every substitution that ``SIMILARITY`` allows; those
with fewer than ``SHORTEST`` words cannot tell a leak from chance and never
match.

An item may match a document along several diagonals, as where a word is
repeated: of its stretches that overlap in the document, the one with the
most equal words is reported.

Defined results: a null or empty text or item has no words and no match;
equal items match each; repeated documents are reported each; a null doc_id
or item_id is carried; an empty table gives an empty result; other columns
are ignored, or carried by ``clean_documents``.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.llm.common import row_of, rows_of, written

MASKS = ("111010011", "1100101011", "110110101", "10110001101", "11010111")
SHORTEST, LONG_ENOUGH, WHOLE, SIMILARITY, MISMATCH = 5, 13, 12, 0.8, -3
BLOCK_BYTES = 16 << 20
# Thai, Lao, Myanmar, Khmer, kana and Han
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_THREE_BYTES = bytes(range(0xE0, 0xF5))                       # first bytes of characters of three bytes and more
_TABLE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def spaced(text: str | None) -> bytes:
    """The text in lower case with its words parted by ASCII white space."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    if len(raw.translate(None, _THREE_BYTES)) < len(raw):     # the scripts in question have no shorter characters
        raw = _UNSPACED.sub(r" \1 ", raw.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
    return raw.translate(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return spaced(text).split()


def _hash(ids: np.ndarray, places: list[int], n: int) -> np.ndarray:
    """Hashes of the ``n`` windows of ``ids`` under a mask; 0 where a place
    has a word that the benchmark lacks."""
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for p in places:
        x = ids[p:p + n]
        known &= x > 0
        out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.where(known, out, 0)


def masks_of_length(n: int) -> list[str]:
    """Masks of ``n`` places: two of as many blocks as substitutions are
    allowed and two more, so that one mask has none of them."""
    allowed = n - int(np.ceil(SIMILARITY * n - 1e-9))
    block = [i * (allowed + 2) // n for i in range(n)]
    return ["".join("1" if b in two else "0" for b in block) for two in combinations(range(allowed + 2), 2)]


class SeedIndex:
    """The seeds of one block of benchmark items."""

    @classmethod
    def of(cls, state: dict) -> SeedIndex:
        """From ``vars()`` of another, which is plain data to broadcast."""
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= SHORTEST:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)))
        self.longest = max((len(ids) for _, ids in self.items), default=0)
        short = sorted({len(ids) for _, ids in self.items if len(ids) <= WHOLE})
        masks = [*((m, 0) for m in MASKS), *((m, n) for n in short for m in masks_of_length(n))]
        self.seeds = []                                     # per mask: places, span, sorted hashes, item, position
        for mask, length in masks:                          # length 0: every window of every item
            places, rows = [i for i, c in enumerate(mask) if c == "1"], []
            for k, (_, ids) in enumerate(self.items):
                n = len(ids) - len(mask) + 1
                if n > 0 and length in (0, len(ids)):
                    rows += [(h, k, q) for q, h in enumerate(_hash(ids, places, n).tolist())]
            rows.sort()
            self.seeds.append((places, len(mask), np.array([r[0] for r in rows], np.uint64),
                               np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)))

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, doc_start, item_start, n_words, n_equal) of a document."""
        get = self.vocabulary.get
        words = words_of(text)
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        found: list[np.ndarray] = []                         # item * width + shift + longest
        longest = self.longest
        width = len(ids) + longest + 1
        for places, span, hashes, item, at in self.seeds:
            n = len(ids) - span + 1
            if n <= 0 or not len(hashes):
                continue
            h = _hash(ids, places, n)
            where = np.flatnonzero(h)
            lo = np.searchsorted(hashes, h[where], "left")
            hi = np.searchsorted(hashes, h[where], "right")
            hit = hi > lo
            if not hit.any():
                continue
            where, lo, hi = where[hit], lo[hit], hi[hit]
            n = hi - lo
            if n.sum() <= 16 * (len(ids) + longest):          # few pairs: each at once
                pair = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(item[pair] * width + longest + np.repeat(where, n) - at[pair])
                continue
            for first in np.unique(lo).tolist():              # the windows of one hash, here and in the items
                here, last = where[lo == first], hi[lo == first][0]
                for k in np.unique(item[first:last]).tolist():
                    own = at[first:last][item[first:last] == k]
                    found.append(k * width + longest + differences(here, own))
        out: list[tuple[int, int, int, int, int]] = []
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for k in np.unique(keys // width).tolist():
            item_id, own = self.items[k]
            rows = [(a + shift, a, n, equal) for shift in (keys[keys // width == k] % width - longest).tolist()
                    for a, n, equal in [overlap(ids, own, shift) or (0, 0, 0)] if n]
            out += [(item_id, *r) for r in apart(rows)]
        return out


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct differences of two sets of places, ascending. Where the
    pairs are far more than the places between them, by a product of the
    sets' indicators, in about linear time."""
    lo, hi = int(a.min() - b.max()), int(a.max() - b.min())
    if len(a) * len(b) <= 64 * (hi - lo + 1):
        return np.unique(a[:, None] - b[None, :])
    x, y = (np.bincount(p) for p in (a - a.min(), b.max() - b))
    size = 1 << (len(x) + len(y) - 1).bit_length()
    pairs = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)
    return np.flatnonzero(pairs[:hi - lo + 1] > 0.5) + lo


def apart(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of stretches (start, item_start, n_words, n_equal) the best ones that
    do not overlap, by start: most equal words, then fewest words, then the
    first."""
    kept: list[tuple[int, int, int, int]] = []
    for r in sorted(rows, key=lambda r: (-r[3], r[2], r[0], r[1])):
        i = bisect_left(kept, r)
        if (i == len(kept) or kept[i][0] >= r[0] + r[2]) and (i == 0 or kept[i - 1][0] + kept[i - 1][2] <= r[0]):
            kept.insert(i, r)
    return kept


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(item_start, n_words, n_equal) of the best stretch of ``item`` laid
    over ``doc`` at ``shift``, or the longest if that one is too short or too
    different; None if all are."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[lo + shift:hi + shift]
    least = min(LONG_ENOUGH, len(item))
    if same.sum() < SIMILARITY * least:
        return None
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, MISMATCH))))
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    start = int(np.flatnonzero(total[:end + 1] == floor[end])[-1])
    if end - start < least or same[start:end].sum() < SIMILARITY * (end - start):
        start, end = longest_similar(same, SIMILARITY, least)
    if end - start < least:
        return None
    return lo + start, end - start, int(same[start:end].sum())


def longest_similar(same: np.ndarray, similarity: float, least: int) -> tuple[int, int]:
    """The longest stretch with a share of at least ``similarity`` equal;
    unequal words at its ends go, down to ``least`` words."""
    total = np.concatenate(([0], np.cumsum(same))) - similarity * np.arange(len(same) + 1)
    ahead = np.maximum.accumulate(total[::-1])              # the largest total from a place on, last place first
    ends = len(same) - np.searchsorted(ahead, total - 1e-9, "left")
    start = int(np.argmax(ends - np.arange(len(ends))))
    end = int(ends[start])
    while end - start > least and not same[end - 1]:
        end -= 1
    while end - start > least and not same[start]:
        start += 1
    return start, end


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Broadcast seed indexes, each of at most about ``block_bytes`` of text, and their number."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        items = sorted(((r[0], r[1]) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield rows.sparkSession.sparkContext.broadcast(vars(SeedIndex(items))), n


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, doc_start, item_start, n_words, n_equal): the
    benchmark passages in documents, positions in words. Of several blocks
    each is done with, its rows written, before the next one is made."""
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
    out = None
    for index, n in _blocks(benchmark, block_bytes):
        def run(batches, seeds=index):
            index = SeedIndex.of(seeds.value)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for m in index.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            run, ", ".join(f"{c} long" for c in names))
        if n > 1:
            part = written(part, "leaks")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage was found. Of
    several blocks each is done with, the rows that are left written, before
    the next one is made."""
    rows = docs.select(row_of(docs))
    for index, n in _blocks(benchmark, block_bytes):
        def run(batches, seeds=index):
            index = SeedIndex.of(seeds.value)
            for b in batches:
                texts = pc.struct_field(b.column(0), "text")
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in texts], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
        if n > 1:
            rows = written(rows, "clean")
            index.destroy()
    return rows_of(rows)
