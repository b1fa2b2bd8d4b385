"""Periodic runs of words, found by an online sparse diagonal DP.

A run is a maximal stretch of words with smallest period q (words q apart
are equal) that repeats at least ``exponent`` times and has at least
``min_words`` words. On diagonal q of the text against itself a run of
length n is n - q matches in a row, so the scan over the words keeps one
match length per active lag: an earlier occurrence at distance q raises the
length of lag q by one, and a lag that the next word does not raise ends
there and emits its run if it was long enough.

Which earlier occurrences count keeps the scan sparse and exact. Take the
grams of m words with 2q <= m <= (exponent - 1) q. Inside a run of smallest
period q, the nearest earlier occurrence of every gram whose words all
match at lag q is at distance q: a nearer one, at d, would give the gram
the periods q and d and so, being 2q or longer, a period that divides q.
And as m <= (exponent - 1) q, every run has such a gram. So per scale m,
which serves the lags from m / (exponent - 1) to m / 2, the nearest earlier
occurrence is enough, and a place raises at most one lag per scale; the
scales grow by half (at exponent 4), so a text of n words has about log n
of them. A lag that is not the smallest period never comes up. Grams of
the next scale are pairs of this scale's; only places whose gram occurs
again go on, which in prose are few after the first scales.

Words are runs between ASCII white space; places count words from 0.

Defined results: null and empty texts have no words, no run and an empty
collapsed text; a null doc_id is carried; every row is a text of its own,
also where rows are equal or share a doc_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT, MIN_WORDS = 4, 6
CHUNK = 1 << 20                                     # words scanned together; a longer text is scanned alone

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Vocabulary(dict):
    """word -> a number of its own."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def scales(longest: int, exponent: int = EXPONENT) -> Iterator[tuple[int, int, int]]:
    """(words of a gram, smallest lag, largest lag) for texts of up to
    ``longest`` words."""
    lag = 1
    while exponent * lag <= longest:
        gram = (exponent - 1) * lag
        yield gram, lag, gram // 2
        lag = gram // 2 + 1


def _recurring(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of grams ``key`` at ascending places ``at`` those that occur again:
    (places, number of the gram, distance to its nearest earlier occurrence
    or 0), by place."""
    order = np.argsort(key, kind="stable")
    k, a = key[order], at[order]
    same = k[1:] == k[:-1]
    again = np.zeros(len(k), bool)
    again[1:] |= same
    again[:-1] |= same
    lag = np.zeros(len(k), np.int64)
    lag[1:] = np.where(same, a[1:] - a[:-1], 0)
    number = np.concatenate(([0], np.cumsum(~same)))[:len(k)]
    a, number, lag = a[again], number[again], lag[again]
    back = np.argsort(a, kind="stable")
    return a[back], number[back], lag[back]


def occurrences(words: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """The earlier occurrences that count: (place, lag), by place. ``words``
    are the word numbers of texts of ``sizes`` words, one after the other."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    end = np.repeat(np.cumsum(sizes), sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    top = int(words.max()) + 1
    at = np.flatnonzero(np.arange(n) + 2 <= end)
    at, number, lag = _recurring((text[at] * top + words[at]) * top + words[at + 1], at)
    size, places, lags = 2, [none], [none]
    for gram, low, high in scales(int(sizes.max()), exponent):
        while size < gram and len(at):
            step = min(size, gram - size)
            full = np.full(n, -1, np.int64)
            full[at] = number
            fits = at[at + size + step <= end[at]]
            fits = fits[full[fits + step] >= 0]
            at, number, lag = _recurring(full[fits] * n + full[fits + step], fits)
            size += step
        hit = (lag >= low) & (lag <= high)
        places.append(at[hit])
        lags.append(lag[hit])
        if not len(at):
            break
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.argsort(place, kind="stable")
    return place[order], lag[order]


def diagonal_runs(place: np.ndarray, lag: np.ndarray, longest: int, exponent: int = EXPONENT,
                  min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """The online DP: (start, length, period) of every run, as they end."""
    table = list(scales(longest, exponent))
    lows = [low for _, low, _ in table]
    out: list[tuple[int, int, int]] = []

    def ended(q: int, matches: int, last: int):
        gram = table[bisect_right(lows, q) - 1][0]
        length = matches - 1 + gram + q
        if length >= max(min_words, exponent * q):
            out.append((last - matches + 1 - q, length, q))

    before: dict[int, int] = {}                     # lag -> match length, at the place before
    now: dict[int, int] = {}                        # the same, at this place
    here = -2
    for j, q in zip(place.tolist() + [-1], lag.tolist() + [0]):
        if j != here:
            for x in before.keys() - now.keys():
                ended(x, before[x], here - 1)
            if j != here + 1:
                for x, matches in now.items():
                    ended(x, matches, here)
                now = {}
            before, now, here = now, {}, j
        if j >= 0:
            now[q] = before.get(q, 0) + 1
    return out


def runs_of(words: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, min_words: int = MIN_WORDS):
    """For texts of ``sizes`` words: (text, start, length, period) of their
    runs by text, start and period, starts counted in the text, and the mask
    of the words that stay when every run keeps only its first period."""
    begin = np.concatenate(([0], np.cumsum(sizes)))
    place, lag = occurrences(words, sizes, exponent)
    found = diagonal_runs(place, lag, int(sizes.max(initial=0)), exponent, min_words)
    runs = np.array(sorted((s, q, n) for s, n, q in found), np.int64).reshape(-1, 3)
    start, period, length = runs.T
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    text = np.searchsorted(begin, start, side="right") - 1
    return (text, start - begin[text], length, period), np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``runs`` by start, then
    period, and ``collapsed``: the text's words, joined by a space, without
    those that a run repeats. ``exponent`` is 3 or more."""
    if exponent < 3:
        raise ValueError("runs of fewer than three repeats are not found by their nearest occurrence")

    def emit(ids, texts: list[list[bytes]]):
        sizes = np.array([len(t) for t in texts], np.int64)
        vocabulary = Vocabulary()
        words = np.fromiter((vocabulary[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        (text, start, length, period), stays = runs_of(words, sizes, exponent, min_words)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
        collapsed, at, hit = [], 0, set(text.tolist())
        for i, t in enumerate(texts):
            kept = [w for w, s in zip(t, stays[at:at + len(t)].tolist()) if s] if i in hit else t
            collapsed.append(b" ".join(kept))
            at += len(t)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), lists.cast(_RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            ids, texts, held, first, total = b.column(0), b.column(1).cast(pa.binary()), [], 0, 0
            for i in range(b.num_rows):
                words = (texts[i].as_py() or b"").split()
                if held and total + len(words) > CHUNK:
                    yield emit(ids.slice(first, len(held)), held)
                    held, first, total = [], i, 0
                held.append(words)
                total += len(words)
            if held:
                yield emit(ids.slice(first, len(held)), held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
