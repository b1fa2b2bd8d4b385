"""Token counts by rank-synchronous merging of ragged arrays.

A sentencepiece BPE model merges the adjacent pair whose concatenation has
the best score, the leftmost first, until none is left. Here all pre-tokens
of a batch are merged together: their symbols lie in one flat numpy array,
and each round finds every sequence's lowest-rank pair with one segmented
minimum and merges all of those pairs at once. Only the ranks beside a
merge are looked up again. What survives is counted; a character outside
the vocabulary counts its UTF-8 bytes (byte fallback).

Pre-tokens begin at a space: no piece has a space after another character,
so merges never cross into the next one (checked when the model is read).
A text's pre-tokens that its task has seen before are taken from a bounded
memo, the others are merged ``BLOCK_CHARS`` characters at a time. Runs of more than ``LONG`` characters without a place where no piece
can reach across are merged from a heap, one pair at a time.

Defined results: a null text is empty and has no tokens; repeated rows are
counted each; an empty table gives an empty result; other columns are
ignored; a null doc_id is carried.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_WORDS = 500_000
BLOCK_CHARS = 1 << 20
LONG = 2048
SPACE = "▁"
_NONE = np.int64(1) << 30
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """Symbols, pair ranks and byte costs of a sentencepiece BPE model."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_file)
        pieces = {m.id_to_piece(i): m.get_score(i) for i in range(m.vocab_size())
                  if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model has pieces across words")
        symbols = sorted(set(pieces) | {c for p in pieces for c in p}, key=lambda s: (len(s), s))
        self.ids = {s: i for i, s in enumerate(symbols)}
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -pieces[p])
        rank, self.pairs = {}, {}
        for r, p in enumerate(order):
            rank[p] = r if not r or pieces[p] != pieces[order[r - 1]] else rank[order[r - 1]]
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = (rank[p], self.ids[p])
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.ranks = np.array([*(self.pairs[k][0] for k in keys.tolist()), _NONE], np.int64)
        self.merged = np.array([*(self.pairs[k][1] for k in keys.tolist()), -1], np.int64)
        # by code point: symbol, or -1 minus the UTF-8 bytes of a character that no piece has
        cp = np.arange(0x110000)
        self.symbol = -1 - np.select([cp < 0x80, cp < 0x800, cp < 0x10000], [1, 2, 3], 4).astype(np.int64)
        for s, i in self.ids.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbols], np.int64)
        self.touch = np.array(sorted({self.ids[p[i]] << 32 | self.ids[p[i + 1]] for p in order for i in range(len(p) - 1)}), np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.ranks[at], self.merged[at]

    def _costs(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym >= 0, self.cost[np.maximum(sym, 0)], -1 - sym)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of every pre-token (non-empty strings)."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        text = "".join(words)
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        # a sequence ends with its word, and where no piece has the two characters side by side
        key = np.append(self.touch, np.int64(1) << 62)
        near = sym[:-1] << 32 | sym[1:]
        apart = (sym[:-1] < 0) | (sym[1:] < 0) | (key[np.searchsorted(key, near.clip(0))] != near)
        first = np.concatenate(([True], apart | (word[1:] != word[:-1])))
        seq = np.cumsum(first) - 1
        owner = word[first]                                      # of each sequence
        size = np.bincount(seq)
        total = np.zeros(len(size), np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        for s in np.flatnonzero(size > LONG).tolist():
            total[s] = self._from_heap(sym[begin[s]:begin[s + 1]].tolist())
        live = (size <= LONG)[seq]
        sym, seq = sym[live], seq[live]
        last = np.append(seq[1:] != seq[:-1], True) if len(seq) else np.zeros(0, bool)
        rank, into = self._find(sym, np.where(last, -1, np.append(sym[1:], -1))) if len(sym) else (sym, sym)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            done = low >> 32 >= _NONE
            if done.any():                                       # count what survived, go on with the others
                over = np.repeat(done, np.diff(np.append(starts, len(sym))))
                np.add.at(total, seq[over], self._costs(sym[over]))
                kept = ~over
                at_new = np.cumsum(kept) - 1
                low = at_new[(low[~done] & 0xFFFFFFFF)]
                sym, seq, rank, into = sym[kept], seq[kept], rank[kept], into[kept]
            else:
                low = low & 0xFFFFFFFF
            if not len(sym):
                break
            sym[low] = into[low]                                 # merge with the right neighbour, and drop that
            kept = np.ones(len(sym), bool)
            kept[low + 1] = False
            at_new = np.cumsum(kept) - 1
            low = at_new[low]
            sym, seq, rank, into = sym[kept], seq[kept], rank[kept], into[kept]
            for at in (low, low[low > 0] - 1):                   # pairs that begin or end with the new symbol
                right = np.minimum(at + 1, len(sym) - 1)
                same = (at + 1 < len(sym)) & (seq[right] == seq[at])
                rank[at], into[at] = self._find(sym[at], np.where(same, sym[right], -1))
        np.add.at(out, owner, total)
        return out

    def _from_heap(self, sym: list[int]) -> int:
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        heap = [(self.pairs[k][0], i, k) for i in range(len(sym) - 1) if (k := self._key(sym[i], sym[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j < 0 or self._key(sym[i], sym[j]) != k:
                continue
            sym[i], sym[j] = self.pairs[k][1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (k := self._key(sym[a], sym[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[k][0], a, k))
        return int(self._costs(np.array([s for s in sym if s is not None], np.int64)).sum())

    @staticmethod
    def _key(a: int, b: int) -> int:
        return a << 32 | b if a >= 0 and b >= 0 else -1


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space mark."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [p[1:] for p in _PRETOKEN.findall(SPACE + text.replace(" ", SPACE))]


def _blocks(words, chars: int = BLOCK_CHARS):
    """Lists of words with about ``chars`` characters each."""
    block, size = [], 0
    for w in words:
        block.append(w)
        size += len(w) + 1
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def run(batches):
        model, memo = PieceModel(model_file), {}
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [pretokens(t) for t in texts]
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for block in _blocks({w for ws in words for w in ws}.difference(memo)):
                    memo.update(zip(block, model.counts([SPACE + w.replace(" ", SPACE) for w in block]).tolist()))
                n = np.array([sum(map(memo.__getitem__, ws)) for ws in words], np.int64)
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
