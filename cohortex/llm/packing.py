"""Packing by concatenate and cut.

Pass one tokenizes in the tasks and writes, per document, its token ids and
the number of tokens that its partition held before it. The partitions'
totals (one row per partition) become global offsets by a prefix sum. Pass
two knows every token's place in the one stream of all documents and cuts
it into windows of ``length``: a document that crosses a boundary leaves
one record per window. Nothing is shuffled, every window but the last is
full, and a lost task is repeated from the written table.

Token ids are those of the ``tokenizers`` library. Texts of Latin letters
are encoded by ``tiktoken`` from the same vocabulary file, which gives the
same ids several times as fast; all else (other scripts, special strings, a
vocabulary whose ids are not in merge order, very long runs of white space)
goes through ``tokenizers``.

Defined results: a null or empty text is one end token; a null doc_id is
carried; repeated rows are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortex.llm.common import written

NOT_LATIN = re.compile("[^\x00-\u024f]")
# The split of ``tiktoken`` overflows its stack on about a million of one kind in a row.
LONG = 100_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONG}}}")                 # tried once a run, at its head
# Fixed value: the split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _fast_encoder(vocabulary: str):
    """The same vocabulary for ``tiktoken``; None unless it is byte-level
    BPE whose merges are in the order of their ids."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if (model["type"], split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True), spec["normalizer"]) != \
            ("BPE", "ByteLevel", False, True, None):
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    letters = _letters()
    ranks = {bytes(letters[c] for c in t): model["vocab"][t] for t in [*letters, *merged]}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts as little-endian bytes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _fast_encoder(vocabulary)

    def encode(self, text: str) -> bytes:
        long_run = len(text) >= LONG and LONG_RUN.search(text)
        if self.fast and not long_run and not NOT_LATIN.search(text) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, self.dtype).tobytes()


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 1, chunk: int = 512) -> DataFrame:
    """doc_id, ids (bytes, the end token last), n, part, before."""

    def run(batches):
        encoder, part, before = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                piece = b.slice(at, chunk)
                ids = [encoder.encode(t.as_py() or "") + end for t in piece.column(1)]
                n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
                sofar = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(sofar)],
                    names=["doc_id", "ids", "n", "part", "before"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids binary, n long, part int, before long")


def pieces(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (bytes), doc_tokens,
    sequence_id, offset, boundary (the document continues in another window),
    ids_crc32 (of little-endian 32-bit ids)."""
    t = written(tokenized(docs, vocabulary, end_id), "tokens")
    totals = t.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))     # one row per partition
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    placed = t.join(F.broadcast(offsets), "part").select("doc_id", "ids", "n", (F.col("offset") + F.col("before")).alias("at"))

    def run(batches):
        for b in batches:
            rows = [[] for _ in range(9)]
            for doc, ids, n, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n", "at"))):
                width, start = len(ids) // n, 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    own = ids[start * width:(start + size) * width]
                    crc = zlib.crc32(np.frombuffer(own, f"<u{width}").astype("<u4").tobytes())
                    for to, x in zip(rows, (doc, start, size, own, n, sequence, offset, size < n, crc)):
                        to.append(x)
                    start += size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)],
                                             names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "boundary", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long, boundary boolean, ids_crc32 long")


def piece_digests(packed: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32`` for ``ids``. The digests are made with
    the pieces: a second Python function would be a second worker for each
    task, and each worker that has once tokenized keeps some 150 MB."""
    return packed.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (bytes). A
    sequence has at most as many pieces as tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids")))
