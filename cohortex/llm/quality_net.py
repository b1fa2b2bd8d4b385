"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: every word bucket has a fixed sparse random *index
vector*; the *word vector* of a bucket is the sum, over all occurrences in
the whole corpus, of the index vectors of the words beside it. Words are
hashed to ``BUCKETS`` buckets, so the vectors are one table of fixed size
whatever the corpus: partial sums come from the tasks, Spark adds them up
with a map-side combine, and the table of ``BUCKETS x DIM`` numbers is
broadcast. Documents are pooled to mean and spread of their word vectors.

The network is fitted on the driver on at most ``max_rows`` labelled rows
(those with the smallest hash of the doc_id), a fifth of which is held back
to fit the temperature that calibrates the probabilities. Labels, language,
source and doc_id are no inputs of a score.

Defined results: a null or empty text has the zero vector and a score like
any text; labels that are null, or of unknown documents, are not learned
from, several labels of a document count as their maximum; repeated rows
are scored each; with no labels, or of one class only, every score is that
class's smoothed share; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.llm.common import written

BUCKETS, DIM, NONZERO, REACH, SEED = 1 << 14, 32, 4, 2, 17
MAX_ROWS = 20_000
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


class Buckets(dict):
    """token -> bucket, remembered for a bounded number of tokens."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[token] = bucket = zlib.crc32(token) % BUCKETS
        return bucket

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM, NONZERO entries of +1 or -1 in each row."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.int16)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int16), axis=1)
    return out


def _context_sums(ids: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into[w]`` the index vectors within REACH of every ``w``."""
    for at in range(0, len(ids), 1 << 16):                       # bounded memory for very long texts
        lo, hi = max(0, at - REACH), min(len(ids), at + (1 << 16) + REACH)
        own = ids[at:at + (1 << 16)]
        padded = np.zeros((hi - lo + 2 * REACH, DIM), np.int16)
        padded[REACH:REACH + hi - lo] = index[ids[lo:hi]]
        begin = at - lo
        around = sum(padded[begin + REACH + s:begin + REACH + s + len(own)] for s in range(-REACH, REACH + 1) if s)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) != 0)))
        into[own[order][starts]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The BUCKETS x DIM word vectors of the whole corpus, each bucket's
    scaled to length 1 after the corpus mean is taken off."""
    cols = [f"d{i}" for i in range(DIM)]

    def run(batches):
        index, sums, buckets = index_vectors(), np.zeros((BUCKETS, DIM), np.int64), Buckets()
        for b in batches:
            for t in b.column(0):
                ids = buckets.of(t.as_py())
                if len(ids):
                    _context_sums(ids, index, sums)
        rows = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(sums[rows, i]) for i in range(DIM))], names=["bucket", *cols])

    partial = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in cols))
    total = partial.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()     # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIM))
    out[total["bucket"].to_numpy(np.int64)] = total[cols].to_numpy(float)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    seen = length[:, 0] > 0
    if seen.any():
        out[seen] -= out[seen].mean(axis=0)
    return out.astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of a document."""
    if not len(ids):
        return np.zeros(2 * DIM, np.float32)
    one, two = np.zeros(DIM), np.zeros(DIM)
    for at in range(0, len(ids), 1 << 16):
        x = vectors[ids[at:at + (1 << 16)]]
        one += x.sum(axis=0, dtype=float)
        two += np.einsum("ij,ij->j", x, x, dtype=float)
    mean = one / len(ids)
    return np.concatenate([mean, np.sqrt(np.maximum(two / len(ids) - mean ** 2, 0))]).astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and ``vec``, the pooled vector as little-endian 32-bit floats."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)                 # BUCKETS x DIM numbers

    def run(batches):
        buckets = Buckets()
        for b in batches:
            vec = [pooled(buckets.of(t.as_py()), table.value).astype("<f4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary())], names=["doc_id", "vec"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, vec binary")


class Network:
    """Input, tanh layer, one logit; the temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray, hidden: int = 32, epochs: int = 400,
                 rate: float = 0.01, decay: float = 1e-4):
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.fitted = len(set(y[~hold].tolist())) == 2
        if not self.fitted:
            return
        self.mean, self.scale = x[~hold].mean(axis=0), x[~hold].std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        self.w = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        a, b = x[~hold], y[~hold]
        for step in range(1, epochs + 1):
            h = np.tanh(a @ self.w[0] + self.w[1])
            g = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - b) / len(b)
            back = g[:, None] * self.w[2] * (1 - h * h)
            grads = [a.T @ back + decay * self.w[0], back.sum(axis=0), h.T @ g + decay * self.w[2], np.array([g.sum()])]
            for w, grad, m, v in zip(self.w, grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        if hold.any():
            z, t = self._logit(x[hold]), y[hold]
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            loss = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), float(self.share))
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(_fold(doc_id), F.lit(4)) == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    vectors = word_vectors(docs)
    table = written(document_vectors(docs, vectors), "document-vectors")
    known = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("quality").cast("double").alias("quality")).where(~held_out()))
    # labelled rows by hash of the doc_id: as many as max_rows on average, and no more
    one = table.groupBy("doc_id").agg(F.min("vec").alias("vec"))            # of texts that share a doc_id always the same one
    rows = known.join(one, "doc_id").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    share = min(1.0, max_rows / max(1, known.count()))
    rows = (rows.where(F.col("h") < int(share * (1 << 40)))
            .select("quality", "vec", (F.pmod(F.floor(_fold() / 4), F.lit(5)) == 0).alias("hold"), "h", "doc_id")
            .orderBy("h", "doc_id").limit(max_rows).collect())
    x = np.array([np.frombuffer(r["vec"], "<f4") for r in rows], float).reshape(-1, 2 * DIM)
    net = Network(x, np.array([r["quality"] for r in rows]), np.array([r["hold"] for r in rows], bool))

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), "<f4").reshape(-1, 2 * DIM).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.score(x))], names=["doc_id", "score"])

    return (table.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
