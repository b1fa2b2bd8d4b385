"""Quality rules as weak supervision.

Each rule looks at the surface statistics of a whole text and votes
*good* (1), *bad* (-1) or abstains (0). Expectation-maximisation over the
vote patterns estimates how each rule votes in each class, and the
posterior probability of the good class replaces an all-must-pass filter.

One pass over the texts computes statistics and votes in the tasks. What
the estimation needs is the number of rows per vote pattern: at most
``3 ** len(RULES)`` rows whatever the corpus, so collecting the counts and
broadcasting the posteriors back are both bounded by that number.

Defined results: a null text has no words (all statistics 0, base failed);
an empty table gives an empty result; repeated rows are kept and counted
as often as they occur; a null doc_id is carried; other columns are neither
read nor changed, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.llm.common import row_of, rows_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MARKS = frozenset(m * k for m in [b"|", b"#", b"*", b"-", b"&", b"$", b"%", b"<", b">", b"=", b"+", b"~"] for k in (1, 2, 3))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _ids(values: np.ndarray) -> tuple[np.ndarray, int]:
    uniq, inv = np.unique(values, return_inverse=True)
    return inv.astype(np.int64), len(uniq)


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that occur twice or more.

    Exact ids of windows of 2, 4, 8 words come from pairs of ids of the
    half-length windows; a length without repeats ends the search."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    k, distinct = 1, len(index)
    while k < window:
        ids, distinct = _ids(ids[:-k] * (distinct + 1) + ids[k:])
        if distinct == len(ids):
            return 0
        k *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[list[int], list[int]]:
    """The contract's statistics of a text, and the further ones that only
    rules read: lines, upper- and lower-case ASCII letters, digits, ``!``
    and words that are only marks."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()                      # ASCII white space only, as in [^\x20\x09-\x0D]+
    n = len(words)
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()] if n else []
    seps = sum(text.count(c) for c in " \t\n\v\f\r")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    base = [n, len(text) - seps, int(sum(hist[ord(c)] for c in SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words)]
    return base, [len(lines), int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum()),
                  int(hist[33]), sum(map(MARKS.__contains__, words))]


# (name, vote of the statistics); words is at least 1 where a rule is asked
RULES = [
    ("length", lambda s: -1 if s["n_words"] < 20 else 1 if s["n_words"] >= 40 else 0),
    ("word_length", lambda s: -1 if not 2.5 <= s["word_chars"] / s["n_words"] <= 12
        else 1 if 3.5 <= s["word_chars"] / s["n_words"] <= 6.5 else 0),
    ("symbols", lambda s: -1 if s["n_symbols"] > 0.1 * s["n_words"] else 1 if not s["n_symbols"] else 0),
    ("markup", lambda s: -1 if s["n_marks"] > 0.2 * s["n_words"] else 0),
    ("duplicate_lines", lambda s: -1 if s["n_dup_lines"] > max(2, 0.3 * s["n_lines"]) else 0),
    ("repeats", lambda s: -1 if s["n_repeat_words"] > 0.2 * s["n_words"] else 0),
    ("capitals", lambda s: -1 if s["n_upper"] > 0.4 * (s["n_upper"] + s["n_lower"]) else 0),
    ("exclamations", lambda s: -1 if s["n_bangs"] > 0.1 * s["n_words"] else 0),
    ("digits", lambda s: -1 if s["n_digits"] > 0.3 * s["word_chars"] else 0),
]
_EXTRA = ["n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_marks"]


def _votes(base: list[int], extra: list[int]) -> str:
    """One character per rule: ``+`` good, ``-`` bad, ``0`` abstains."""
    s = dict(zip(STATS + _EXTRA, base + extra))
    if not s["n_words"]:
        return "-" + "0" * (len(RULES) - 1)
    return "".join("-0+"[vote(s) + 1] for _, vote in RULES)


def with_votes(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """``row``, the columns of ``docs`` that ``keep`` (a selection of them)
    has as one, plus the statistics and ``votes``."""
    carried = docs.select(row_of(keep), F.col("text"))
    schema = T.StructType([carried.schema["row"], *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("votes", T.StringType())])

    def run(batches):
        for b in batches:
            stats, votes = [], []
            for t in b.column(1):
                base, extra = text_stats(t.as_py())
                stats.append(base)
                votes.append(_votes(base, extra))
            cols = np.array(stats, np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(cols[:, i]) for i in range(len(STATS))), pa.array(votes, pa.string())],
                names=["row", *STATS, "votes"])

    return carried.mapInArrow(run, schema)


def estimate(patterns: dict[str, int], prior_good: float = 0.8, weight: float = 0.05,
             max_false_alarm: float = 0.01, rounds: int = 100) -> dict[str, float]:
    """EM for the class-conditional vote tables of independent rules.

    ``patterns`` has the rows per vote pattern. Every table starts from, and
    is drawn with ``weight`` of the rows towards, the belief that a rule's
    bad vote is rare in good texts; that keeps the classes from changing
    places. ``max_false_alarm`` bounds a rule's bad votes in the good class:
    without it a junk family that only one rule sees is absorbed there.
    Returns the posterior probability of *good* per pattern."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["-0+".index(c) for c in k] for k in keys])            # pattern x rule
    hot = np.eye(3)[v]                                                    # pattern x rule x vote
    belief = np.array([[0.5, 0.35, 0.15], [0.01, 0.49, 0.5]])             # class x vote: bad, good
    table = np.repeat(belief[:, None, :], v.shape[1], axis=1)             # class x rule x vote
    share = np.array([1 - prior_good, prior_good])
    for _ in range(rounds):
        log = np.log(share) + np.einsum("prv,crv->pc", hot, np.log(table))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * n[:, None]
        extra = weight * n.sum() * share
        new = np.einsum("pc,prv->crv", mass, hot) + (extra[:, None, None] * belief[:, None, :])
        new /= new.sum(axis=2, keepdims=True)
        alarm = np.minimum(new[1, :, 0], max_false_alarm)
        new[1, :, 1:] *= ((1 - alarm) / (1 - new[1, :, 0]))[:, None]
        new[1, :, 0] = alarm
        share = (mass.sum(axis=0) + weight * n.sum() * np.array([1 - prior_good, prior_good])) / (n.sum() * (1 + weight))
        done = np.abs(new - table).max() < 1e-9
        table = new
        if done:
            break
    return {k: float(p) for k, p in zip(keys, post[:, 1])}


def judged(docs: DataFrame, keep: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``row`` (the columns of ``keep``), statistics, votes, posterior,
    base_failed and the verdict ``kept``. The votes are written once; the
    estimation and the result both read that table."""
    spark = docs.sparkSession
    votes = written(with_votes(docs, keep), "quality-votes")
    counts = {r[0]: r[1] for r in votes.groupBy("votes").count().collect()}  # at most 3 ** len(RULES) rows
    posterior = spark.createDataFrame([(k, p) for k, p in estimate(counts).items()], "pattern string, posterior double")
    d = votes.join(F.broadcast(posterior), F.col("votes") == F.col("pattern"), "left").drop("pattern")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (d.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def quality_verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, statistics, base_failed, kept,
    posterior, votes."""
    d = judged(docs, docs.select("doc_id"), threshold)
    return d.select("row.doc_id", *STATS, "base_failed", "kept", "posterior", "votes")


def kept_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose verdict is *kept*, with its own columns."""
    return rows_of(judged(docs, docs, threshold).where("kept"))
