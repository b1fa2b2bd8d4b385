"""The pipeline against brute force, stage by stage."""

import random
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cohortex.llm.common import written
from tests.llm.test_operators import SCHEMA, brute_components, brute_fingerprint, brute_spans, brute_stats, corpus, prose, words

# names of the operators' own, and one that is no identifier
CLASHING = ("blob", "_blob", "found", "_found", "_id", "_text", "_q_votes", "votes_", "row", "root", "hit", "whole", "text_hash", "id",
            "node", "kept", "pattern", "posterior", "n_words", "masked", "first", "a.b", "x`y", "two words")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(33)
    item = prose(rng, 30)
    rows = corpus() + [(500, prose(rng, 40) + " " + item + " " + prose(rng, 20), "en", "s", 0, "c", "c", 1, 2),
                       (501, prose(rng, 60) + " token = abcdefgh12345678 " + prose(rng, 20), "en", "s", 0, "c", "c", 1, 2),
                       (502, prose(rng, 30) + " " + " ".join(w if i % 7 else "odd" for i, w in enumerate(item.split(" "))), "en", "s", 0, "c", "c", 1, 2),
                       (503, prose(rng, 30) + " " + " ".join(w if i % 3 else "odd" for i, w in enumerate(item.split(" "))), "en", "s", 0, "c", "c", 1, 2)]
    rows += [(600 + i, " ".join(w.upper() + "!!" for w in prose(rng, 50).split(" ")), "en", "s", 0, "c", "c", 1, 2) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    docs.repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item), (None, prose(rng, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


# -------------------------------------------------- quality, written anew

def brute_votes(text):
    """The nine rules' votes from a text's statistics: 1 good, -1 bad, 0 abstains."""
    n, chars, symbols, dup, repeat = brute_stats(text)
    if not n:
        return (-1,) + (0,) * 8
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    marks = sum(x[0] in "|#*-&$%<>=+~" and len(x) <= 3 and len(set(x)) == 1 for x in w)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    return (-1 if n < 20 else int(n >= 40),
            -1 if not 2.5 <= chars / n <= 12 else int(3.5 <= chars / n <= 6.5),
            -1 if symbols > n / 10 else int(symbols == 0),
            -int(marks > n / 5), -int(dup > max(2, 0.3 * len(lines))), -int(repeat > n / 5), -int(upper > 0.4 * (upper + lower)),
            -int(text.count("!") > n / 10), -int(sum("0" <= c <= "9" for c in text) > 0.3 * chars))


def brute_kept(texts, rounds=100):
    """EM over rows, not patterns, with plain numbers; then the base rule."""
    votes = [brute_votes(t) for t in texts]
    belief = {0: {-1: 0.5, 0: 0.35, 1: 0.15}, 1: {-1: 0.01, 0: 0.49, 1: 0.5}}
    table = {c: [dict(belief[c]) for _ in range(9)] for c in (0, 1)}
    share, prior, weight = {0: 0.2, 1: 0.8}, {0: 0.2, 1: 0.8}, 0.05
    for _ in range(rounds):
        good = []
        for v in votes:
            score = {c: log(share[c]) + sum(log(table[c][r][x]) for r, x in enumerate(v)) for c in (0, 1)}
            top = max(score.values())
            part = {c: 2.718281828459045 ** (score[c] - top) for c in (0, 1)}
            good.append(part[1] / (part[0] + part[1]))
        mass = {0: [1 - g for g in good], 1: good}
        new = {}
        for c in (0, 1):
            new[c] = []
            for r in range(9):
                pull = weight * len(votes) * share[c]
                cell = {x: pull * belief[c][x] for x in (-1, 0, 1)}
                for v, m in zip(votes, mass[c]):
                    cell[v[r]] += m
                total = sum(cell.values())
                cell = {x: y / total for x, y in cell.items()}
                if c and cell[-1] > 0.01:                        # a rule's false alarms are bounded
                    rest = 1 - cell[-1]
                    cell = {-1: 0.01, 0: cell[0] * 0.99 / rest, 1: cell[1] * 0.99 / rest}
                new[c].append(cell)
        share = {c: (sum(mass[c]) + weight * len(votes) * prior[c]) / (len(votes) * (1 + weight)) for c in (0, 1)}
        change = max(abs(new[c][r][x] - table[c][r][x]) for c in (0, 1) for r in range(9) for x in (-1, 0, 1))
        table = new
        if change < 1e-9:
            break
    out = []
    for t, g in zip(texts, good):
        n, _, _, _, repeat = brute_stats(t)
        out.append(n >= 20 and 100 * repeat <= 30 * n and g >= 0.5)
    return out


# ------------------------------------------- benchmark passages, written anew

def brute_words(text):
    for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        text = text.replace(c, " ")
    return words(text.lower())


def brute_leaks(text, items):
    """Whether any stretch of an item lies over the text: 13 words, or the whole item, of which 80 % are equal."""
    doc = brute_words(text or "")
    for item in map(brute_words, items):
        least = min(13, len(item))
        for shift in range(-len(item) + 1, len(doc)):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
            if sum(same) < 0.8 * least:
                continue
            if any(sum(same[a:b]) >= 0.8 * (b - a) for a in range(len(item)) for b in range(a + least, len(item) + 1)):
                return True
    return False


def test_stages_keep_what_brute_force_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        before = docs.collect()
        out = written(stage(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns
        after = out.collect()
        for r in after:                                          # other columns go along with their row
            assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for c in CLASHING)
        if name == "quality_rules":
            verdict = brute_kept([r["text"] for r in before])
            assert sorted(map(str, after)) == sorted(str(r) for r, kept in zip(before, verdict) if kept)
            assert 0 < len(after) < len(before)
        elif name == "simhash_near_dedup":
            known = [r for r in before if r["doc_id"] is not None]
            want = {c for _, c in brute_components([brute_fingerprint(r["text"]) for r in known], [r["doc_id"] for r in known], 2)}
            ids = [r["doc_id"] for r in after if r["doc_id"] is not None]
            assert sorted(ids) == sorted(want)
        elif name == "benchmark_decontamination":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if not brute_leaks(r["text"], items))
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert {500, 502} <= gone and 503 not in gone
        else:
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
            assert not any(brute_spans(r["text"]) for r in after) and any(brute_spans(r["text"]) for r in before)
        docs = out
    pieces = P.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.agg(F.countDistinct("doc_id")).first()[0] == docs.agg(F.countDistinct("doc_id")).first()[0]
    assert P.run(spark, sf_dir).agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]


def test_an_empty_table_goes_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
