"""Periodic runs, the fair mix and the Merkle manifest against brute force
on the fixture of the other operators: nulls, empty and very long texts,
repeated rows, an empty table, columns with clashing names."""

import hashlib
import random
import uuid
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortex.llm import merkle_manifest, mixing, periodic_runs
from cohortex.llm import queries as Q
from cohortex.session import scratch_path
from tests.llm.test_operators import corpus, prose, words

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, runs string, row string, place int, `group` string, "
          "tree int, size string, target string, words string, a string, p string, block int, _key string, _block string")


def fixture():
    rng = random.Random(5)
    extra = [(1000 + i, " ".join([*prose(rng, 3).split(), *(["beat"] * i), *(prose(rng, 1 + i % 7).split() * (i % 9)), "end"]))
             for i in range(60)]
    rows = [(r[0], r[1], r[2], (None, "b", "a", "é", "hot", "hot", "hot")[i % 7], r[4]) for i, r in enumerate(corpus())]
    rows += [(i, t, "en", ("hot", "lone")[i == 1007], len(t)) for i, t in extra]
    return [r + ("x", "y", 1, "z", 2, "a", "b", "c", "d", "e", 3, "f", "g") for r in [*rows, rows[5], rows[30]]]


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("mix"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/none/documents.parquet")
    return d


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ----------------------------------------------------------------- runs

def brute_runs(w, exponent=4, least=6):
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def looped_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.choice([0, 5, 30, 150]):
                motif = [rng.randint(0, rng.choice([1, 3])) for _ in range(rng.randint(1, 12))]
                w += (motif * rng.randint(1, 9))[:rng.randint(1, 100)]
            texts.append(w)
        for exponent in (3, 4, 5):
            (text, start, length, period), stays = periodic_runs.runs_of(np.array(sum(texts, []), np.int64),
                                                                         np.array([len(t) for t in texts]), exponent)
            got = [[] for _ in texts]
            for t, s, n, q in zip(*(x.tolist() for x in (text, start, length, period))):
                got[t].append((s, q, n))
            assert got == [brute_runs(t, exponent) for t in texts]
            at = 0
            for t, runs in zip(texts, got):
                gone = {i for s, q, n in runs for i in range(s + q, s + n)}
                assert [i for i in range(len(t)) if not stays[at + i]] == sorted(gone)
                at += len(t)


def test_periodic_runs_query(spark, sf_dir, rows):
    got = Counter(tuple(r) for r in Q.op11_periodic_runs(spark, sf_dir).collect())
    want = Counter()
    for r in rows:
        w = looped_words(r[0], words(r[1]))
        # the long text is its own test below: brute force takes a minute over it
        runs = brute_runs(w) if len(w) < 5000 else [(s, q, n) for s, n, q in scanned(w)]
        best = max(runs, key=lambda x: (x[2], -x[0], -x[1]), default=None)
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        row = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want[(r[0], len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)),
              sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    assert got == want
    assert Q.op11_periodic_runs(spark, f"{sf_dir}/none").count() == 0


def scanned(w):
    vocabulary = periodic_runs.Vocabulary()
    (_, s, n, q), _ = periodic_runs.runs_of(np.array([vocabulary[x] for x in w]), np.array([len(w)]))
    return sorted(zip(s.tolist(), n.tolist(), q.tolist()), key=lambda x: (x[0], x[2]))


def test_runs_of_very_long_texts_stay_linear():
    same = np.zeros(300_000, np.int64)
    assert [x.tolist() for x in periodic_runs.runs_of(same, np.array([300_000]))[0]] == [[0], [0], [300_000], [1]]
    tiled = np.tile(np.arange(5_000), 60)
    assert [x.tolist() for x in periodic_runs.runs_of(tiled, np.array([300_000]))[0]] == [[0], [0], [300_000], [5_000]]


# ------------------------------------------------------------------ mix

def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < unit * weight[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_the_mix_meets_its_targets(spark, sf_dir, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(sizes)
    got = Q.op12_fair_mix(spark, sf_dir).collect()
    source = Counter((r[0], len(words(r[1])), sizes[r[3]]) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == source
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)                                 # a source is known by its size here
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - target[by_size[r["source_size"]]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[by_size[r["source_size"]]] += r["taken"]
    assert sum(taken.values()) == 3 * sum(sizes.values()) // 2
    assert all(abs(taken[s] - target[s]) <= 1 + len(sizes) for s in sizes)
    again = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7, "n_chars")
    assert sorted(map(str, mixing.mix(again).collect())) == sorted(map(str, got))
    assert Q.op12_fair_mix(spark, f"{sf_dir}/none").count() == 0


def test_the_schedule_is_fair_all_along(spark, sf_dir):
    s = mixing.schedule(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("taken > 0").orderBy("at").collect()
    assert [r["at"] for r in s] == np.cumsum([0, *[r["taken"] for r in s]])[:-1].tolist()
    assert [r["finish"] for r in s] == sorted(r["finish"] for r in s)
    most, served = defaultdict(int), defaultdict(int)
    for r in s:
        most[r["source"]] = max(most[r["source"]], r["size"])
    for r in s:
        served[r["source"]] += r["taken"]
        assert abs(served[r["source"]] - r["finish"] * r["target"]) <= 1 + len(most)
    passes = defaultdict(list)
    for r in s:
        passes[r["source"]].append((r["copy"], r["row"]))
    assert all([c for c, _ in p] == sorted(c for c, _ in p) for p in passes.values())


@pytest.mark.parametrize("sizes", [[0, 0], [1], [0, 7, 0, 1], [1, 10 ** 12, 3, 4, 5, 6, 7, 8]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    want = brute_targets(dict(zip(names, sizes)))
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
    for r in got:
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert 0 <= r["limit"] - want[r["source"]] < 1


# ------------------------------------------------------------- manifest

def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def brute_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 3:i - i % 3 + 3]
        out.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        i //= 3
    return out


def brute_manifest(rows):
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    groups = defaultdict(list)
    for r in rows:
        cut = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        groups[r[3]].append((r[0], leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if cut else r[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[s] = brute_tree([x[1] for x in groups[s]])
    over, out = brute_tree([trees[s][-1][0] for s in names]), Counter()
    for k, s in enumerate(names):
        for i, (doc_id, h, bad) in enumerate(groups[s]):
            path = brute_path(trees[s], i) + brute_path(over, k)
            fold = bad
            for left, right in path:
                fold = sha(left + fold + right)
            out[(doc_id, h, trees[s][-1][0], over[-1][0], sha("".join(a + b for a, b in path)), fold, fold == over[-1][0])] += 1
    return out


def test_manifest_query(spark, sf_dir, rows):
    got = Counter(tuple(r) for r in Q.op13_merkle_manifest(spark, sf_dir).collect())
    want = brute_manifest(rows)
    assert got == want
    assert {r[-1] for r in want} == {True, False}
    assert Q.op13_merkle_manifest(spark, f"{sf_dir}/none").count() == 0


def test_a_task_holds_the_paths_of_few_subtrees(spark):
    """A batch of many subtrees comes back as small ones, each node with its path."""
    sizes, width = [81] * 500 + [40], merkle_manifest.WIDTH
    nodes = [[{"pos": b * width + i, "hash": sha(f"{b}.{i}")} for i in range(n)] for b, n in enumerate(sizes)]
    n = sum(sizes)
    columns = {"n": pa.array([n] * len(sizes)), "path": pa.array([f"{b}:" for b in range(len(sizes))]),
               "nodes": pa.array(nodes, pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.string())])))}
    batch = pa.RecordBatch.from_pydict(columns)
    got = list(merkle_manifest._with_paths(iter([batch.slice(0, 300), batch.slice(300)]), {c: i for i, c in enumerate(columns)}))
    assert max(b.num_rows for b in got) <= merkle_manifest.AT_ONCE
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["nodes"] for r in rows] == nodes
    for r in rows[::50] + rows[-1:]:
        hashes = [x["hash"] for x in r["nodes"]]
        assert r["paths"] == merkle_manifest.ways(merkle_manifest.interior(hashes, False), r["path"])


def test_manifest_of_several_stored_levels_and_groups(spark):
    """A group of 3 stored levels beside lone leaves; more groups than a subtree holds."""
    sizes = [7000, *range(1, 95), 82, 81, 243, 244, 1]
    rows = [(i, f"g{g:03}", sha(f"{g} {i}")) for g, n in enumerate(sizes) for i in range(n)]
    leaves = spark.createDataFrame([(g, k, h) for k, g, h in rows], "group string, key long, leaf string").repartition(5)
    path = scratch_path(spark, f"manifest-{uuid.uuid4().hex}")
    built = merkle_manifest.build(leaves, path)
    stored = merkle_manifest.load(spark, path)
    assert len(built.levels) == 3 and len(built.over) == 2 and merkle_manifest.root(stored) == merkle_manifest.root(built)
    p = merkle_manifest.proofs(stored).withColumn("fold", merkle_manifest.folded(F.col("leaf"), F.col("path")))
    got = {(r["group"], r["key"]): r for r in p.collect()}
    trees = [brute_tree([sha(f"{g} {i}") for i in range(n)]) for g, n in enumerate(sizes)]
    over = brute_tree([t[-1][0] for t in trees])
    assert len(got) == len(rows) and p.where("fold <> root").count() == 0
    for g, t in enumerate(trees):
        for i in range(0, sizes[g], 1 if sizes[g] < 300 else 97):
            r = got[(f"g{g:03}", i)]
            assert (r["subroot"], r["root"]) == (t[-1][0], over[-1][0])
            assert r["path"] == ",".join(f"{a}:{b}" for a, b in brute_path(t, i) + brute_path(over, g))
