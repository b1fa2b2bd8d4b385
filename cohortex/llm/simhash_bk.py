"""SimHash near-duplicates through BK-trees.

Every text gets a 64-bit fingerprint: a bit is 1 if it is set in over half
of the XXH64 hashes (seed 42) of the text's word shingles. Fingerprints
that differ in at most ``max_bits`` bits are linked, and the groups are
the connected components.

Trees by shard. Fingerprints are cut into ``max_bits + 3`` blocks of bits;
two fingerprints within ``max_bits`` agree on at least three whole blocks.
A shard is one value of three blocks, so linked fingerprints always meet
in a shard, and a shard of unrelated ones is tiny even for billions. In
each shard a BK-tree is grown, whose children are keyed by their integer
Hamming distance to the parent; a search with radius ``r`` at distance
``d`` from a node follows the edges ``d - r .. d + r`` only. All probes of
a shard walk its tree together, as one numpy array per node.

The trees hold every distinct fingerprint, so their total grows with the
corpus: they reach the tasks that probe them through the exchange, not as
a driver broadcast. A shard with more than ``tree_size`` fingerprints is
cut into bounded trees, and each tree gets the shard's later parts as
further probes: no task builds more than a bounded tree, and no link of
the shard is lost. A tree emits a spanning forest of its links, never the
pairs.

Defined results: null and empty texts have no words and fingerprint zero,
linked like any other; repeated rows and equal texts share a fingerprint;
a null doc_id gets a fingerprint but links nothing and has a null
component; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortex.llm.common import reliable, row_of, rows_of
from cohortex.operators.categories import quoted

SEED = 42


# ------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):                                   # bounded memory for very long texts
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep_text_hash: bool = False) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's bits as a signed long), and
    ``text_hash`` if asked for."""
    names = ["doc_id", "fp", *["text_hash"] * keep_text_hash]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias("text_hash")] * keep_text_hash)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ----------------------------------------------------------------- BK-tree

class BKTree:
    """A BK-tree over an array of distinct fingerprints: node ``i`` has
    ``children[i]``, a map from Hamming distance to the child node."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps.astype(np.uint64)
        self.children: list[dict[int, int]] = [{} for _ in range(len(fps))]
        # every (parent, members) splits into one child per distance
        stack = [(0, np.arange(1, len(fps)))] if len(fps) else []
        while stack:
            node, members = stack.pop()
            if not len(members):
                continue
            dist = np.bitwise_count(self.fps[members] ^ self.fps[node])
            order = np.argsort(dist, kind="stable")
            members, dist = members[order], dist[order]
            cuts = np.flatnonzero(np.diff(dist)) + 1
            for d, part in zip(dist[np.concatenate(([0], cuts))].tolist(), np.split(members, cuts)):
                self.children[node][d] = int(part[0])
                stack.append((int(part[0]), part[1:]))

    def within(self, probes: np.ndarray, radius: int):
        """(node, indexes of the probes within ``radius`` of it), node by node."""
        probes = probes.astype(np.uint64)
        stack = [(0, np.arange(len(probes)))] if len(self.fps) else []
        while stack:
            node, at = stack.pop()
            dist = np.bitwise_count(probes[at] ^ self.fps[node]).astype(np.int16)
            near = at[dist <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = at[np.abs(dist - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


class _Forest:
    """Union-find over node ids that remembers which unions joined trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def tree_links(tree_fps, tree_nodes, probe_fps, probe_nodes, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a tree's nodes, and between
    them and the probes, as (node id, node id)."""
    tree, forest, out = BKTree(np.asarray(tree_fps)), _Forest(), []
    all_fps = np.concatenate([np.asarray(tree_fps), np.asarray(probe_fps)])
    all_nodes = [*map(int, tree_nodes), *map(int, probe_nodes)]
    for node, near in tree.within(all_fps, radius):
        a = all_nodes[node]
        out += [(a, all_nodes[i]) for i in near.tolist() if forest.join(a, all_nodes[i])]
    return out


def _shard_masks(max_bits: int) -> list[int]:
    """The bits of three blocks out of ``max_bits + 3``, every choice."""
    n = max_bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2, tree_size: int = 4096) -> DataFrame:
    """``fps``: one row (fp, node) per distinct fingerprint. Returns rows
    (a, b) of node ids whose components are those of all links."""
    masks = _shard_masks(max_bits)
    keyed = fps.select("fp", "node", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for i, m in enumerate(masks)])).alias("k")).select("fp", "node", "k.choice", "k.value")
    # shards of one fingerprint link nothing; parts of large ones are numbered
    sizes = keyed.groupBy("choice", "value").agg(F.count("*").alias("members")).where("members > 1")
    met = keyed.join(sizes, ["choice", "value"])
    parts = F.ceil(F.col("members") / F.lit(tree_size)).cast("int")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    # tree number t of a shard holds part t and is probed by the parts after it
    rows = (met.withColumn("part", part)
            .select("choice", "value", "fp", "node", "part", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("tree"))
            .repartition("choice", "value", "tree").sortWithinPartitions("choice", "value", "tree", "part", "fp"))

    def run(batches):
        held, key = [], None                     # the rows of one tree: its part, then probes in bounded blocks

        def flush(block):
            own = block[3] == key[2]
            if own.sum() and len(own) > 1:
                return tree_links(block[4][own], block[5][own], block[4][~own], block[5][~own], max_bits)
            return []

        def emit(pairs):
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        def gather():
            return [np.concatenate([h[i] for h in held]) for i in range(6)]

        for b in batches:
            cols = [b.column(n).to_numpy(zero_copy_only=False)
                    for n in ("choice", "value", "tree", "part", "fp", "node")]
            n, pairs = b.num_rows, []
            if not n:
                continue
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            bounds = [0, *new.tolist(), n]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                at = (int(cols[0][lo]), int(cols[1][lo]), int(cols[2][lo]))
                if at != key:
                    if held:
                        pairs += flush(gather())
                    held, key = [], at
                held.append([c[lo:hi] for c in cols])
                if sum(len(h[0]) for h in held) >= 16 * tree_size:        # probes of a hot shard: block by block
                    block = gather()
                    pairs += flush(block)
                    held = [[c[block[3] == key[2]] for c in block]]
            yield emit(pairs)
        if held:
            yield emit(flush(gather()))

    return rows.mapInArrow(run, "a long, b long").distinct()


# -------------------------------------------------------------- components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node it
    reaches. Alternates large-star and small-star steps, each an aggregate
    (combined map-side) and a join whose hot keys Spark can split."""
    e = reliable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large-star: larger neighbours of u move to u's smallest neighbour (or u itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours of u, and u, move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = reliable(e)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
    raise RuntimeError("the components did not settle")


# ----------------------------------------------------------------- operator

def _grouped(d: DataFrame, max_bits: int, tree_size: int) -> DataFrame:
    """``d`` (doc_id, fp, ...) with ``root``, the same for all fingerprints
    of a group. Fingerprints are the nodes: one doc_id can have several."""
    fps = d.where("doc_id is not null").select("fp", F.col("fp").alias("node")).distinct()
    roots = components(links(fps, max_bits, tree_size))
    return d.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, tree_size: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long) and
    component_id, the smallest doc_id reachable over links."""
    d = reliable(fingerprints(docs, shingle))
    low = d.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    low = reliable(_grouped(low, max_bits, tree_size))
    named = low.join(low.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("fp", "component_id")
    return d.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Of each group the row with the smallest doc_id, fingerprint and text
    hash, once, with the columns of ``docs``. Rows without a doc_id belong to
    no group and stay."""
    text = F.xxhash64("text")
    d = reliable(fingerprints(docs, shingle, keep_text_hash=True)).where("doc_id is not null")
    low = d.groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "text_hash")).alias("low")).select("low.*")
    first = _grouped(low, max_bits, 4096).groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_hash")).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    # equal texts under one doc_id: the smallest by the hash of all columns that have one
    hashed = [quoted(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.where("doc_id is not null").select(row_of(docs), F.col("doc_id").cast("long").alias("id"), text.alias("text_hash"),
                                                   F.xxhash64(*hashed).alias("whole"))
    once = (rows.join(stay, ["id", "text_hash"], "left_semi").groupBy("id", "text_hash")
            .agg(F.min_by("row", "whole").alias("row")))
    return rows_of(once).unionByName(docs.where("doc_id is null"))


def hex16(fp: str = "fp"):
    """A signed long's bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
