"""Merkle manifest of a dataset, stored by checkpoint-and-recompute.

Leaves are hashes of rows. Every group (a source) is a tree over its leaves
by key, and one more tree over the groups' roots gives the dataset's root.
A node is the hash of up to ``FANOUT`` nodes below it, in order.

Only every ``STEP``-th level is stored: one node of a stored level stands
for an aligned subtree of ``WIDTH`` nodes of the stored level below. To
extract proofs, the task that holds such a subtree's stored nodes hashes
its missing interior levels again, emits the siblings along each node's way
up, appends the way of the subtree's own root, and forgets the interior.
Building goes up the stored levels, extraction down, one join per stored
level on (tree, node), so a group with a third of all rows is as many
subtrees as it needs and none of them meets in one task.

A path is text: per level from the bottom ``left:right``, the siblings
before and after the node, levels joined by commas; a lone node of a level
that has more runs has neither, and a tree of one node has the empty path.

Defined results: a null field hashes as ``-``; null groups come first, null
keys first in their group; rows with equal keys are ordered by their leaf;
equal rows are leaves of their own; an empty table has no tree and gives an
empty result; other columns than the hashed and carried ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.llm.common import reliable
from cohortex.operators.indexing import join_groups, with_row_index

FANOUT, STEP = 3, 4
WIDTH = FANOUT ** STEP
AT_ONCE = 32                                        # subtrees whose paths a task holds

_NODE = "tree long, n long, pos long, hash string"


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """The hash of ``fields``: each its length in bytes, a colon and itself,
    or a dash if null."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def interior(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels above ``nodes``, theirs first: ``STEP`` more of a subtree,
    or all up to the root where ``nodes`` are a tree's whole level."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= STEP:
        last = levels[-1]
        levels.append([_hash(last[i:i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return levels


def ways(levels: list[list[str]], above: str) -> list[str]:
    """The path of every node of the lowest level, ``above`` being that of
    the highest one's node."""
    paths = [above]
    for level in levels[-2::-1]:
        own = []
        for i in range(len(level)):
            first = i - i % FANOUT
            own.append(f"{''.join(level[first:i])}:{''.join(level[i + 1:first + FANOUT])}")
        paths = [f"{o},{paths[i // FANOUT]}" if paths[i // FANOUT] else o for i, o in enumerate(own)]
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and a path give."""
    step = lambda h, x: F.sha2(F.concat(F.substring_index(x, ":", 1), h, F.substring_index(x, ":", -1)), 256)
    return F.when(path == "", leaf).otherwise(F.aggregate(F.split(path, ","), leaf, step))


def siblings(path: Column) -> Column:
    """All sibling hashes of a path, from the bottom, left to right."""
    return F.translate(path, ":,", "")


@dataclass(frozen=True)
class Manifest:
    """A stored manifest. ``levels[i]`` holds the nodes that the subtrees of
    the i-th stored level stand for, roots with n = 0."""

    subtrees: DataFrame                 # tree, n, block, nodes: of leaves, with their key and what is carried
    levels: list[DataFrame]             # tree, n, pos, hash
    groups: DataFrame                   # tree, group, subroot
    over: list[DataFrame]               # levels of the tree over the groups


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """At most ``WIDTH`` nodes each, in order."""
    others = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    return (nodes.groupBy("tree", "n", F.floor(F.col("pos") / WIDTH).alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", *others))).alias("nodes")))


def _raised(subtrees: DataFrame) -> DataFrame:
    """The node that each subtree stands for; n = 0 where it is a root."""

    def run(batches):
        for b in batches:
            tree, n, block, nodes = (b.column(i).to_pylist() for i in range(4))
            whole = [x <= WIDTH for x in n]
            top = [interior(x, w)[-1][0] for x, w in zip(nodes, whole)]
            up = [0 if w else -(-x // WIDTH) for x, w in zip(n, whole)]
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(up, pa.int64()), pa.array(block, pa.int64()),
                                              pa.array(top, pa.string())], names=["tree", "n", "pos", "hash"])

    return subtrees.select("tree", "n", "block", F.transform("nodes", lambda x: x["hash"]).alias("nodes")).mapInArrow(run, _NODE)


def _levels(subtrees: DataFrame, path: str) -> list[DataFrame]:
    """The stored levels above ``subtrees``, each written and read back."""
    longest, out = subtrees.agg(F.max("n")).first()[0] or 0, []
    while True:
        out.append(_saved(_raised(subtrees), f"{path}/level-{(len(out) + 1) * STEP}"))
        if longest <= WIDTH:
            return out
        longest = -(-longest // WIDTH)
        subtrees = _subtrees(out[-1].where("n > 0"))


def _roots(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.where("n = 0").select("tree", "hash")


def _over_leaves(groups: DataFrame, n: int) -> DataFrame:
    return groups.select(F.lit(-1).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("pos"),
                         F.col("subroot").alias("hash"))


def build(leaves: DataFrame, path: str) -> Manifest:
    """Writes the manifest of ``leaves`` (group, key, leaf and columns that
    proofs shall carry) under ``path``; the table ``stored`` comes last, so
    a manifest that broke off cannot be loaded."""
    spark = leaves.sparkSession
    carried = [c for c in leaves.columns if c not in ("group", "key", "leaf")]
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), *carried]
    placed = with_row_index(_saved(leaves, f"{path}/leaves"), "_at", order)
    spans = placed.groupBy("group").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    spans = reliable(with_row_index(spans, "tree", [F.col("group").asc_nulls_first()])).withColumnRenamed("group", "_group")
    named = spans.select("tree", F.col("_group").alias("group"))
    rows = (join_groups(placed, spans, "group", "_group", "_at")
            .select("tree", "n", (F.col("_at") - F.col("_first")).alias("pos"), F.col("leaf").alias("hash"), "key", *carried))
    subtrees = _saved(_subtrees(rows), f"{path}/level-0")
    levels = _levels(subtrees, path)
    groups = _saved(named.join(_roots(levels), "tree").select("tree", "group", F.col("hash").alias("subroot")), f"{path}/groups")
    over = _levels(_subtrees(_over_leaves(groups, groups.count())), f"{path}/over")
    spark.createDataFrame([(len(levels), len(over))], "levels int, over int").write.parquet(f"{path}/stored")
    return Manifest(subtrees, levels, groups, over)


def load(spark: SparkSession, path: str) -> Manifest:
    """The manifest that ``build`` wrote under ``path``."""
    n, m = spark.read.parquet(f"{path}/stored").first()
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return Manifest(table("level-0"), [table(f"level-{(i + 1) * STEP}") for i in range(n)], table("groups"),
                    [table(f"over/level-{(i + 1) * STEP}") for i in range(m)])


def root(manifest: Manifest) -> str | None:
    """The dataset's root; None for an empty one."""
    rows = _roots(manifest.over).collect()                                     # one row
    return rows[0]["hash"] if rows else None


def _with_paths(batches: Iterator[pa.RecordBatch], place: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Subtrees with ``paths``, one of each node. A path is as long as the
    tree is high, so few subtrees at a time are opened and handed on."""
    for whole in batches:
        for first in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(first, AT_ONCE)
            nodes = b.column(place["nodes"])
            cut = (nodes.offsets.to_numpy() - nodes.offsets[0].as_py()).tolist()
            hashes = nodes.flatten().field("hash").to_pylist()
            paths = [ways(interior(hashes[lo:hi], n <= WIDTH), above)
                     for lo, hi, n, above in zip(cut, cut[1:], b.column(place["n"]).to_pylist(), b.column(place["path"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(paths, pa.list_(pa.string()))], names=[*b.schema.names, "paths"])


def _extracted(subtrees: DataFrame, above: DataFrame) -> DataFrame:
    """One row per node of ``subtrees``: tree, path, the node's columns and
    those of ``above``, which has tree, block and path of each subtree."""
    asked = subtrees.join(above, ["tree", "block"])
    place = {c: i for i, c in enumerate(asked.columns)}
    out = asked.mapInArrow(lambda batches: _with_paths(batches, place),
                           T.StructType([*asked.schema.fields, T.StructField("paths", T.ArrayType(T.StringType()))]))
    above = [c for c in above.columns if c not in ("block", "path")]
    return (out.select(*above, F.explode(F.arrays_zip("nodes", "paths")).alias("x"))
            .select(*above, F.col("x.paths").alias("path"), "x.nodes.*"))


def _way_down(subtrees: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths of the lowest nodes of trees whose roots have the paths
    ``tops`` (tree, path and what else to carry)."""
    found = None
    for i in reversed(range(len(levels))):
        above = levels[i].where("n = 0").select("tree", F.col("pos").alias("block")).join(tops, "tree")
        if found is not None:
            above = above.unionByName(found.withColumnRenamed("pos", "block").select(above.columns))
        found = _extracted(_subtrees(levels[i - 1].where("n > 0")) if i else subtrees, above)
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: group, key, leaf, subroot, root, path and the
    carried columns."""
    spark, groups = manifest.groups.sparkSession, manifest.groups
    whole = root(manifest)
    start = spark.createDataFrame([(-1, "", whole)], "tree long, path string, subroot string")
    tops = _way_down(_subtrees(_over_leaves(groups, groups.count())), manifest.over, start)
    tops = tops.select(F.col("pos").alias("tree"), "path", F.col("hash").alias("subroot")).join(groups.select("tree", "group"), "tree")
    found = _way_down(manifest.subtrees, manifest.levels, tops).withColumnRenamed("hash", "leaf")
    return found.drop("tree", "pos").withColumn("root", F.lit(whole))
