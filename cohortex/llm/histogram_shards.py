"""Sharding by histogram sort: near equal bytes after one exchange.

Rows are ordered by (hash of the text, doc_id), a pure function of the
row, so equal texts are neighbours. Splitters between shards are found by
counting: each round sums, over all partitions, the exact bytes below a
few candidate boundaries per splitter, and keeps the interval around its
target, until the bytes below miss the target by at most ``tolerance`` of
a shard or no key lies between. A round returns two numbers per probe.
Rows then move once, in a range sort by shard and key.

Law: ``bytes``. A shard's bytes miss an equal share by at most the
tolerance at either end, or by one row's bytes where a row is larger. Equal
texts are neighbours but not kept together: a group of them that a splitter
falls into, as any group larger than a shard, lies in several shards.

Defined results: a null text has size 1 and the CRC of the empty text; a
null doc_id sorts first; rows equal in text and doc_id share a shard; an
empty table gives an empty result; other columns are not read by
``shard_plan`` and are carried by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.llm.common import reliable, whole_text
from cohortex.operators.indexing import with_row_index

_LOW = -(1 << 63)
_SPAN = 1 << 64


def _key_columns() -> tuple[Column, Column]:
    return F.xxhash64(whole_text()), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))


def _pair(key: int) -> tuple[int, int]:
    return (key >> 64) + _LOW, (key & (_SPAN - 1)) + _LOW


def _below(key: int) -> Column:
    a, b = _pair(key)
    return (F.col("_k1") < a) | ((F.col("_k1") == a) & (F.col("_k2") < b))


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 15, few: int = 256) -> list[int]:
    """Ascending 128-bit boundaries for ``keys`` (_k1, _k2, size).

    An interval with at most ``few`` rows is not cut evenly any more: its
    own keys become the candidates, so a round later it is exact."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    top = _SPAN * _SPAN - 1
    # a bound is (key, bytes below it, rows below it)
    state = [{"goal": total * i / shards, "lo": (0, 0, 0), "hi": (top, total, rows)} for i in range(1, shards)]
    slack = tolerance * total / shards

    def best(s):
        return min((s["lo"], s["hi"]), key=lambda x: abs(x[1] - s["goal"]))

    def open_(s):
        return (s["hi"][0] - s["lo"][0] > 1 and s["hi"][2] > s["lo"][2] and not s.get("listed")
                and abs(best(s)[1] - s["goal"]) > slack)

    def narrow(key, below, count):
        for s in state:
            if below <= s["goal"] and key > s["lo"][0]:
                s["lo"] = (key, below, count)
            elif below > s["goal"] and key < s["hi"][0]:
                s["hi"] = (key, below, count)

    while active := [s for s in state if open_(s)]:
        short = [s for s in active if s["hi"][2] - s["lo"][2] <= few]
        if short:
            inside = F.lit(False)
            for s in short:
                inside = inside | (~_below(s["lo"][0]) & _below(s["hi"][0]))
            listed = sorted(((r[0] - _LOW) * _SPAN + (r[1] - _LOW), r[2], r[3])          # at most shards x few keys
                            for r in keys.where(inside).groupBy("_k1", "_k2").agg(F.sum("size"), F.count("*")).collect())
            for s in short:
                (start, below, count), end = s["lo"], s["hi"][0]
                for key, size, n in listed:
                    if start <= key < end:
                        below, count = below + size, count + n
                        narrow(key + 1, below, count)
                s["listed"] = True
            continue
        asked = sorted({s["lo"][0] + (s["hi"][0] - s["lo"][0]) * j // (probes + 1)
                        for s in active for j in range(1, probes + 1)})
        row = keys.agg(*[F.sum(F.when(_below(k), x).otherwise(0)) for k in asked for x in (F.col("size"), F.lit(1))]).first()
        for i, k in enumerate(asked):
            narrow(k, row[2 * i], row[2 * i + 1])
    return [best(s)[0] for s in state]


def _shard(cuts: list[int]) -> Column:
    out = F.lit(0)
    for k in cuts:
        out = out + F.when(_below(k), 0).otherwise(1)
    return out.cast("int")


def _light(docs: DataFrame) -> DataFrame:
    k1, k2 = _key_columns()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("_k1"), k2.alias("_k2"),
                       (F.octet_length(whole_text()).cast("long") + 1).alias("size"),
                       F.crc32(whole_text()).alias("text_crc32"))


def shard_plan(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    d = reliable(_light(docs))
    placed = d.withColumn("shard", _shard(splitters(d, shards, tolerance)))
    rows = with_row_index(placed, "_at", [F.col("shard"), F.col("_k1"), F.col("_k2")])
    first = rows.groupBy("shard").agg(F.min("_at").alias("_first"))          # one row per shard
    return (rows.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot")))


def sharded(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """``docs`` with column ``shard``, range-sorted by shard and key: write
    it with ``partitionBy("shard")`` for one folder per shard."""
    cuts = splitters(reliable(_light(docs).select("_k1", "_k2", "size")), shards, tolerance)
    k1, k2 = _key_columns()
    return (docs.withColumn("_k1", k1).withColumn("_k2", k2).withColumn("shard", _shard(cuts))
            .orderBy("shard", "_k1", "_k2").drop("_k1", "_k2"))
