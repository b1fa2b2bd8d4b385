"""Consecutive row numbers without a single-partition window or Python rows.

``monotonically_increasing_id`` is (partition id << 33) + position inside
the partition. Rows are numbered once, written with a reliable checkpoint
(so a recomputation after executor loss cannot renumber them), the row
count of every partition is taken (one small aggregate, <= #partitions
rows) and the running offsets are joined back as a broadcast of that
bounded table. Everything runs on the executors, in the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.session import checkpoint_dir, scratch_path

_LOW_BITS = (1 << 33) - 1


def with_row_index(df: DataFrame, name: str = "row_idx", order_by: list | None = None, packed: bool = False) -> DataFrame:
    """``df`` plus a 0-based consecutive ``name`` column; in ``order_by``
    order when given (a distributed range sort), else in partition order.
    ``packed``: the numbered rows are kept as compressed Parquet beside the
    checkpoints, which hold rows as they are in memory."""
    checkpoint_dir(df.sparkSession)
    d = df.orderBy(*order_by) if order_by else df
    d = (d.withColumn("_pid", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    if packed:
        path = scratch_path(df.sparkSession, f"numbered-{uuid.uuid4().hex}")
        d.write.option("compression", "zstd").parquet(path)
        d = df.sparkSession.read.schema(d.schema).parquet(path)
    else:
        d = d.checkpoint()
    counts = d.groupBy("_pid").agg(F.count("*").alias("_n"))           # <= #partitions rows
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (d.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off"))


def positions_within(df: DataFrame, group: str, order_by: list, name: str = "position") -> DataFrame:
    """1-based position of every row inside its ``group`` in ``order_by``
    order, for groups of any size: a hot group is spread over several
    range partitions by the global sort, and only its first index is
    aggregated (map-side) and joined back."""
    idx = with_row_index(df, "_g", [F.col(group)] + list(order_by))
    first = idx.groupBy(group).agg(F.min("_g").alias("_first"))
    return idx.join(first, group).withColumn(name, (F.col("_g") - F.col("_first") + 1).cast("int")) \
        .drop("_g", "_first")


BLOCK = 1024                                        # rows that one window of running_totals holds


def running_totals(df: DataFrame, order_by: Sequence[Column | str], size: str, before: str, row: str) -> DataFrame:
    """``df`` range-sorted by ``order_by`` with ``before``, the total of the
    whole number ``size`` over the rows before it, and ``row``, a number for
    the row that ascends in this order.

    Totals inside blocks of rows, of the blocks before in the partition, and
    of the partitions before add up: no window holds more than a block, a
    partition's blocks, or one row per partition."""
    checkpoint_dir(df.sparkSession)
    d = (df.orderBy(*order_by).withColumns({"_pid": F.spark_partition_id(), row: F.monotonically_increasing_id()})
         .checkpoint())
    d = d.withColumn("_block", F.floor(F.col(row).bitwiseAND(F.lit(_LOW_BITS)) / BLOCK))
    blocks = d.groupBy("_pid", "_block").agg(F.sum(size).alias("_sum"))
    parts = blocks.groupBy("_pid").agg(F.sum("_sum").alias("_all"))                         # <= #partitions rows
    parts = parts.select("_pid", (F.sum("_all").over(Window.orderBy("_pid")) - F.col("_all")).alias("_part"))
    earlier = Window.partitionBy("_pid").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks.withColumn("_prior", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
              .join(F.broadcast(parts), "_pid").select("_pid", "_block", (F.col("_prior") + F.col("_part")).alias("_offset")))
    inside = Window.partitionBy("_pid", "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(blocks, ["_pid", "_block"])
            .withColumn(before, (F.col("_offset") + F.col("_inside")).cast("long"))
            .drop("_pid", "_block", "_offset", "_inside"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, of: str, row: str, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of their group: the row of ``groups`` whose
    ``of`` equals ``key``, null included. The rows of one group are dealt to
    ``salts`` tasks by their number ``row``, and ``groups``, one row per
    value, is repeated as often."""
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("_salt", F.pmod(F.col(row), F.lit(salts)).cast("int"))
            .join(dealt, "_salt").where(F.col(key).eqNullSafe(F.col(of))).drop("_salt", of))
