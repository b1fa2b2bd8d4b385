"""Population Stability Index drift.

All columns are handled together: the reference side is unpivoted to
(column, value) rows and counted once, its decile edges and its rows per bin
come from those counts, and the current side is one scan that looks its
bins up in the broadcast (columns x 11) edge table. What a run needs of the
reference is a snapshot, a row of edges and counts per column: it is kept
when the reference is replaced, and a later run scans its own side only.
The snapshot and the bin counts are bounded by columns x bins, so they are
resolved once and reused as literals. Nothing per column runs on the driver.

Scale: the edges are exact order statistics at any size. The distinct
values of all columns, with their counts, are range-sorted over the
cluster; sums per sorted partition say in which partition each wanted
position lies, and only those partitions are counted through. The value
counts of two references add up, so a reference can be extended by new
rows without reading its old ones (``merged_counts``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.functions import fixed_values as FV
from cohortex.operators.categories import quoted
from cohortex.session import checkpoint_dir


def common_numeric_columns(reference: DataFrame, current: DataFrame, exclude=("user_id",)) -> list[str]:
    """P18 + U5: numeric (non-boolean) columns present on both sides."""
    ref_cols = set(reference.columns)
    return [f.name for f in current.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name in ref_cols and f.name not in exclude]


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    wide = df.select(*[quoted(c).cast("double").alias(c) for c in cols])
    return (wide.unpivot([], [quoted(c) for c in cols], "column_name", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, c): how often each column has each value."""
    return _long(df, cols).groupBy("column_name", "value").agg(F.count("*").alias("c"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """The value counts of several tables together."""
    return reduce(DataFrame.unionByName, parts).groupBy("column_name", "value").agg(F.sum("c").alias("c"))


def reference_edges(counts: DataFrame, n_buckets: int = FV.PSI_BUCKETS) -> DataFrame:
    """(column_name, edges, n_ref) with deduplicated decile edges."""
    # numpy.unique: sorted distinct values
    return _linear_edges(_placed(counts), n_buckets).select(
        "column_name", F.array_sort(F.array_distinct("raw")).alias("edges"), "n_ref")


def percent_points(n_buckets: int) -> list[float]:
    """The quantile levels, computed exactly as the reference's call does:
    ``linspace(0, 100, B + 1) / 100``."""
    return (np.linspace(0, 100, n_buckets + 1) / 100).tolist()


def _placed(counts: DataFrame) -> DataFrame:
    """Value counts range-sorted and written once, so that a repeated task
    sees the same partitions; a block is what one sorted partition has of
    one column."""
    checkpoint_dir(counts.sparkSession)
    return counts.orderBy("column_name", "value").withColumn("block", F.spark_partition_id()).checkpoint()


def _linear_edges(vc: DataFrame, n_buckets: int) -> DataFrame:
    """Exact linear-interpolated quantiles, bit-identical to numpy's
    ``percentile(..., method='linear')``: virtual index v = (n-1)*q,
    neighbours floor(v) and floor(v)+1 (both the last one when v >= n-1),
    and numpy's two-sided lerp (a + (b-a)*t, or b - (b-a)*(1-t) when t >= 0.5).

    The order statistics come from sorted value counts: a block's rows are
    summed, the sums' running totals locate each of the <= 2(B+1) positions
    of a column in a block, and the running count goes through those blocks
    alone. Returns (column_name, raw, n_ref)."""
    blocks = vc.groupBy("column_name", "block").agg(F.sum("c").alias("size"))     # <= #partitions + #columns rows
    before = Window.partitionBy("column_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    n = blocks.groupBy("column_name").agg(F.sum("size").alias("n"))
    last = F.col("n") - 1
    targets = (n.select("column_name", "n", F.posexplode(F.array(*[F.lit(q) for q in percent_points(n_buckets)]))
                        .alias("i", "q"))
               .withColumn("v", last.cast("double") * F.col("q"))
               .withColumn("top", F.col("v") >= last.cast("double"))
               .withColumn("prev", F.when(F.col("top"), last).otherwise(F.floor("v")))
               .withColumn("next", F.when(F.col("top"), last).otherwise(F.floor("v") + 1))
               .withColumn("gamma", F.col("v") - F.floor("v")))

    # both neighbours of every target, with the block they lie in: (#columns x 2(B+1)) rows
    wanted = (targets.select("column_name", "i", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("prev").alias("pos")),
        F.struct(F.lit("b").alias("side"), F.col("next").alias("pos")))).alias("t"))
        .select("column_name", "i", "t.side", "t.pos").join(blocks, "column_name")
        .where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("size")))
        .select("column_name", "block", "first", "i", "side", "pos"))
    inside = vc.join(F.broadcast(wanted.select("column_name", "block", "first").distinct()), ["column_name", "block"])
    running = F.sum("c").over(Window.partitionBy("column_name", "block").orderBy("value")
                              .rowsBetween(Window.unboundedPreceding, 0))
    ranges = (inside.withColumn("end", F.col("first") + running).withColumn("start", F.col("end") - F.col("c"))
              .select("column_name", "block", "value", "start", "end"))
    found = (ranges.join(F.broadcast(wanted.drop("first")), ["column_name", "block"])
             .where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
             .groupBy("column_name", "i").pivot("side", ["a", "b"]).agg(F.first("value")))
    a, b, t = F.col("a"), F.col("b"), F.col("gamma")
    lerp = F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)
    pts = (targets.select("column_name", "i", "gamma", "n").join(found, ["column_name", "i"])
           .select("column_name", "n", lerp.alias("edge")))
    return pts.groupBy("column_name").agg(F.collect_list("edge").alias("raw"), F.first("n").alias("n_ref"))


def _bin(value, edges, max_edges: int):
    """Left-closed bins, last bin right-closed, out-of-range -> NULL.

    The bin is the number of inner edges <= value, written as a sum over
    the (at most B+1) fixed positions so it stays inside whole-stage codegen."""
    last = F.element_at(edges, -1)
    n = F.size(edges)
    inner = [F.when((F.lit(i) < n) & (F.try_element_at(edges, F.lit(i)) <= value), 1).otherwise(0)
             for i in range(2, max_edges)]
    below = sum(inner[1:], inner[0]) if inner else F.lit(0)
    return (F.when((value < F.element_at(edges, 1)) | (value > last), F.lit(None))
            .when(value == last, n - 2)
            .otherwise(below))


SNAPSHOT = "column_name string, edges array<double>, n_ref long, bins array<long>"


def reference_snapshot(reference: DataFrame, columns: list[str], n_buckets: int = FV.PSI_BUCKETS,
                       counts: DataFrame | None = None) -> DataFrame:
    """(column_name, edges, n_ref, bins), one row per column: all that a
    run needs of its reference. A column without a value has no edges.
    ``counts`` are the reference's value counts, where they are kept."""
    spark = reference.sparkSession
    if not columns:
        return spark.createDataFrame([], SNAPSHOT)
    vc = _placed(value_counts(reference, columns) if counts is None else counts)
    raw = _linear_edges(vc, n_buckets).select("column_name", F.array_sort(F.array_distinct("raw")).alias("edges"), "n_ref")
    edges = _literal(raw.select("column_name", "edges"), "column_name string, edges array<double>")
    bins = _bin_counts(vc.select("column_name", "value", "c"), edges, n_buckets)
    total = vc.groupBy("column_name").agg(F.sum("c").alias("n_ref"))
    named = spark.createDataFrame([(c,) for c in columns], "column_name string")
    return (named.join(edges, "column_name", "left").join(total, "column_name", "left").join(bins, "column_name", "left")
            .select("column_name", F.coalesce("edges", F.array().cast("array<double>")).alias("edges"),
                    F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("bins", F.array().cast("array<long>")).alias("bins")))


def _literal(df: DataFrame, schema: str) -> DataFrame:
    """A table of columns x bins, resolved once instead of at each use."""
    return df.sparkSession.createDataFrame([tuple(r) for r in df.collect()], schema)


def _bin_counts(rows: DataFrame, edges: DataFrame, n_buckets: int) -> DataFrame:
    """(column_name, bins), the rows ``c`` per bin; rows outside the
    edges count in none."""
    n = (rows.join(F.broadcast(edges), "column_name")
         .groupBy("column_name", _bin(F.col("value"), F.col("edges"), n_buckets + 1).alias("bin")).agg(F.sum("c").alias("n"))
         .where(F.col("bin").isNotNull()).groupBy("column_name").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")))
    size = F.greatest(F.size("edges") - 1, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return edges.join(n, "column_name").select("column_name", F.slice(each, F.lit(1), size).alias("bins"))


def psi_against(snapshot: DataFrame, current: DataFrame, columns: list[str] | None = None,
                n_buckets: int = FV.PSI_BUCKETS, threshold: float = FV.PSI_THRESHOLD) -> DataFrame:
    """A20 per column of a kept reference: (column_name, psi, drifted).

    PSI = sum over bins of (c - r) * ln(c / r) with r = (n_r + 1) / (N_r + B)
    and c = (n_c + 1) / (N_c + B), B = ``n_buckets`` even when edges collapse;
    fewer than two distinct edges or an empty side -> 0. ``columns`` defaults
    to those that both sides have.
    """
    snapshot = _literal(snapshot.select("column_name", "edges", "n_ref", "bins"), SNAPSHOT)            # columns x bins
    if columns is None:
        kept = {r["column_name"] for r in snapshot.select("column_name").collect()}
        columns = [c for c in common_numeric_columns(current, current) if c in kept]
    spark = current.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string, psi double, drifted boolean")
    snapshot = snapshot.where(F.col("column_name").isin(columns))
    rows = _long(current, columns).join(F.broadcast(snapshot.select("column_name", "edges").withColumnRenamed("column_name", "col")),
                                        F.col("column_name") == F.col("col"))
    binned = (rows.groupBy("column_name", F.when(F.size("edges") > 1, _bin(F.col("value"), F.col("edges"), n_buckets + 1)).alias("bin"))
              .agg(F.count("*").alias("n")))                                                           # one scan; columns x bins rows
    counts = _literal(binned, "column_name string, bin int, n long")
    side = counts.groupBy("column_name").agg(F.sum("n").alias("n_cur"), F.map_from_entries(F.collect_list(
        F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"))
    b = float(n_buckets)
    term = (snapshot.where(F.size("edges") > 1).join(side, "column_name")
            .select("column_name", "n_ref", "n_cur", "m", F.posexplode("bins").alias("bin", "n_r"))
            .select("column_name", ((F.col("n_r") + 1) / (F.col("n_ref") + b)).alias("r"),
                    ((F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)) + 1) / (F.col("n_cur") + b)).alias("c")))
    psi = term.groupBy("column_name").agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))
    all_cols = spark.createDataFrame([(c,) for c in columns], "column_name string")
    return (all_cols.join(psi, "column_name", "left")
            .select("column_name", F.coalesce("psi", F.lit(0.0)).alias("psi"))
            .withColumn("drifted", F.col("psi") > F.lit(threshold)))


def psi_by_column(reference: DataFrame, current: DataFrame, columns: list[str] | None = None,
                  n_buckets: int = FV.PSI_BUCKETS, threshold: float = FV.PSI_THRESHOLD) -> DataFrame:
    """``psi_against`` a snapshot made of ``reference`` for this one time."""
    cols = common_numeric_columns(reference, current) if columns is None else columns
    return psi_against(reference_snapshot(reference, cols, n_buckets), current, cols, n_buckets, threshold)


def drift_report(psi: DataFrame, threshold: float = FV.PSI_THRESHOLD, model_exists: bool = False,
                 reference_version: str | None = None) -> DataFrame:
    """A21 + F7 + F8 + F12: one run row from the per-column PSI rows."""
    share = F.try_divide(F.count_if("drifted"), F.count("*"))
    mean = F.avg("psi")
    detected = (F.coalesce(share, F.lit(0.0)) > FV.DRIFT_SHARE_LIMIT) | (F.coalesce(mean, F.lit(0.0))
                                                                          > FV.DRIFT_MEAN_LIMIT)
    return psi.agg(
        detected.alias("drift_detected"),
        F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("drift_score"),
        F.round(F.coalesce(share, F.lit(0.0)), 4).alias("drift_share"),
        F.lit(threshold).alias("threshold"),
        F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("column_name")))).alias("drifted_columns"),
        F.count("*").alias("n_columns_total"),
        F.count_if("drifted").alias("n_columns_drifted"),
        F.lit(reference_version).cast("string").alias("reference_version"),
        (detected | F.lit(not model_exists)).alias("retrain"))


def drift_summary(report: DataFrame, max_columns: int = 5) -> DataFrame:
    """The run row with at most ``max_columns`` drifted column names."""
    return report.select("drift_detected", "drift_score", "drift_share", "threshold",
                         F.slice("drifted_columns", 1, max_columns).alias("drifted_columns"),
                         (F.when(F.col("drift_detected"), F.lit("retrained")).otherwise(F.lit("none")))
                         .alias("action_taken"))
