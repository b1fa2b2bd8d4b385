"""Idempotent micro-batch ingest, manifest, completeness and commit.

Wire format (one JSON object per line, any number per file):
``{"version", "table", "batch_id", "total_batches", "records": [{...}, ...]}``.

``ingest`` is a Structured Streaming query (file source, ``availableNow``)
over a store that any number of streams may feed, one after the other or at
once. A micro-batch writes what arrived, as it came, into its own folder
``raw/stream_id=<id>/epoch_id=<n>``: a map-only write, no record is
shuffled. Then the arrivals' keys alone decide: of every (version, table,
batch_id) the earliest by file and line, unless any other micro-batch of
any stream has the key already. The winners' rows, written last, are the
micro-batch's part of the manifest, and only arrivals with a manifest row
are read again. So the first write of a batch wins, whatever comes later
and from wherever.

``stream_id`` is the identity that Spark keeps in a checkpoint: the same
after a restart, another one for another checkpoint, also a lost one that
is made anew at the same place. Epoch numbers alone start from 0 in every
checkpoint, so folders named by them would overwrite each other. A replayed
micro-batch replaces its own two folders and no other. Two streams that
take the same key at the same time both write a row; the manifest's readers
then agree on the one with the earlier file.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import partial, reduce
from itertools import pairwise, zip_longest

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.functions import fixed_values as FV
from cohortex.operators.indexing import running_totals, with_row_index

cloudpickle.register_pickle_by_value(sys.modules[__name__])            # executors need not have this package

WIRE_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("batch_id", T.IntegerType()),
    T.StructField("total_batches", T.IntegerType()),
    T.StructField("records", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("_corrupt_record", T.StringType()),      # the text of a malformed line, kept with the rejects
])

KEY = ["version", "table", "batch_id"]
ARRIVAL = ["stream_id", "epoch_id", "source", "block", "line"]        # names one line of one file
_ORDER = ["arrived", "source", "block", "line", "stream_id", "epoch_id"]

MANIFEST_SCHEMA = ("version string, table string, batch_id int, total_batches int, records_count long, content_hash string, "
                   "arrived timestamp, source string, block long, line long, stream_id string, epoch_id long")
RAW_SCHEMA = ("batch_id int, total_batches int, records array<map<string,string>>, records_count long, content_hash string, "
              "arrived timestamp, source string, block long, line long, stream_id string, epoch_id long, version string, table string")
BATCHES_PER_FILE = 200                                                # of a landing folder
RAW_BATCHES = 8                                                       # of a row group: what its writer and a reader hold at once
OPEN_FILES = 64                                                       # of a task that writes arrivals, by version and table
ROWS_PER_FILE = 1_000_000                                             # of a committed table
BROADCAST_BATCHES = 100_000                                           # manifest rows of about 300 bytes


# ------------------------------------------------------------ batch making

def batch_assign(df: DataFrame, batch_size: int, order_col: str = "ordinal") -> DataFrame:
    """Consecutive batch ids of ``batch_size`` rows in ``order_col``
    order, plus ``total_batches``. The order is a distributed range sort and
    the row index comes from per-partition offsets (no single-partition window, no Python rows)."""
    idx = with_row_index(df, "_idx", [order_col])
    total = df.agg(F.count("*")).scalar()
    return (idx.withColumn("batch_id", (F.floor(F.col("_idx") / batch_size) + 1).cast("int"))
            .withColumn("total_batches", F.ceil(total / F.lit(batch_size)).cast("int")).drop("_idx"))


def value_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    return {name: [c for c in df.columns if c != "ordinal"] for name, df in tables.items()}


def numbered_rows(tables: dict[str, DataFrame], batch_size: int) -> DataFrame:
    """Rows of several tables with their batch: (table, batch_id,
    total_batches, place, _0, _1, ...), the values as text in the order of
    the table's columns. One sort by ``ordinal``, ties by values, numbers the
    rows of all tables; they are kept, and ``place`` counts a batch's rows from 0."""
    columns = value_columns(tables)
    places = [f"_{i}" for i in range(max(len(c) for c in columns.values()))]
    no = F.lit(None).cast("string")
    parts = [df.select(F.lit(name).alias("table"), "ordinal",
                       *[(F.col(c).cast("string") if c else no).alias(p) for c, p in zip_longest(columns[name], places)])
             for name, df in tables.items()]
    rows = with_row_index(reduce(DataFrame.unionByName, parts), "_at", ["table", "ordinal", *places], packed=True)
    first = rows.groupBy("table").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))     # one row per table
    at = F.col("_at") - F.col("_first")
    return (rows.join(F.broadcast(first), "table")
            .select("table", (F.floor(at / batch_size) + 1).cast("int").alias("batch_id"),
                    F.ceil(F.col("_n") / batch_size).cast("int").alias("total_batches"),
                    (at % batch_size).alias("place"), *places))


def batches_of(numbered: DataFrame, columns: dict[str, list[str]], version: str) -> DataFrame:
    """Rows by ``numbered_rows``, all or some, -> wire batches. They travel
    as compressed pieces of batches, and get their columns' names where a
    batch is put together."""
    pieces = numbered.mapInArrow(_pieces, "table string, batch_id int, total_batches int, place long, rows binary")
    batches = (pieces.groupBy("table", "batch_id", "total_batches")
               .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "rows"))), lambda x: x["rows"]).alias("pieces")))
    return (batches.mapInArrow(partial(_put_together, columns=columns), "table string, batch_id int, total_batches int, "
                               "records array<map<string,string>>")
            .select(F.lit(version).alias("version"), "table", "batch_id", "total_batches", "records"))


def to_wires(tables: dict[str, DataFrame], version: str, batch_size: int) -> DataFrame:
    """Rows of several tables -> wire batches (one row per batch, records as
    string maps, at most ``batch_size`` of them, in ``ordinal`` order, ties
    by their values)."""
    return batches_of(numbered_rows(tables, batch_size), value_columns(tables), version)


def _pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by ``numbered_rows`` -> those of a batch that follow each other, as one compressed piece."""
    for b in rows:
        if not b.num_rows:
            continue
        table, batch, place = (b.column(i) for i in (0, 1, 3))
        new = ((np.diff(place.to_numpy()) != 1) | (np.diff(batch.to_numpy()) != 0)
               | (np.diff(table.dictionary_encode().indices.to_numpy()) != 0))
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        values = pa.RecordBatch.from_arrays(b.columns[4:], names=b.schema.names[4:])
        packed = []
        for lo, hi in pairwise(starts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, values.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(values.slice(lo, hi - lo))
            packed.append(sink.getvalue().to_pybytes())
        heads = pa.RecordBatch.from_arrays(b.columns[:4], names=b.schema.names[:4]).take(pa.array(starts[:-1]))
        yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(packed, pa.binary())], names=[*heads.schema.names, "rows"])


def _put_together(batches: Iterator[pa.RecordBatch], columns: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    """(table, batch_id, total_batches, pieces) -> the same with records, a batch at a time."""
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            names = columns[one.column(0)[0].as_py()]
            t = pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in one.column(3)[0]])
            k, n = len(names), t.num_rows
            by_column = pa.concat_arrays([c for j in range(k) for c in t.column(j).cast(pa.string()).chunks])
            values = by_column.take(pa.array(np.arange(k * n).reshape(k, n).T.ravel()))
            keys = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(k), n)))
            records = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), keys, values)
            yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), records)],
                                             names=["table", "batch_id", "total_batches", "records"])


def to_wire(df: DataFrame, version: str, table: str, batch_size: int) -> DataFrame:
    """Rows of one table -> wire batches."""
    return to_wires({table: df}, version, batch_size)


def write_landing(wire: DataFrame, landing_dir: str) -> None:
    """Append wire batches as compressed JSON-lines files to the landing
    folder. Such a file is read by one task, so it has a bounded number of batches."""
    (wire.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", BATCHES_PER_FILE)
     .json(landing_dir))


# ------------------------------------------------------------------ ingest

def _sorted_record(m):
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def content_hash(records_col: str = "records"):
    """P20: md5 of the batch's records with keys sorted."""
    return F.md5(F.to_json(F.transform(F.col(records_col), _sorted_record)))


def _stream_folder(store_dir: str, kind: str, stream_id: str, epoch_id: int) -> str:
    return os.path.join(store_dir, kind, f"stream_id={stream_id}", f"epoch_id={epoch_id}")


def _process(batch: DataFrame, epoch_id: int, store_dir: str) -> None:
    spark = batch.sparkSession                                                # the stream's own
    # a task writes the files of its tables side by side: sorting whole batches by table would spill them
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES)
    stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    folder = lambda kind: _stream_folder(store_dir, kind, stream_id, epoch_id)
    valid = F.col("table").isin(*FV.TABLE_NAMES) & (F.col("batch_id") >= 1) & (F.col("total_batches") >= 1)
    # ascending within a block of a file; asked before any filter, so that it does not move with one
    arrived = batch.withColumn("line", F.monotonically_increasing_id())
    (arrived.where(~valid | valid.isNull()).drop("block", "line", "arrived").withColumnRenamed("_corrupt_record", "malformed")
     .write.mode("overwrite").option("compression", "gzip").json(folder("rejected")))
    (arrived.where(valid)
     .withColumns({"records_count": F.coalesce(F.size("records").cast("long"), F.lit(0).cast("long")), "content_hash": content_hash()})
     .drop("_corrupt_record").write.mode("overwrite").option("compression", "zstd")
     .option("parquet.block.row.count.limit", RAW_BATCHES)
     .partitionBy("version", "table").parquet(folder("raw")))
    # from here on keys only: no record is read again; min_by combines map-side, so a batch that
    # is re-sent a million times reaches its reducer as one row per task
    keys = (spark.read.schema(RAW_SCHEMA).option("basePath", os.path.join(store_dir, "raw")).parquet(folder("raw"))
            .drop("records"))
    mine = ((F.col("stream_id") == stream_id) & (F.col("epoch_id") == epoch_id))
    seen = _manifest_rows(spark, store_dir).where(~mine).select(*KEY)
    first = _first_of_key(keys).join(seen, KEY, "left_anti").drop("stream_id", "epoch_id")
    first.write.mode("overwrite").parquet(folder("manifest"))


def _first_of_key(rows: DataFrame) -> DataFrame:
    """The manifest row of every key: its earliest arrival."""
    rest = [f.name for f in T.StructType.fromDDL(MANIFEST_SCHEMA) if f.name not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct(*_ORDER)).alias("b")).select(*KEY, "b.*")


def _manifest_rows(spark: SparkSession, store_dir: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(os.path.join(store_dir, "manifest"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":                              # the store's first micro-batch
            return spark.createDataFrame([], MANIFEST_SCHEMA)
        raise


def ingest(spark: SparkSession, landing_dir: str, store_dir: str, checkpoint: str,
           max_files_per_trigger: int = 1000):
    """Run the ingest stream over everything in ``landing_dir`` and stop
    (``availableNow``), ``max_files_per_trigger`` files to a micro-batch;
    returns the finished StreamingQuery."""
    reader = spark.readStream.schema(WIRE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    src = (reader.json(landing_dir)
           .withColumn("source", F.col("_metadata.file_path"))
           .withColumn("block", F.col("_metadata.file_block_start"))
           .withColumn("arrived", F.col("_metadata.file_modification_time")))
    q = (src.writeStream.foreachBatch(lambda df, eid: _process(df, eid, store_dir))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_manifest(spark: SparkSession, store_dir: str) -> DataFrame:
    """One row per accepted batch."""
    return _first_of_key(_manifest_rows(spark, store_dir))


def read_rejected(spark: SparkSession, store_dir: str) -> DataFrame:
    """the lines that name no known table, have an id or a total below
    1, or are no JSON (their text is ``malformed``)."""
    fields = [f.simpleString().replace(":", " ", 1) for f in WIRE_SCHEMA if f.name != "_corrupt_record"]
    schema = ", ".join([*fields, "malformed string", "source string", "stream_id string", "epoch_id long"])
    return spark.read.schema(schema).json(os.path.join(store_dir, "rejected"))


def read_batches(spark: SparkSession, store_dir: str, manifest: DataFrame, n_batches: int) -> DataFrame:
    """The accepted arrivals of the ``n_batches`` rows of ``manifest``, with
    its columns and ``records``. A manifest of a checked size goes to the
    records; a larger one meets them by key."""
    raw = spark.read.schema(RAW_SCHEMA).parquet(os.path.join(store_dir, "raw")).select(*KEY, *ARRIVAL, "records")
    return raw.join(F.broadcast(manifest) if n_batches <= BROADCAST_BATCHES else manifest, [*KEY, *ARRIVAL])


# ------------------------------------------------------- manifest queries

def batch_manifest(manifest: DataFrame) -> DataFrame:
    """A24 + I2: per (version, table): batches, records, declared total and
    how many of the ids 1..total_batches are missing."""
    return (manifest.groupBy("version", "table").agg(
        F.count_distinct("batch_id").alias("n_batches"),
        F.sum("records_count").alias("n_records"),
        F.max("total_batches").alias("total_batches"))
        .withColumn("n_missing", F.greatest(F.col("total_batches") - F.col("n_batches"), F.lit(0))))


def missing_batches(manifest: DataFrame) -> DataFrame:
    """The missing batch ids as rows (version, table, batch_id)."""
    declared = (manifest.groupBy("version", "table").agg(F.max("total_batches").alias("t"))
                .select("version", "table", F.explode(F.sequence(F.lit(1), F.col("t"))).alias("batch_id")))
    return declared.join(manifest.select("version", "table", "batch_id"), ["version", "table", "batch_id"],
                         "left_anti")


def version_completeness(manifest: DataFrame, expected=tuple(FV.COMPLETE_VERSION_TABLES)) -> DataFrame:
    """I3 + J16: per version, whether every expected table has a batch."""
    versions = manifest.select("version").distinct()
    got = manifest.select("version", "table").distinct()
    wanted = versions.select("version", F.explode(F.array(*[F.lit(t) for t in expected])).alias("table"))
    missing = wanted.join(got, ["version", "table"], "left_anti")
    miss = missing.groupBy("version").agg(F.sort_array(F.collect_list("table")).alias("missing_tables"))
    recv = got.groupBy("version").agg(F.count("*").alias("n_tables"))
    return (versions.join(recv, "version", "left").join(miss, "version", "left")
            .select("version", F.coalesce("n_tables", F.lit(0)).alias("n_tables"),
                    F.coalesce("missing_tables", F.array().cast("array<string>")).alias("missing_tables"))
            .withColumn("is_complete", F.size("missing_tables") == 0))


def _values(records: str, cols: list[str]):
    """The records of a batch without their names: an array of values, by ``cols``, for each."""
    return F.transform(records, lambda record: F.array(*[record[c] for c in cols]))


def commit_version(spark: SparkSession, store_dir: str, version: str, out_dir: str,
                   columns: dict[str, list[str]]) -> DataFrame:
    """I4 + U2 + T5: snapshot of one version, one Parquet table per logical
    table in (batch_id, position) order.

    ``ordinal`` counts a table's rows from 0: the manifest's running totals
    give every batch its first one, so batches go straight to the file that
    holds their place, ``ROWS_PER_FILE`` rows each, and files follow each
    other as their batches do. The commit manifest (table, total_records,
    n_batches) is written last, after the order is checked, and freezes the
    version: a later commit of it changes nothing and returns the same
    manifest, while a commit that broke off is repeated."""
    done = committed_manifest(spark, out_dir, version)
    if done is not None:
        return done
    folder = os.path.join(out_dir, f"version={version}")
    manifest = read_manifest(spark, store_dir).where(F.col("version") == version)
    placed = running_totals(manifest, ["table", "batch_id"], "records_count", "before", "row")
    starts = placed.groupBy("table").agg(F.min("before").alias("start"), F.sum("records_count").alias("total_records"),
                                         F.count("*").alias("n_batches")).checkpoint()            # one row per table
    placed = placed.join(F.broadcast(starts), "table").withColumn("first", F.col("before") - F.col("start")).checkpoint()
    of_table = {r["table"]: r for r in starts.collect()}
    for table, cols in columns.items():
        total, n_batches = (of_table[table]["total_records"], of_table[table]["n_batches"]) if table in of_table else (0, 0)
        batches = read_batches(spark, store_dir, placed.where(F.col("table") == table), n_batches)
        files = max(1, -(-total // ROWS_PER_FILE))
        at = F.floor(F.col("first") / ROWS_PER_FILE).cast("int")
        (batches.select("batch_id", "first", _values("records", cols).alias("records"))
         .repartitionById(files, at).sortWithinPartitions("first")
         .select("batch_id", "first", F.posexplode_outer("records").alias("pos", "record")).where(F.col("pos").isNotNull())
         .select(*[F.col("record")[i].alias(c) for i, c in enumerate(cols)], "batch_id", (F.col("first") + F.col("pos")).alias("ordinal"))
         .write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(folder, f"table={table}")))
        _check_order(read_committed(spark, out_dir, version, table), total, table)
    (starts.select("table", "total_records", "n_batches").coalesce(1)
     .write.mode("overwrite").parquet(os.path.join(folder, "manifest")))
    return committed_manifest(spark, out_dir, version)


def _check_order(snapshot: DataFrame, rows: int, table: str) -> None:
    """Raises unless every file holds consecutive ordinals and the files
    together 0 to ``rows`` - 1, once each."""
    exact = F.col("ordinal").cast("decimal(38,0)")
    files = (snapshot.groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.sum(exact).alias("s")))
    apart = (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (2 * F.col("s") != (F.col("lo") + F.col("hi")) * F.col("n"))
    bad, n, lo, hi, total = files.agg(F.count_if(apart), F.sum("n"), F.min("lo"), F.max("hi"), 2 * F.sum("s")).first()
    if rows and (bad or n != rows or lo != 0 or hi != rows - 1 or total != (rows - 1) * rows):
        raise ValueError(f"table {table!r}: {n} committed rows of {rows}, or not in order")


def committed_manifest(spark: SparkSession, out_dir: str, version: str) -> DataFrame | None:
    """The manifest of a committed version; None before its commit."""
    try:
        return spark.read.parquet(os.path.join(out_dir, f"version={version}", "manifest"))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_committed(spark: SparkSession, out_dir: str, version: str, table: str) -> DataFrame:
    """One committed table of a version."""
    return spark.read.parquet(os.path.join(out_dir, f"version={version}", f"table={table}"))
