"""File scans and sinks.

Record batches arrive as JSON lines or CSV with every value possibly a
string; scans therefore read with an explicit schema of STRING columns
(no inference pass over the data) and the lenient parsers of
``cohortex.functions.columns`` type them afterwards.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.operators.categories import SCHEMA as CATEGORY_SCHEMA
from cohortex.operators.categories import Categories, quoted

# Logical table -> physical file stem of the JSON-lines layout
PHYSICAL_NAMES = {
    "people": "prod_clients", "segments": "prizm_segments", "transaction": "prod_financial_transaction",
    "offer": "t_offer", "merchant": "t_merchant", "financial_account": "financial_account",
    "offer_seens": "offer_seens", "offer_activation": "offer_activation", "offer_reward": "offer_reward",
    "receipts": "receipts",
}


def string_schema(columns: list[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if corrupt:
        fields.append(T.StructField("_corrupt_record", T.StringType(), True))
    return T.StructType(fields)


def scan_jsonl(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON lines with a declared all-string schema; malformed lines are
    kept in ``_corrupt_record`` instead of failing the job."""
    return (spark.read.schema(string_schema(columns)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def scan_batches(spark: SparkSession, version_dir: str, table: str, columns: list[str]) -> DataFrame:
    """Un-committed batch files of one table as one multi-file read; the
    batch id comes from the file path, ordered numerically (not as text)."""
    df = (spark.read.schema(string_schema(columns, corrupt=False))
          .json(os.path.join(version_dir, table, "batch_id=*")))
    bid = F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)", 1).cast("int")
    return df.withColumn("batch_id", bid)


def load_table(spark: SparkSession, data_dir: str, table: str, columns: list[str]) -> DataFrame | None:
    """S2 + S3: one table from a folder of JSON-lines files, by its logical
    or its physical name: the committed file ``<name>.jsonl``, else all
    ``<name>_batch_<n>.jsonl`` as one read. ``batch_id`` is ``n`` as a number
    (null for a committed file). None where the folder has neither."""
    for name in dict.fromkeys((table, PHYSICAL_NAMES.get(table, table))):
        for files in (f"{name}.jsonl", f"{name}_batch_*.jsonl"):
            try:
                df = spark.read.schema(string_schema(columns, corrupt=False)).json(os.path.join(data_dir, files))
            except AnalysisException as e:
                if e.getCondition() == "PATH_NOT_FOUND":
                    continue
                raise
            number = F.regexp_extract(F.col("_metadata.file_path"), r"_batch_(\d+)\.jsonl", 1)
            return df.withColumn("batch_id", F.nullif(number, F.lit("")).cast("int"))
    return None


def load_tables(spark: SparkSession, data_dir: str, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """S3: the tables of ``columns`` that ``data_dir`` has; absent ones are left out."""
    found = {name: load_table(spark, data_dir, name, cols) for name, cols in columns.items()}
    return {name: df for name, df in found.items() if df is not None}


def write_batch_files(df: DataFrame, version_dir: str, table: str, batch_col: str = "batch_id") -> None:
    """One JSON-lines folder per batch (``<table>/batch_id=<n>``),
    values as text (NaN as null, S12), the first write of a batch wins (an existing batch
    folder is left alone by the ingest, see ``streaming.ingest``)."""
    cols = [c for c in df.columns if c not in (batch_col, "total_batches")]
    (nan_to_null(df).select(*[quoted(c).cast("string").alias(c) for c in cols], batch_col)
     .write.mode("append").partitionBy(batch_col).json(os.path.join(version_dir, table)))


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S4 + S12: CSV with header, every column as text (no inference)."""
    return (spark.read.schema(string_schema(columns, corrupt=False)).option("header", True)
            .option("mode", "PERMISSIVE").csv(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on floating columns (Spark counts NaN as a value)."""
    return df.withColumns({f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table (partitioned if asked)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_if_absent(df: DataFrame, path: str) -> bool:
    """S8 'save if absent': the first writer wins; returns True if written."""
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException when the path exists
        if "already exists" in str(e) or "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise


def append_report(df: DataFrame, path: str, run_id: str) -> None:
    """Report rows, partitioned by run; a repeated run replaces its rows."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").json(path))


def kept_report(df: DataFrame, path: str, run_id: str) -> DataFrame:
    """Report rows written once and read back, so that what follows
    from them does not compute them again."""
    append_report(df, path, run_id)
    return df.sparkSession.read.schema(df.schema).json(os.path.join(path, f"run_id={run_id}"))


def model_features(features: DataFrame) -> DataFrame:
    """P16/P17 (D6): the numeric projection that feeds models and drift:
    measures narrowed to float/int, ids kept long, text and timestamps left out."""
    cols = []
    for f in features.schema.fields:
        if f.name == "user_id":
            cols.append(F.col(f.name).cast("long"))
        elif isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
            cols.append(quoted(f.name).cast("float").alias(f.name))
        elif isinstance(f.dataType, T.LongType):
            cols.append(quoted(f.name).cast("int").alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.FloatType, T.ShortType, T.ByteType)):
            cols.append(quoted(f.name))
    return features.select(*cols)


def sink_features(features: DataFrame, interactions: DataFrame, out_dir: str, categories: Categories | None = None) -> None:
    """Features and interactions as Parquet, and the dictionary of the
    features' category columns beside them."""
    write_parquet(model_features(features), os.path.join(out_dir, "features.parquet"))
    write_parquet(interactions, os.path.join(out_dir, "interactions.parquet"))
    if categories is not None:
        write_parquet(categories.table(features.sparkSession).coalesce(1), os.path.join(out_dir, "categories.parquet"))


def load_features(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two Parquet tables back."""
    return (spark.read.parquet(os.path.join(out_dir, "features.parquet")),
            spark.read.parquet(os.path.join(out_dir, "interactions.parquet")))


def keep_categories(spark: SparkSession, extend, path: str, version: str) -> Categories:
    """The dictionary over versions: ``extend`` gets what the other versions
    have kept under ``path`` and returns it with its additions, which become
    this version's part (a repeated run replaces that and no other)."""
    schema = CATEGORY_SCHEMA + ", version string"
    try:
        others = Categories.read(spark.read.schema(schema).parquet(path).where(F.col("version") != version))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        others = Categories()
    whole = extend(others)
    added = Categories({k: n for k, n in whole.names.items() if k not in others.names})
    write_parquet(added.table(spark).coalesce(1), os.path.join(path, f"version={version}"))
    return whole


def load_categories(spark: SparkSession, out_dir: str) -> Categories:
    """The dictionary that ``sink_features`` kept; an empty one where it kept none."""
    try:
        return Categories.read(spark.read.parquet(os.path.join(out_dir, "categories.parquet")))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return Categories()
        raise
