"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.operators.categories import quoted
from cohortex.session import checkpoint_dir, scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and
    read again: cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reliable(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the session's shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def row_of(docs: DataFrame):
    """All columns of a row as one, so that no name of theirs can clash with
    an operator's own or be read as a path; ``rows_of`` takes it apart."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("row")


def rows_of(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def whole_text(name: str = "text"):
    """The text as a column in which null means the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
