"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, secret scans, packing.

Each stage works on all rows that the stage before kept, written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortex.llm import decontaminate, packing, quality_rules, secret_ledger, simhash_bk
from cohortex.llm.common import read, written
from cohortex.llm.queries import vocabulary
from cohortex.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash_bk.one_per_group(docs, shingle=3, max_bits=2)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; the documents stay."""
    return secret_ledger.redacted_documents(docs, scratch_path(spark, f"secret-ledger-{uuid.uuid4().hex}"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.piece_digests(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), length=2048, end_id=1))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark_leaks), ("secret_scans", secrets), ("packing", pack)]

# Vote estimation, XXH64 fingerprints and tokenization have no SQL form: tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
