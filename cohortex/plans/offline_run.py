"""One version, end to end, in the stage order of the offline run:
validate -> features + interactions -> drift against the stored reference
-> retrain decision -> ALS train + save -> evaluate -> reports.

Every stage is a DataFrame job; intermediate results that later stages
read several times (features, interactions, reports) are written under
``out_dir`` and read back, so nothing is computed twice and the lineage is
cut before ALS. Only one-row decisions (validity, retrain) reach the driver.
Tables that joins make are written before the first version (``keep_tables``):
validation, categories and features of every version read them back.

What versions share grows and never changes what it has: the dictionary of
category columns, the numbers of known offers and merchants, and the id
maps of the model have a folder per version with what that version added.
The drift reference is a snapshot in a folder of its own; a row appended
last names the folder that counts, so there is a whole reference at any
time, also when a run breaks off while it replaces it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.functions import fixed_values as FV
from cohortex.operators import drift as DX
from cohortex.operators import features as FT
from cohortex.operators import interactions as IX
from cohortex.operators import merchants as MX
from cohortex.operators import quality as QX
from cohortex.operators import ranking as RX
from cohortex.sources import files as FS
from cohortex.sources.bindings import TableSubset

ONE_HOT_PREFIXES = ("region_", "seg_", "region_type_")
JOINED = ("people", "transaction", "receipts")       # tables whose binding joins
_POINTER = "seq long, version string, folder string"


def drift_columns(features: DataFrame) -> list[str]:
    """Numeric model columns, one-hot indicator columns excluded."""
    return [c for c in DX.common_numeric_columns(features, features)
            if not c.startswith(ONE_HOT_PREFIXES) or c == "region_size"]


def current_reference(spark: SparkSession, out_dir: str) -> dict | None:
    """The row that names the reference in use; None before the first run."""
    try:
        rows = spark.read.schema(_POINTER).json(os.path.join(out_dir, "reference_in_use"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    found = rows.orderBy(F.col("seq").desc()).limit(1).collect()
    return found[0].asDict() if found else None


def replace_reference(spark: SparkSession, out_dir: str, version: str, features: DataFrame) -> DataFrame:
    """Makes the snapshot of ``features`` the reference; returns it."""
    now = current_reference(spark, out_dir)
    folder = os.path.join("reference_features", f"{version}-{uuid.uuid4().hex}")
    FS.write_if_absent(DX.reference_snapshot(features, drift_columns(features)), os.path.join(out_dir, folder))
    row = [((now["seq"] + 1) if now else 0, version, folder)]
    spark.createDataFrame(row, _POINTER).coalesce(1).write.mode("append").json(os.path.join(out_dir, "reference_in_use"))
    return read_reference(spark, out_dir)[1]


def read_reference(spark: SparkSession, out_dir: str) -> tuple[str | None, DataFrame | None]:
    """The reference in use: its version and its snapshot."""
    now = current_reference(spark, out_dir)
    if now is None:
        return None, None
    return now["version"], spark.read.schema(DX.SNAPSHOT).parquet(os.path.join(out_dir, now["folder"]))


def keep_tables(spark: SparkSession, tables: dict, path: str, names: tuple[str, ...] = JOINED) -> TableSubset:
    """``tables`` with those of ``names`` written once under ``path`` and read
    back. Rows of a user lie together, except where one has far more than
    others, so what is aggregated per user is mostly combined before a shuffle."""
    kept = {}
    for name in names:
        if name in tables:
            df = tables[name]
            at = os.path.join(path, name)
            df.hint("rebalance", "user_id").sortWithinPartitions("user_id").write.option("compression", "zstd").parquet(at)
            kept[name] = spark.read.schema(df.schema).parquet(at)
    return TableSubset(tables, **kept)


def run_version(spark: SparkSession, tables: dict, out_dir: str, version: str, interaction_reference: str,
                stop_on_invalid: bool = False, k: int = FV.TOP_N_DEFAULT) -> DataFrame:
    """Run one version; returns a one-row summary.

    ``stop_on_invalid`` stops after validation when a check fails (the
    online commit path); the offline run continues regardless.
    """
    run_dir = os.path.join(out_dir, f"version={version}")
    reports = os.path.join(out_dir, "reports")
    summary = {"version": version}

    # 1. validate (Q1-Q9) and keep the report rows
    checks = FS.kept_report(QX.quality_checks(tables), os.path.join(reports, "quality_checks"), version)
    total = QX.quality_report(checks).where(F.col("table_name") == "__all__").collect()[0]
    summary.update(valid=bool(total["valid"]), checks_failed=int(total["checks_failed"]))
    if stop_on_invalid and not total["valid"]:
        return _summary(spark, summary)

    # 2. features and interactions (S6), read back for the later stages (S5); what versions share
    categories = FS.keep_categories(spark, lambda kept: FT.feature_categories(tables, kept)[0],
                                    os.path.join(out_dir, "categories"), version)
    FS.sink_features(FT.feature_table(tables, categories=categories),
                     IX.interactions(tables.get("offer_activation"), tables.get("offer_reward"),
                                     interaction_reference), run_dir, categories)
    features, inter = FS.load_features(spark, run_dir)
    if "offer" in tables and "merchant" in tables:
        known = MX.keep_entities(MX.known_entities(tables["offer"], tables["merchant"]), os.path.join(out_dir, "entities"), version)
        summary.update(n_known=known.count())

    # 3. drift against the stored reference; the first run becomes the reference
    _, reference = read_reference(spark, out_dir)
    if reference is None:
        reference = replace_reference(spark, out_dir, version, features)
    model_path = os.path.join(out_dir, "model")
    model_exists = RX.model_exists(spark, model_path)
    report = DX.drift_report(DX.psi_against(reference, features), model_exists=model_exists)
    row = FS.kept_report(report, os.path.join(reports, "drift"), version).collect()[0]
    summary.update(drift_detected=bool(row["drift_detected"]), drift_score=float(row["drift_score"]))

    # 4-6. retrain (F12): split, train, save, replace the reference (I5), evaluate
    summary.update(retrained=bool(row["retrain"]), map_at_k=None, num_test_users=None)
    if row["retrain"]:
        FS.write_parquet(IX.split_holdout(inter), os.path.join(run_dir, "interactions_split.parquet"), ["split"])      # S7
        train, test = (spark.read.parquet(os.path.join(run_dir, "interactions_split.parquet", f"split={s}")) for s in ("train", "test"))
        fit = RX.train_als(train, previous=RX.load_model(spark, model_path) if model_exists else None)
        RX.save_model(fit, model_path)                                                     # S13
        replace_reference(spark, out_dir, version, features)                                # I5
        fit = RX.load_model(spark, model_path)
        preds = RX.recommend_unseen(fit.user_vectors(), fit.item_vectors(), train, test, k)
        ev = FS.kept_report(RX.map_at_k(preds, test, k), os.path.join(reports, "evaluation"), version)
        e = ev.collect()[0]
        summary.update(map_at_k=float(e["map_at_k"]), num_test_users=int(e["num_test_users"]))
    summary.update(reference_version=current_reference(spark, out_dir)["version"])
    return _summary(spark, summary)


def _summary(spark: SparkSession, s: dict) -> DataFrame:
    schema = ("version string, valid boolean, checks_failed long, drift_detected boolean, drift_score double, "
              "retrained boolean, map_at_k double, num_test_users long, n_known long, reference_version string")
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(s.get(n) for n in names)], schema)
