"""User x offer interactions (U1, A10, F3, P15) and the holdout split (M1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.functions import columns as C
from cohortex.functions import fixed_values as FV


def _as_ts(ref) -> Column:
    return C.ts_literal(ref) if isinstance(ref, str) else ref


def interactions(activations: DataFrame | None, rewards: DataFrame | None, ref) -> DataFrame:
    """Activations (confidence 1) and rewards (confidence 2) up to ``ref``,
    one row per (user, offer) with the strongest signal.

    The union is aggregated with a map-side ``max``, so a hot user or offer
    is combined before the shuffle.
    """
    ref = _as_ts(ref)
    parts = []
    if activations is not None:
        parts.append(activations.where(C.lenient_ts("activation_date") <= ref)
                     .select("user_id", "offer_id", F.lit(FV.ACTIVATION_CONFIDENCE).alias("confidence")))
    if rewards is not None:
        parts.append(rewards.where(C.lenient_ts("event_date") <= ref)
                     .select("user_id", "offer_id", F.lit(FV.REWARD_CONFIDENCE).alias("confidence")))
    if not parts:
        raise ValueError("interactions need activations or rewards")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.select(C.lenient_long("user_id").alias("user_id"), C.lenient_long("offer_id").alias("offer_id"),
                 "confidence")
    return (u.where(F.col("user_id").isNotNull() & F.col("offer_id").isNotNull())
            .groupBy("user_id", "offer_id")
            .agg(F.max("confidence").cast("float").alias("confidence")))


def holdout_threshold(share: float) -> str:
    """Hex prefix below which a pair goes to the test side."""
    return format(int(share * 16 ** 8), "08x")


def split_holdout(inter: DataFrame, share: float = FV.HOLDOUT_SHARE, seed: int = FV.HOLDOUT_SEED) -> DataFrame:
    """M1: deterministic per-pair split. The side of a pair is a function of
    (user, offer, seed) only, so it does not depend on partitioning, task
    retries or executor loss (``randomSplit`` does)."""
    h = F.substring(F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("offer_id").cast("string"),
                                      F.lit(str(seed)))), 1, 8)
    return inter.withColumn("split", F.when(h < F.lit(holdout_threshold(share)), "test").otherwise("train"))
