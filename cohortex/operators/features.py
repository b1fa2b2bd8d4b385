"""Per-user feature operators.

Every aggregate is keyed by ``user_id`` and produces one row per user, so
the final assembly is a chain of left joins whose sides are already hash
partitioned on ``user_id`` by their aggregation exchange; only the people
side is shuffled for them.

Skew: a user may own a third of all rows. All aggregates here are
algebraic (count / sum / min_by / stddev buffers / distinct via a two-level
group-by), so Spark combines them map-side before the shuffle and the hot
user reaches its reducer as one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.functions import columns as C
from cohortex.functions import fixed_values as FV
from cohortex.operators.categories import Categories, quoted


# ----------------------------------------------------------------- helpers

def first_non_null(c: str, ordinal: str = "ordinal") -> Column:
    """Value of ``c`` on the earliest-arrived row where it is not NULL."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ordinal)))


def as_double(df: DataFrame, c: str) -> Column:
    """Numeric column as DOUBLE; text is parsed leniently."""
    if isinstance(df.schema[c].dataType, T.NumericType):
        return F.col(c).cast("double")
    return C.lenient_double(c)


def observed_domain(df: DataFrame, c: str, max_values: int | None = None) -> list:
    """Sorted distinct non-NULL values of a categorical column.

    The values become column names of a wide table, so they reach the
    driver whatever their number; a caller may set ``max_values`` to raise
    instead. ``one_hot_long`` is the form for open domains.
    """
    rows = df.select(c).where(F.col(c).isNotNull()).distinct()
    rows = (rows if max_values is None else rows.limit(max_values + 1)).collect()
    if max_values is not None and len(rows) > max_values:
        raise ValueError(f"column {c!r} has more than {max_values} distinct values")
    return sorted(r[0] for r in rows)


def one_hot_long(df: DataFrame, key: str, c: str, prefix: str) -> DataFrame:
    """The ones of ``one_hot`` as rows (key, feature, value): no value
    reaches the driver and the domain may be of any size."""
    return (df.where(F.col(c).isNotNull()).groupBy(key, F.concat(F.lit(f"{prefix}_"), F.col(c).cast("string")).alias("feature"))
            .agg(F.count("*").alias("value")))


def observed_domains(columns: list[tuple[str, DataFrame, str]], max_values: int | None = None) -> dict[str, list]:
    """Domains of several text columns (``(key, df, column)``) in ONE job:
    the union of their distinct values. With ``max_values`` a larger domain
    raises."""
    parts = [(df.select(F.lit(key).alias("k"), F.col(c).cast("string").alias("v")) if isinstance(c, str)
              else df.select(F.lit(key).alias("k"), c.cast("string").alias("v"))).where(F.col("v").isNotNull())
             for key, df, c in columns]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.distinct()
    rows = (u if max_values is None else u.limit(len(columns) * max_values + 1)).collect()
    out = {key: [] for key, _, _ in columns}
    for k, v in rows:
        out[k].append(v)
    for k, vals in out.items():
        if max_values is not None and len(vals) > max_values:
            raise ValueError(f"column {k!r} has more than {max_values} distinct values")
        vals.sort()
    return out


def one_hot(df: DataFrame, c: str, prefix: str, names: dict[str, str] | None = None) -> DataFrame:
    """One 0/1 column per value of ``names`` (value -> column name,
    made from the observed values if not given); NULL -> all zero."""
    if names is None:
        names = Categories().extended({prefix: observed_domain(df, c)}, df.columns).of(prefix)
    return df.withColumns({name: F.coalesce((quoted(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
                           for v, name in names.items()})


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


def numeric_columns(df: DataFrame, exclude=("user_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def reference_timestamp(tx: DataFrame) -> Column:
    """Max of the raw ``event_date`` text, parsed; empty table -> today.

    Resolved once by a one-row aggregate (partial max per task, so only one
    value per task reaches the driver) and used as a literal: every window
    filter of the plan then constant-folds instead of re-planning the
    transaction table inside a scalar subquery at each use."""
    value = tx.agg(F.max("event_date")).collect()[0][0]
    return F.coalesce(C.lenient_ts(F.lit(value).cast("string")), C.today())


def reference_date(tx: DataFrame) -> DataFrame:
    """P11 as a one-row result."""
    return tx.agg(F.max("event_date").alias("reference_date"))


def window_start(ref: Column, days: int) -> Column:
    """Reference minus N days."""
    return ref - F.make_dt_interval(days=F.lit(days))


# ------------------------------------------------------------- base (people)

def base_features(people: DataFrame, regions: dict[str, str] | None = None,
                  activity_reference: str = FV.ACTIVITY_REFERENCE_DATE) -> DataFrame:
    """P1, P2, P5, P6 on the people table."""
    df = people.drop("ordinal") if "ordinal" in people.columns else people
    df = df.withColumns({
        "gender_encoded": C.gender_code("gender_cd"),
        "age_encoded": C.age_code("age_bucket"),
    })
    if "region" in df.columns:
        df = one_hot(df, "region", "region", regions)
    if "last_activity_day" in df.columns:
        df = df.withColumns({
            "days_since_activity": C.days_since("last_activity_day", activity_reference),
            "last_activity_day": C.lenient_ts("last_activity_day"),
        })
    return df


# ---------------------------------------------------------------- segments

def segment_aggregates(segments: DataFrame) -> DataFrame:
    """A6 + P8/P10: one row per user from possibly many segment rows."""
    s = segments.select(
        "user_id", "ordinal",
        C.segment_code("segment").alias("segment_code"),
        C.segment_rank("segment").alias("segment_rank"),
        "region_size", "vip_status",
        *[C.lenient_double(c).alias(c) for c in ("auto", "traveler", "entrepreneur")])
    return (s.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        first_non_null("segment_code").alias("segment_code"),
        F.avg("segment_rank").alias("segment_rank"),
        first_non_null("region_size").alias("region_size"),
        F.avg("auto").alias("auto"),
        F.avg("traveler").alias("traveler"),
        F.avg("entrepreneur").alias("entrepreneur"),
        first_non_null("vip_status").alias("vip_status")))


# ------------------------------------------------------------ transactions

def _tx_prepared(tx: DataFrame) -> DataFrame:
    return tx.select(
        "user_id",
        F.col("merchant_id_tx").alias("merchant"),
        F.col("brand_dk").alias("brand"),
        C.lenient_ts("event_date").alias("ts"),
        C.amount_value("amount_bucket").alias("amount"),
        C.online_flag("online_transaction_flg").alias("online"),
        F.col("transaction_id").isNotNull().alias("has_id"))


def _window_parts(windows, ref: Column) -> list[Column]:
    """Per-group partial counts and sums of every trailing window."""
    parts = []
    for d in windows:
        w = F.col("ts") >= window_start(ref, d)
        parts += [F.count_if(w & F.col("has_id")).alias(f"n_id_{d}"),
                  F.count_if(w).alias(f"n_{d}"),
                  F.sum(F.when(w, F.col("amount"))).alias(f"s_{d}"),
                  F.sum(F.when(w, F.col("online"))).alias(f"o_{d}")]
    return parts


def _window_totals(windows) -> list[Column]:
    """The window features of a user from its merchants' partial ones."""
    out = []
    for d in windows:
        n = F.sum(f"n_{d}")
        out += [F.sum(f"n_id_{d}").alias(f"tx_count_{d}d"),
                F.coalesce(F.sum(f"s_{d}"), F.lit(0.0)).alias(f"tx_amount_sum_{d}d"),
                F.coalesce(F.try_divide(F.sum(f"s_{d}"), n), F.lit(0.0)).alias(f"tx_amount_avg_{d}d"),
                F.coalesce(F.try_divide(F.sum(f"o_{d}"), n), F.lit(0.0)).alias(f"online_share_{d}d"),
                F.count_if(F.col("merchant").isNotNull()
                           & (F.col("last_ts") >= window_start(F.col("ref"), d))).alias(f"unique_merchants_{d}d")]
    return out


def tx_window_features(tx: DataFrame, ref: Column | None = None, windows=tuple(FV.TX_WINDOWS)) -> DataFrame:
    """A1 + F1 + P3/P4: trailing-window aggregates for all windows in one scan.

    Distinct merchants per window use a two-level aggregate: (user, merchant)
    keeps the merchant's latest date; a merchant is in window d when that
    date is inside it. This avoids Catalyst's Expand for several
    distinct aggregates and stays combinable map-side.
    """
    ref = reference_timestamp(tx) if ref is None else ref
    per_merchant = (_tx_prepared(tx).groupBy("user_id", "merchant")
                    .agg(*_window_parts(windows, ref), F.max("ts").alias("last_ts"))
                    .withColumn("ref", ref))
    return per_merchant.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*_window_totals(windows))


def tx_total_features(tx: DataFrame) -> DataFrame:
    """A2: all-time aggregates; sample std of one row is NULL -> 0."""
    t = _tx_prepared(tx).where(F.col("user_id").isNotNull())
    return t.groupBy("user_id").agg(
        F.count_if(F.col("has_id")).alias("tx_count_total"),
        F.sum("amount").alias("tx_amount_sum_total"),
        F.avg("amount").alias("tx_amount_avg_total"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("tx_amount_std_total"),
        F.avg("online").cast("double").alias("online_share_total"),
        F.count_distinct("merchant").alias("unique_merchants_total"),
        F.count_distinct("brand").alias("unique_brands_total"))


def _tx_parts(t: DataFrame, ref: Column, spans: list[int]) -> DataFrame:
    """Narrow partial rows of prepared transactions: per user how often each
    (``code``, amount, online) came, ``code`` from 0 being twice the place of
    the shortest of the windows ``spans`` that has the row, plus 1 where it
    has an id; per (user, merchant) its smallest place so, ``near``, under
    code -1; per (user, brand) a row under code -2."""
    place = F.lit(len(spans))
    for i in reversed(range(len(spans))):
        place = F.when(F.col("ts") >= window_start(ref, spans[i]), F.lit(i)).otherwise(place)
    t = t.select("user_id", "merchant", "brand", "amount", "online", place.alias("place"), F.col("has_id").cast("int").alias("has_id"))
    none = {c: F.lit(None).cast(t.schema[c].dataType) for c in ("merchant", "brand", "amount", "online", "place")}

    def under(code, **values):
        values = {**none, **values}
        return F.struct(code.alias("code"), *[values[c].alias(c if c != "place" else "near") for c in none])

    kinds = F.explode(F.array(under(F.col("place") * 2 + F.col("has_id"), amount=F.col("amount"), online=F.col("online")),
                              under(F.lit(-1), merchant=F.col("merchant"), place=F.col("place")),
                              under(F.lit(-2), brand=F.col("brand"))))
    e = t.select("user_id", kinds.alias("u")).select("user_id", "u.*")
    e = e.where((F.col("code") >= 0) | F.col("merchant").isNotNull() | F.col("brand").isNotNull())
    return (e.groupBy("user_id", "code", "merchant", "brand", "amount", "online")
            .agg(F.count("*").alias("n"), F.min("near").alias("near")))


def tx_features(tx: DataFrame, ref: Column, windows=tuple(FV.TX_WINDOWS)) -> DataFrame:
    """A1 + A2 in one scan: the columns of ``tx_window_features`` and
    ``tx_total_features``.

    Every transaction counts under its measures, its merchant and its brand,
    the last two only there to be counted. Hardly any of these rows may meet
    another in its task, so they are narrow: a window is a place in a list
    and not a set of sums. They combine map-side and roll up per user. The
    deviation comes from sums of squares: amounts are values of a fixed code
    map, so these sums are exact.
    """
    spans = sorted(windows)
    parts = _tx_parts(_tx_prepared(tx).where(F.col("user_id").isNotNull()), ref, spans)
    code, own = F.col("code"), F.col("code") >= 0
    total = lambda v, where=own: F.sum(F.when(where, v))
    count = lambda where: F.coalesce(total(F.col("n"), where), F.lit(0).cast("long"))
    times = lambda c: F.col(c) * F.col("n")
    with_id = own & (code % 2 == 1)
    out = []
    for d in windows:
        i = spans.index(d)
        inside = own & (code < 2 * (i + 1))
        rows, amounts = count(inside), total(times("amount"), inside)
        out += [count(with_id & inside).alias(f"tx_count_{d}d"),
                F.coalesce(amounts, F.lit(0.0)).alias(f"tx_amount_sum_{d}d"),
                F.coalesce(F.try_divide(amounts, rows), F.lit(0.0)).alias(f"tx_amount_avg_{d}d"),
                F.coalesce(F.try_divide(total(times("online"), inside), rows), F.lit(0.0)).alias(f"online_share_{d}d"),
                F.count_if(F.col("near") <= i).alias(f"unique_merchants_{d}d")]
    n, s = count(own & F.col("amount").isNotNull()), total(times("amount"))
    spread = F.greatest(total(F.col("amount") * times("amount")) - s * s / n, F.lit(0.0))
    return parts.groupBy("user_id").agg(
        *out,
        count(with_id).alias("tx_count_total"),
        s.alias("tx_amount_sum_total"),
        F.try_divide(s, n).alias("tx_amount_avg_total"),
        F.coalesce(F.sqrt(F.when(n > 1, spread / (n - 1))), F.lit(0.0)).alias("tx_amount_std_total"),
        F.try_divide(total(times("online")), count(own & F.col("online").isNotNull())).cast("double").alias("online_share_total"),
        F.count_if(code == -1).alias("unique_merchants_total"),
        F.count_if(code == -2).alias("unique_brands_total"))


# ---------------------------------------------------------------- receipts

def receipt_window_features(receipts: DataFrame, ref: Column, windows=tuple(FV.RECEIPT_WINDOWS),
                            more: list[Column] = ()) -> DataFrame:
    """A3 + F2: count / items / cost per trailing window, and ``more``
    aggregates of the same rows, one scan."""
    r = receipts.select("user_id", C.lenient_ts("date_operated").alias("ts"),
                        as_double(receipts, "items_count").alias("items"),
                        as_double(receipts, "items_cost").alias("cost"),
                        *(["category_name"] if more else []))
    aggs = []
    for d in windows:
        w = F.col("ts") >= window_start(ref, d)
        aggs += [F.count_if(w).alias(f"receipts_count_{d}d"),
                 F.coalesce(F.sum(F.when(w, F.col("items"))), F.lit(0.0)).alias(f"receipts_items_{d}d"),
                 F.coalesce(F.sum(F.when(w, F.col("cost"))), F.lit(0.0)).alias(f"receipts_cost_{d}d")]
    return r.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*aggs, *more)


def receipt_features(receipts: DataFrame, ref: Column, names: dict[str, str],
                     windows=tuple(FV.RECEIPT_WINDOWS)) -> DataFrame:
    """A3 + A4 in one aggregation pass: window sums and one conditional
    count per category side by side, 0 where a user lacks a category."""
    return receipt_window_features(receipts, ref, windows, [
        F.count_if(F.col("category_name") == F.lit(v)).alias(name) for v, name in names.items()])


def category_pivot(receipts: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """A4: receipts per category as columns, 0 when absent.

    Rows get their category's column name from the dictionary, which has one
    row per column of the result, and are pivoted by it: values that Spark
    could not tell apart as columns never become any.
    """
    r = receipts.where(F.col("user_id").isNotNull() & F.col("category_name").isNotNull()).select("user_id", "category_name")
    if names is None:
        names = Categories().extended({"cat": observed_domain(r, "category_name")}).of("cat")
    columns = list(names.values())
    lookup = receipts.sparkSession.createDataFrame(list(names.items()), "category_name string, name string")
    p = (r.groupBy("user_id", "category_name").agg(F.count("*").alias("n"))
         .join(F.broadcast(lookup), "category_name")
         .groupBy("user_id").pivot("name", columns).agg(F.sum("n")))
    return p.select("user_id", *[F.coalesce(quoted(c), F.lit(0)).cast("bigint").alias(c) for c in columns])


# ---------------------------------------------------------------- accounts

def account_features(accounts: DataFrame) -> DataFrame:
    """A5: distinct products and active accounts per user."""
    return (accounts.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count_distinct("product_cd").alias("num_products"),
        F.count_if(F.col("account_status_cd") == FV.ACTIVE_ACCOUNT_STATUS).alias("active_accounts")))


# ------------------------------------------------------------------ offers

def seen_aggregates(seens: DataFrame) -> DataFrame:
    """Impressions per user and the first-arrived start date."""
    return (seens.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("offer_id").alias("offers_seen_count"),
        first_non_null("start_date").alias("first_offer_date")))


def activation_aggregates(act: DataFrame) -> DataFrame:
    """Activations per user (no date filter) and the first activation date."""
    return (act.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("offer_id").alias("offers_activated_count"),
        first_non_null("activation_date").alias("first_activation_date")))


def reward_aggregates(reward: DataFrame) -> DataFrame:
    """A9 + P8: rewards per user and their lenient sum (missing column -> 0, D10)."""
    amt = (F.coalesce(C.lenient_double("reward_amt"), F.lit(0.0)) if "reward_amt" in reward.columns
           else F.lit(0.0))
    return (reward.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("offer_id").alias("rewards_count"),
        F.sum(amt).alias("total_reward_amt")))


OFFER_COUNT_COLUMNS = ["offers_seen_count", "offers_activated_count", "rewards_count", "total_reward_amt"]


def offer_features(base: DataFrame, tables: dict) -> DataFrame:
    """Impressions, activations and rewards joined to ``base`` by user."""
    out = base
    for name, fn in (("offer_seens", seen_aggregates), ("offer_activation", activation_aggregates),
                     ("offer_reward", reward_aggregates)):
        if name in tables:
            out = out.join(fn(tables[name]), "user_id", "left")
    return fill_zero(out, [c for c in OFFER_COUNT_COLUMNS if c in out.columns])


# ---------------------------------------------------------------- assembly

def feature_categories(tables: dict, kept: Categories | None = None, more: list = ()) -> tuple[Categories, dict]:
    """The dictionary of the wide table's category columns, ``kept`` extended
    by the values that ``tables`` have, from one small job; and the domains
    that job read, those of ``more`` columns among them."""
    wanted, reserved = list(more), set()
    if "people" in tables:
        wanted.append(("region", tables["people"], "region"))
        reserved.update(tables["people"].columns)
    if "segments" in tables:
        seg = segment_aggregates(tables["segments"])
        wanted += [("seg", seg, "segment_code"), ("region_type", seg, "region_size")]
        reserved.update(seg.columns)
    if "receipts" in tables:
        wanted.append(("cat", tables["receipts"], "category_name"))
    domains = observed_domains([w for w in wanted if w[2] in w[1].columns])
    known = {k: v for k, v in domains.items() if k not in {m[0] for m in more}}
    return (kept or Categories()).extended(known, reserved), domains


def feature_table(tables: dict, ref: Column | None = None, activity_reference: str = FV.ACTIVITY_REFERENCE_DATE,
                  categories: Categories | None = None) -> DataFrame:
    """The wide per-user feature row: base -> segments -> transactions ->
    receipts -> accounts -> offers, all left joins on ``user_id`` (J1-J7).

    NULL measures are 0 afterwards (P13/P14); string and timestamp columns
    keep their NULLs. The category columns are those of ``categories``; made
    from the tables if not given.
    """
    if "people" not in tables:
        raise ValueError("feature_table needs the people table")
    if categories is None:
        asked = "transaction" in tables and ref is None     # P11 rides along in the same job
        more = [("__ref", tables["transaction"].agg(F.max("event_date").alias("m")), "m")] if asked else []
        categories, domains = feature_categories(tables, more=more)
        if asked:
            value = domains["__ref"][0] if domains["__ref"] else None
            ref = F.coalesce(C.lenient_ts(F.lit(value).cast("string")), C.today())
    feats = base_features(tables["people"], categories.of("region"), activity_reference=activity_reference)
    if "segments" in tables:
        seg = segment_aggregates(tables["segments"])
        seg = one_hot(one_hot(seg, "segment_code", "seg", categories.of("seg")),
                      "region_size", "region_type", categories.of("region_type"))
        feats = feats.join(seg, "user_id", "left")
    if "transaction" in tables:
        tx = tables["transaction"]
        ref = reference_timestamp(tx) if ref is None else ref
        feats = feats.join(tx_features(tx, ref), "user_id", "left")
    elif ref is None:
        ref = C.today()
    if "receipts" in tables:
        feats = feats.join(receipt_features(tables["receipts"], ref, categories.of("cat")), "user_id", "left")
    if "financial_account" in tables:
        feats = feats.join(account_features(tables["financial_account"]), "user_id", "left")
    feats = offer_features(feats, tables)
    return fill_zero(feats, numeric_columns(feats))
