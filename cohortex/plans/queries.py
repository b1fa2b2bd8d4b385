"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query binds the driver's tables to the logical tables and runs one
operator (or one composition) over the whole tables. Floating results are
rounded so that they compare exactly with the DuckDB oracle of the same
name in ``cohortex.plans.oracles``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortex.functions import columns as C
from cohortex.operators import drift as DX
from cohortex.operators import features as FT
from cohortex.operators import interactions as IX
from cohortex.operators import merchants as MX
from cohortex.operators import quality as QX
from cohortex.operators import ranking as RX
from cohortex.operators import similarity as SX
from cohortex.operators.categories import quoted
from cohortex.plans import offline_run as OR
from cohortex.session import scratch_path
from cohortex.sources import files as FS
from cohortex.sources.bindings import BINDERS, INTERACTION_REFERENCE_DATE, TableSubset, bind, read_table
from cohortex.streaming import ingest as IN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(quoted(f.name), digits) for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def fmt_ts(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---------------------------------------------------------------- scalars

@query
def q_reference_date(spark, d):
    return FT.reference_date(bind(spark, d)["transaction"])


@query
def q_encode_maps(spark, d):
    p = bind(spark, d)["people"]
    return p.select("user_id", C.gender_code("gender_cd").alias("gender_encoded"),
                    C.age_code("age_bucket").alias("age_encoded"))


@query
def q_encode_amounts(spark, d):
    tx = bind(spark, d)["transaction"]
    return tx.select("transaction_id", "user_id",
                     C.amount_value("amount_bucket").alias("amount_numeric"),
                     C.online_flag("online_transaction_flg").alias("online_flag"))


@query
def q_days_since(spark, d):
    p = bind(spark, d)["people"]
    return p.select("user_id", C.days_since("last_activity_day").alias("days_since_activity"))


@query
def q_segment_parse(spark, d):
    s = bind(spark, d)["segments"]
    return round_doubles(s.select("user_id", "ordinal", C.segment_code("segment").alias("segment_code"),
                                  C.segment_rank("segment").alias("segment_rank")))


@query
def q_lenient_parse(spark, d):
    t = bind(spark, d)
    o = t["offer"].select(F.lit("offer").alias("source"), F.col("offer_id").alias("id"),
                          fmt_ts(C.lenient_ts("start_date")).alias("start_ts"),
                          fmt_ts(C.lenient_ts("end_date")).alias("end_ts"),
                          F.lit(None).cast("double").alias("amount"))
    r = t["offer_reward"].select(F.lit("reward").alias("source"), F.col("ordinal").alias("id"),
                                 fmt_ts(C.lenient_ts("event_date")).alias("start_ts"),
                                 F.lit(None).cast("string").alias("end_ts"),
                                 C.lenient_double("reward_amt").alias("amount"))
    s = t["segments"].select(F.lit("segment").alias("source"), F.col("ordinal").alias("id"),
                             F.lit(None).cast("string").alias("start_ts"),
                             F.lit(None).cast("string").alias("end_ts"),
                             C.lenient_double("auto").alias("amount"))
    return round_doubles(o.unionByName(r).unionByName(s))


# --------------------------------------------------------------- features

@query
def q_tx_window_features(spark, d):
    return round_doubles(FT.tx_window_features(bind(spark, d)["transaction"]))


@query
def q_tx_total_features(spark, d):
    return round_doubles(FT.tx_total_features(bind(spark, d)["transaction"]))


@query
def q_receipt_window_features(spark, d):
    t = bind(spark, d)
    return round_doubles(FT.receipt_window_features(t["receipts"], FT.reference_timestamp(t["transaction"])))


@query
def q_category_pivot(spark, d):
    return FT.category_pivot(bind(spark, d)["receipts"])


@query
def q_account_features(spark, d):
    return FT.account_features(bind(spark, d)["financial_account"])


@query
def q_segment_features(spark, d):
    return round_doubles(FT.segment_aggregates(bind(spark, d)["segments"]))


@query
def q_one_hot(spark, d):
    t = bind(spark, d)
    seg = FT.segment_aggregates(t["segments"]).select("user_id", "segment_code", "region_size")
    seg = FT.one_hot(FT.one_hot(seg, "segment_code", "seg"), "region_size", "region_type")
    people = FT.one_hot(t["people"].select("user_id", "region"), "region", "region")
    return people.drop("region").join(seg.drop("segment_code", "region_size"), "user_id", "left")


@query
def q_feature_dictionary(spark, d):
    """P5 + P21: the names that category values have as columns, kept with the features and read back."""
    t = bind(spark, d)
    out = _fresh(spark, "dictionary")
    early = {**t, "people": t["people"].where(F.col("region") != "BUILDING"), "receipts": t["receipts"], "segments": t["segments"]}
    categories, _ = FT.feature_categories(early)
    FS.write_parquet(categories.table(spark), os.path.join(out, "categories.parquet"))
    # a value that comes later, and of which there is one in other letters, leaves the names of a first run alone
    return FT.feature_categories(t, FS.load_categories(spark, out))[0].table(spark)


@query
def q_offer_features(spark, d):
    t = bind(spark, d)
    out = FT.offer_features(t["people"].select("user_id"), t)
    return round_doubles(out, 2)


@query
def q_feature_table(spark, d):
    f = FT.feature_table(bind(spark, d))
    f = f.withColumn("last_activity_day", fmt_ts("last_activity_day"))
    return round_doubles(f)


# ----------------------------------------------------------- interactions



def interactions_of(spark, d):
    t = bind(spark, d)
    return IX.interactions(t["offer_activation"], t["offer_reward"], INTERACTION_REFERENCE_DATE)


@query
def q_interactions(spark, d):
    return interactions_of(spark, d).withColumn("confidence", F.col("confidence").cast("double"))


@query
def q_split_holdout(spark, d):
    return (IX.split_holdout(interactions_of(spark, d))
            .withColumn("confidence", F.col("confidence").cast("double")))


@query
def q_offer_merchant_map(spark, d):
    return MX.offer_merchant_map(bind(spark, d)["offer"])


@query
def q_merchant_offer_counts(spark, d):
    return MX.merchant_offer_counts(bind(spark, d)["offer"])


@query
def q_existing_customers(spark, d):
    t = bind(spark, d)
    return MX.existing_customers(t["transaction"], t["merchant"])


@query
def q_known_entities(spark, d):
    t = bind(spark, d)
    return MX.known_entities(t["offer"], t["merchant"])


# ---------------------------------------------------------------- quality



@query
def q_quality_checks(spark, d):
    return QX.quality_checks(bind(spark, d))


@query
def q_quality_report(spark, d):
    return QX.quality_report(QX.quality_checks(bind(spark, d)))


@query
def q_quality_violations(spark, d):
    t = bind(spark, d)
    out = None
    for name in t.names():
        part = QX.quality_violations(t[name], name, "ordinal")
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


@query
def q_duplicate_keys(spark, d):
    t = bind(spark, d)
    out = None
    for name in t.names():
        part = QX.duplicate_keys(t[name], name)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ drift


DRIFT_COLUMNS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DRIFT_SPLIT = "1998-01-01"


def drift_sides(spark, d):
    li = read_table(spark, d, "lineitem")
    cut = C.ts_literal(DRIFT_SPLIT)
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


@query
def q_drift_psi(spark, d):
    ref, cur = drift_sides(spark, d)
    return round_doubles(DX.psi_by_column(ref, cur, DRIFT_COLUMNS))


@query
def q_drift_common_columns(spark, d):
    """P18 + U5: PSI of every numeric column that both sides have, an empty
    one among them; text, dates and a column of one side only stay out."""
    ref, cur = (x.withColumn("l_empty", F.lit(None).cast("double")) for x in drift_sides(spark, d))
    return round_doubles(DX.psi_by_column(ref, cur.withColumn("l_new", F.col("l_tax") + 1)))


@query
def q_drift_report(spark, d):
    ref, cur = drift_sides(spark, d)
    return DX.drift_report(DX.psi_by_column(ref, cur, DRIFT_COLUMNS))


# ------------------------------------------------------------- similarity


SIMILAR_TOP_N = 10


def embedding_vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"),
                                                     F.col("embedding").alias("vec"), "label")


def label_cohort_seeds(spark, d):
    """One request per label; its seeds are the vectors carrying the label."""
    return embedding_vectors(spark, d).select(F.col("label").alias("request_id"), "user_id")


@query
def q_similar_users(spark, d):
    return round_doubles(SX.similar_users(embedding_vectors(spark, d), label_cohort_seeds(spark, d),
                                          SIMILAR_TOP_N))


@query
def q_similar_users_centroid(spark, d):
    return round_doubles(SX.similar_users_centroid(embedding_vectors(spark, d), label_cohort_seeds(spark, d),
                                                   SIMILAR_TOP_N))


@query
def q_audience_reasons(spark, d):
    return round_doubles(SX.audience_reasons(embedding_vectors(spark, d), label_cohort_seeds(spark, d),
                                             SIMILAR_TOP_N))


def offer_requests(spark, d, top_n=SIMILAR_TOP_N):
    """One audience request per offer that has interactions."""
    t = bind(spark, d)
    inter = interactions_of(spark, d)
    om = MX.offer_merchant_map(t["offer"])
    return (inter.select("offer_id").distinct().join(om, "offer_id", "left")
            .select(F.col("offer_id").alias("request_id"),
                    F.coalesce("merchant_id", F.lit(0)).alias("merchant_id"), "offer_id",
                    F.lit(top_n).alias("top_n")))


@query
def q_audience_batch(spark, d):
    t = bind(spark, d)
    out = SX.audience_batch(offer_requests(spark, d), embedding_vectors(spark, d), interactions_of(spark, d),
                            MX.merchant_offers(t["offer"]),
                            MX.known_entities(t["offer"], t["merchant"]).where(F.col("kind") == "offer"),
                            MX.existing_customers(t["transaction"], t["merchant"]), method="centroid")
    return round_doubles(out)


# ---------------------------------------------------------------- ranking


EVAL_K = 100


def split_sides(spark, d):
    s = IX.split_holdout(interactions_of(spark, d))
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


@query
def q_train_metrics(spark, d):
    train, _ = split_sides(spark, d)
    return RX.train_metrics(train)


@query
def q_ground_truth_lists(spark, d):
    _, test = split_sides(spark, d)
    return RX.ground_truth(test).withColumn("confidence", F.col("confidence").cast("double"))


@query
def q_popularity_recommendations(spark, d):
    train, test = split_sides(spark, d)
    return RX.popularity_recommendations(train, test, EVAL_K)


@query
def q_map_at_k(spark, d):
    train, test = split_sides(spark, d)
    preds = RX.popularity_recommendations(train, test, EVAL_K)
    return round_doubles(RX.map_at_k(preds, test, EVAL_K))


def vector_users_items(spark, d):
    """Even embedding ids act as users, odd ones as items; an interaction
    (u, o) marks item 2o+1 as seen by user 2u."""
    v = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    users = v.where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("user_id"), "vec")
    items = v.where(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("offer_id"), "vec")
    seen = interactions_of(spark, d).select((F.col("user_id") * 2).alias("user_id"),
                                            (F.col("offer_id") * 2 + 1).alias("offer_id"))
    return users, items, seen


@query
def q_recommend_topn_vectors(spark, d):
    users, items, seen = vector_users_items(spark, d)
    return round_doubles(RX.recommend_unseen(users, items, seen, users, SIMILAR_TOP_N))


def als_fit(spark, d):
    train, test = split_sides(spark, d)
    return RX.train_als(train), train, test


@query
def q_als_train(spark, d):
    fit, _, _ = als_fit(spark, d)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return fit.user_vectors().select("user_id", F.size("vec").alias("factors"),
                                     (norm.isNotNull() & ~F.isnan(norm) & (norm < float("inf"))).alias("finite"))


@query
def q_recommend_offers(spark, d):
    """Recommendations per test user; of their rows, what a fit leaves determined."""
    fit, train, test = als_fit(spark, d)
    recs = RX.recommend_unseen(fit.user_vectors(), fit.item_vectors(), train, test, EVAL_K)
    seen = train.select("user_id", "offer_id", F.lit(1).alias("seen")).distinct()
    return (recs.join(seen, ["user_id", "offer_id"], "left").groupBy("user_id")
            .agg(F.count("*").alias("n_rows"), F.max("rank").alias("last_rank"), F.count("seen").alias("n_seen")))


@query
def q_evaluate_als(spark, d):
    fit, train, test = als_fit(spark, d)
    preds = RX.recommend_unseen(fit.user_vectors(), fit.item_vectors(), train, test, EVAL_K)
    return (RX.map_at_k(preds, test, EVAL_K)
            .select(F.col("map_at_k").between(0.0, 1.0).alias("map_in_range"), "num_test_users", "k", "n_cold_users"))


@query
def q_als_audience(spark, d):
    """Audiences over ALS user factors (the reference's model path)."""
    fit, _, _ = als_fit(spark, d)
    t = bind(spark, d)
    return SX.audience_batch(offer_requests(spark, d), fit.user_vectors(), interactions_of(spark, d),
                             MX.merchant_offers(t["offer"]),
                             MX.known_entities(t["offer"], t["merchant"]).where(F.col("kind") == "offer"),
                             MX.existing_customers(t["transaction"], t["merchant"]), method="exact")


# ------------------------------------------------- ingest, sources, sinks



BATCH_SIZE = 5000
VERSION = "v1"


def _fresh(spark, kind):
    return scratch_path(spark, f"{kind}-{uuid.uuid4().hex}")


@query
def q_batch_assign(spark, d):
    fa = bind(spark, d)["financial_account"]
    return IN.batch_assign(fa.select("ordinal"), BATCH_SIZE)


def ingest_all(spark, d):
    """Every logical table as wire batches, sent to one store by two streams
    with a landing folder and a checkpoint each. The first brings two thirds
    of the batches and, as version v2, the first batch of two tables; the
    second the rest, and beside them other, shorter copies of batches that
    are there already (they must lose: first write wins) and lines that must
    be rejected. Returns the store folder and what makes the batches of
    chosen rows: a batch is put together where it is sent."""
    t = bind(spark, d)
    root = _fresh(spark, "ingest")
    store = os.path.join(root, "store")
    tables = {name: t[name] for name in BINDERS}
    numbered, columns = IN.numbered_rows(tables, BATCH_SIZE), IN.value_columns(tables)

    def wire(chosen, version=VERSION):
        return IN.batches_of(numbered.where(chosen), columns, version)

    batch_id, is_first = F.col("batch_id"), F.col("batch_id") == 1
    one = wire((F.col("table") == "people") & is_first)
    sent = {
        "first": [wire(batch_id % 3 != 0), wire(F.col("table").isin("people", "receipts") & is_first, "v2")],
        "second": [wire(batch_id % 3 == 0), wire((batch_id % 3 == 1) & (F.col("place") == 0)),
                   one.withColumn("table", F.lit("no_such_table")), one.withColumn("batch_id", F.lit(0)),
                   one.withColumn("total_batches", F.lit(0))],
    }
    for name, parts in sent.items():
        landing = os.path.join(root, name)
        for part in parts:
            IN.write_landing(part, landing)
        IN.ingest(spark, landing, store, os.path.join(root, f"checkpoint-{name}"))
    return store, wire


@query
def q_ingest_batches(spark, d):
    store, _ = ingest_all(spark, d)
    return IN.read_manifest(spark, store).select("version", "table", "batch_id", "total_batches", "records_count", "content_hash")


@query
def q_rejected_batches(spark, d):
    """what the ingest put aside."""
    store, _ = ingest_all(spark, d)
    return IN.read_rejected(spark, store).select("version", "table", "batch_id", "total_batches",
                                                 F.size("records").cast("long").alias("records_count"))


@query
def q_batch_manifest(spark, d):
    store, _ = ingest_all(spark, d)
    return IN.batch_manifest(IN.read_manifest(spark, store))


@query
def q_missing_batches(spark, d):
    """The ids that a version still waits for, when every third batch is not there yet."""
    store, _ = ingest_all(spark, d)
    manifest = IN.read_manifest(spark, store).where(F.col("version") == VERSION)
    return IN.missing_batches(manifest.where(F.col("batch_id") % 3 != 0))


@query
def q_version_completeness(spark, d):
    store, _ = ingest_all(spark, d)
    return IN.version_completeness(IN.read_manifest(spark, store))


@query
def q_commit_version(spark, d):
    """The rows of a committed version, in their order. A batch that arrives
    after the commit, and a second commit, change nothing."""
    store, wire = ingest_all(spark, d)
    out, late = _fresh(spark, "committed"), _fresh(spark, "late")
    cols = {name: [c for c in BINDERS[name](spark, d).columns if c != "ordinal"] for name in BINDERS}
    IN.commit_version(spark, store, VERSION, out, cols)
    IN.write_landing(wire((F.col("table") == "offer") & (F.col("batch_id") == 1)).withColumn("batch_id", F.lit(99)), late)
    IN.ingest(spark, late, store, f"{late}-checkpoint")
    manifest = IN.commit_version(spark, store, VERSION, out, cols)
    parts = [IN.read_committed(spark, out, VERSION, name).select(
        F.lit(name).alias("table"), "batch_id", "ordinal", F.col(c[0]).cast("long").alias("first_id"),
        sum(F.col(x).isNotNull().cast("int") for x in c).alias("n_values")) for name, c in cols.items()]
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(manifest), "table")                # one row per table


@query
def q_scan_jsonl(spark, d):
    """People written as JSON lines (all values as text) and scanned back with
    the declared string schema; typed again by the lenient parsers."""
    p = bind(spark, d)["people"].drop("ordinal")
    path = _fresh(spark, "jsonl")
    p.select([F.col(c).cast("string") for c in p.columns]).write.json(path)
    back = FS.scan_jsonl(spark, path, p.columns)
    return back.select(C.lenient_long("user_id").alias("user_id"), "age_bucket", "gender_cd", "region",
                       "last_activity_day", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query
def q_scan_csv(spark, d):
    p = bind(spark, d)["people"].drop("ordinal")
    path = _fresh(spark, "csv")
    p.write.option("header", True).csv(path)
    back = FS.scan_csv(spark, path, p.columns)
    return back.select(C.lenient_long("user_id").alias("user_id"), "age_bucket", "gender_cd", "region",
                       "last_activity_day")


@query
def q_sink_features(spark, d):
    t = bind(spark, d)
    out = _fresh(spark, "features")
    categories, _ = FT.feature_categories(t)
    FS.sink_features(round_doubles(FT.feature_table(t, categories=categories)), interactions_of(spark, d), out, categories)
    feats, _ = FS.load_features(spark, out)
    return feats.select(*[F.round(F.col(f"`{f.name}`").cast("double"), 4).alias(f.name)
                          if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`")
                          for f in feats.schema.fields])


@query
def q_scan_catalog(spark, d):
    t = bind(spark, d)
    out = None
    for name in t.names():
        part = t[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------ reports, model, offline run



@query
def q_quality_summary(spark, d):
    return QX.failed_checks(QX.quality_checks(bind(spark, d)))


@query
def q_invalid_values(spark, d):
    """Over tables in which some values are spoilt: one rule is broken by more values than are shown."""
    t = bind(spark, d)
    spoilt = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("?"), (F.col("user_id") % 75).cast("string")))
    flag = F.when(F.col("ordinal") % 7 == 0, F.lit("maybe"))
    t = TableSubset(t, people=t["people"].withColumn("gender_cd", F.coalesce(spoilt, "gender_cd")),
                    transaction=t["transaction"].withColumn("online_transaction_flg", F.coalesce(flag, "online_transaction_flg")))
    out = None
    for name in t.names():
        part = QX.invalid_values(t[name], name)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


@query
def q_drift_summary(spark, d):
    ref, cur = drift_sides(spark, d)
    return DX.drift_summary(DX.drift_report(DX.psi_by_column(ref, cur, DRIFT_COLUMNS)))


@query
def q_scan_batches(spark, d):
    """People sent as 500-row batch files and read back in batch order."""
    p = bind(spark, d)["people"]
    root = _fresh(spark, "batches")
    FS.write_batch_files(IN.batch_assign(p, 500).drop("ordinal"), root, "people")
    cols = [c for c in p.columns if c != "ordinal"]
    back = FS.scan_batches(spark, root, "people", cols)
    return back.select(C.lenient_long("user_id").alias("user_id"), "age_bucket", "gender_cd", "region",
                       "last_activity_day", "batch_id")


@query
def q_model_roundtrip(spark, d):
    """A trained model saved and loaded gives the same user factors."""
    fit, _, _ = als_fit(spark, d)
    path = _fresh(spark, "model")
    RX.save_model(fit, path)
    back = RX.load_model(spark, path)
    a = fit.user_vectors().select("user_id", F.col("vec").alias("a"))
    b = back.user_vectors().select("user_id", F.col("vec").alias("b"))
    return a.join(b, "user_id", "full").select("user_id", (F.col("a") == F.col("b")).alias("same"))


@query
def q_offline_run(spark, d):
    """The summary of a first run; of its evaluation, what a fit leaves determined."""
    t = OR.keep_tables(spark, bind(spark, d), _fresh(spark, "tables"))
    run = OR.run_version(spark, t, _fresh(spark, "run"), VERSION, INTERACTION_REFERENCE_DATE)
    return run.withColumn("map_in_range", F.col("map_at_k").between(0.0, 1.0)).drop("map_at_k", "n_known", "reference_version")


@query
def q_offline_versions(spark, d):
    """Three versions in one folder: a first one, with some of the offers;
    all the offers and otherwise the same; receipts of another size. The
    second changes neither reference nor model, the third both."""
    t, out = OR.keep_tables(spark, bind(spark, d), _fresh(spark, "tables")), _fresh(spark, "versions")
    first = TableSubset(t, offer=t["offer"].where(F.col("offer_id") % 4 != 0))
    third = TableSubset(t, receipts=t["receipts"].withColumns(
        {"items_count": F.col("items_count") + 1000, "items_cost": F.col("items_cost") + 10_000_000}))
    runs = [OR.run_version(spark, x, out, f"v{i}", INTERACTION_REFERENCE_DATE) for i, x in enumerate((first, t, third), 1)]
    return (reduce(DataFrame.unionByName, runs)
            .select("version", "valid", "checks_failed", "drift_detected", "retrained", "num_test_users", "n_known", "reference_version",
                    (F.col("drift_score") > 0).alias("any_drift")))


@query
def q_entity_numbers(spark, d):
    """A12 + U3 + J10: known offers and merchants over three versions, each
    with the number it got when it came; the second version is run twice."""
    t, path = bind(spark, d), _fresh(spark, "entities")
    known = MX.known_entities(t["offer"], t["merchant"])
    out = None
    for version, share in (("v1", F.col("id") % 3 == 1), ("v2", F.col("id") % 3 != 0), ("v2", F.col("id") % 3 != 0), ("v3", F.lit(True))):
        out = MX.keep_entities(known.where(share), path, version)
    return out
