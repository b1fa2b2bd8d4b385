"""Golden values of the mini data set (FIXTURES.md section 2)."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortex.functions import fixed_values as FV
from cohortex.operators import features as FT
from cohortex.operators import interactions as IX
from cohortex.operators import merchants as MX
from cohortex.operators import quality as QX
from cohortex.sources import files as FS
from tests.mini import mini_tables

EXPECTED = {
    # user: gender, age, days, code, rank, n, sum, avg, online, merchants, brands, std,
    #       receipts n/items/cost, cat_FOOD, cat_PRODUCT, products, active, seen, activated, rewards, amt
    1: (1, 1, 262, "m_02", 35, 2, 6000, 3000, 0.5, 1, 1, 2828.4271, 1, 5, 1500, 0, 1, 1, 1, 1, 1, 1, 100),
    2: (0, 2, 261, "m_03", 28, 1, 1000, 1000, 0, 1, 1, 0, 1, 3, 800, 1, 0, 1, 1, 1, 0, 0, 0),
    3: (1, 2, 260, "t_02", 42, 1, 10000, 10000, 0, 1, 1, 0, 1, 2, 2000, 0, 1, 1, 1, 1, 1, 0, 0),
    4: (0, 1, 259, "u_05", 31, 1, 1000, 1000, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0),
    5: (1, 3, 258, "m_01", 55, 1, 5000, 5000, 0, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0),
}
COLS = ["gender_encoded", "age_encoded", "days_since_activity", "segment_code", "segment_rank",
        "tx_count_total", "tx_amount_sum_total", "tx_amount_avg_total", "online_share_total",
        "unique_merchants_total", "unique_brands_total", "tx_amount_std_total",
        "receipts_count_30d", "receipts_items_30d", "receipts_cost_30d", "cat_FOOD", "cat_PRODUCT",
        "num_products", "active_accounts", "offers_seen_count", "offers_activated_count", "rewards_count",
        "total_reward_amt"]


@pytest.fixture(scope="module")
def tables(spark):
    return mini_tables(spark)


def test_feature_table_golden(tables):
    rows = {r["user_id"]: r for r in FT.feature_table(tables).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    for uid, exp in EXPECTED.items():
        got = tuple(rows[uid][c] for c in COLS)
        for c, g, e in zip(COLS, got, exp):
            if isinstance(e, float) or isinstance(g, float):
                assert g == pytest.approx(e, abs=1e-4), (uid, c)
            else:
                assert g == e, (uid, c)


def test_all_windows_equal_total(tables):
    # every transaction is inside every window (reference date 2025-06-05)
    f = FT.feature_table(tables)
    for d in (7, 30, 90):
        assert f.where(F.col(f"tx_count_{d}d") != F.col("tx_count_total")).count() == 0
        assert f.where(F.col(f"receipts_count_{d}d" if d != 7 else "receipts_count_30d")
                       != F.col("receipts_count_90d")).count() == 0


def test_reference_date(tables):
    assert FT.reference_date(tables["transaction"]).collect()[0][0] == "2025-06-05"


def test_one_hots(tables):
    f = FT.feature_table(tables)
    r = {x["user_id"]: x for x in f.collect()}
    assert r[1]["region_MOSCOW"] == 1 and r[3]["region_SPB"] == 1 and r[3]["region_MOSCOW"] == 0
    assert r[3]["seg_t_02"] == 1 and r[3]["region_type_town"] == 1 and r[1]["region_type_town"] == 0


def test_interactions_only_before_reference(tables):
    ref = FT.reference_timestamp(tables["transaction"])
    inter = IX.interactions(tables["offer_activation"], tables["offer_reward"], ref)
    assert [tuple(r) for r in inter.collect()] == [(1, 42, 1.0)]


def test_existing_customers_and_offer_map(tables):
    ex = MX.existing_customers(tables["transaction"], tables["merchant"]).collect()
    got = {}
    for r in ex:
        got.setdefault(r["merchant_id"], set()).add(r["user_id"])
    assert got == {75: {1, 3, 5}, 110: {2, 4}}
    om = {r["offer_id"]: r["merchant_id"] for r in MX.offer_merchant_map(tables["offer"]).collect()}
    assert om == {42: 75, 99: 110}


def test_quality_mini(tables):
    checks = QX.quality_checks(tables)
    rows = checks.collect()
    assert len(rows) == 66
    failed = sorted((r["table_name"], r["check_name"]) for r in rows if not r["success"])
    assert failed == sorted((t, "min_rows") for t in [
        "segments", "transaction", "offer", "merchant", "financial_account", "offer_seens",
        "offer_activation", "receipts"])
    rep = {r["table_name"]: r for r in QX.quality_report(checks).collect()}
    assert rep["__all__"]["checks_total"] == 66 and rep["__all__"]["checks_passed"] == 58
    assert rep["__all__"]["valid"] is False


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "M", None), (None, "Q", "a")],
                               "user_id long, gender_cd string, region string")
    rows = {r["check_name"]: r for r in QX.table_checks(df, "people").collect()}
    assert rows["required_columns"]["success"] is False            # age_bucket missing
    assert rows["no_null_user_id"]["failed"] == 1
    assert rows["unique_user_id"]["failed"] == 1                    # one repeat of 1; a single NULL is unique
    assert rows["valid_values_gender_cd"]["failed"] == 1            # 'Q'
    assert rows["no_null_age_bucket"]["success"] is False           # error: missing column
    assert QX.table_checks(df, "unknown_table").count() == 0


def test_single_row_std_and_lenient(spark):
    tx = spark.createDataFrame([(1, 7, 1, "2025-01-01", "oops", "1", 3, 0)],
                               "transaction_id long, user_id long, merchant_id_tx long, event_date string, "
                               "amount_bucket string, online_transaction_flg string, brand_dk long, ordinal long")
    r = FT.tx_total_features(tx).collect()[0]
    assert r["tx_amount_std_total"] == 0.0 and r["tx_amount_sum_total"] == 0.0
    assert r["online_share_total"] == 1.0     # the text '1' is online (D8)


def test_one_pass_transactions_equal_windows_and_totals(spark):
    rng = random.Random(5)
    pick = lambda *v: rng.choice([None, *v])
    rows = [(pick(1, 2), pick(*range(12)), pick(7, 8, 9), f"2025-0{rng.randint(1, 6)}-1{rng.randint(0, 9)}" if rng.random() < 0.9 else "bad",
             pick(*FV.AMOUNT_BUCKET_VALUES), pick("Y", "N", "1"), pick("7", "8", "b")) for _ in range(400)]
    tx = spark.createDataFrame(rows, "transaction_id long, user_id long, merchant_id_tx long, event_date string, "
                                     "amount_bucket string, online_transaction_flg string, brand_dk string")
    ref = F.lit("2025-06-19").cast("timestamp_ntz")
    want = {r["user_id"]: r.asDict() for r in
            FT.tx_window_features(tx, ref).join(FT.tx_total_features(tx), "user_id").collect()}
    got = {r["user_id"]: r.asDict() for r in FT.tx_features(tx, ref).collect()}
    assert got.keys() == want.keys() and len(got) == 12
    for user, row in want.items():
        assert got[user].keys() == row.keys()
        assert got[user] == pytest.approx(row)


def test_any_value_can_be_a_column(spark):
    """Dots, backticks, quotes, spaces, an empty text and spellings that differ by case, as regions and as categories."""
    values = ["St. Petersburg", "MOSCOW", "Moscow", "moscow", "a`b", "it's", "", " x", "x y", "Москва", "size", "a.b", "a_b", "type_town"]
    t = mini_tables(spark)
    people = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)] + [(99, None, 99)], "user_id long, region string, ordinal long")
    receipts = spark.createDataFrame([(i, v) for i, v in enumerate(values)] * 2 + [(0, "a.b"), (1, None)],
                                     "user_id long, category_name string").withColumns(
        {"date_operated": F.lit("2025-06-01"), "items_count": F.lit(1.0), "items_cost": F.lit(2.0)})
    tables = {**t, "people": people.withColumns({"gender_cd": F.lit("M"), "age_bucket": F.lit("25")}), "receipts": receipts}
    categories, _ = FT.feature_categories(tables)
    wide = FT.feature_table(tables, categories=categories)
    assert len({c.lower() for c in wide.columns}) == len(wide.columns)
    rows = {r["user_id"]: r.asDict() for r in wide.collect()}
    region, cat = categories.of("region"), categories.of("cat")
    assert set(region) == set(cat) == set(values)
    assert region["MOSCOW"] == "region_MOSCOW" and region["x y"] == "region_x y" and region["size"] != "region_size"
    for i, v in enumerate(values):
        assert [rows[i][region[w]] for w in values] == [int(v == w) for w in values]
        assert [rows[i][cat[w]] for w in values] == [2 * (v == w) + (i == 0 and w == "a.b") for w in values]
    assert all(rows[99][region[w]] == 0 for w in values)
    pivot = {r["user_id"]: r.asDict() for r in FT.category_pivot(receipts).collect()}
    assert pivot[0] == {"user_id": 0} | {cat[w]: 2 * (w == values[0]) + (w == "a.b") for w in values}
    assert FT.one_hot(people, "region", "region").count() == len(values) + 1
    # the sinks take such names, too, and a later run keeps the names of an earlier one
    with tempfile.TemporaryDirectory() as out:
        FS.sink_features(wide, spark.range(1), out, categories)
        assert set(region.values()) <= set(FS.load_features(spark, out)[0].columns)
        kept = FS.load_categories(spark, out)
    later = kept.extended({"region": ["MoScOw", *values], "cat": ["new"]})
    assert kept == categories and later.names.items() >= kept.names.items() and later.of("cat")["new"] == "cat_new"
    assert len({n.lower() for n in later.names.values()}) == len(later.names)


def test_transactions_travel_as_narrow_rows_and_give_the_same_features(spark):
    rows = [(1, 1, 10, "2024-03-30", 5, "1k+", "Y"), (None, 1, 10, "2024-03-01", 5, "5k+", "N"), (3, 1, 11, "2024-01-15", None, "100k+", "1"),
            (4, 1, None, None, 6, None, None), (5, 2, 10, "2020-01-01", 7, "<1k", "Y"), (6, 2, 10, "2024-03-31", 7, "<1k", "Y"),
            (7, 3, None, None, None, None, None), (8, None, 10, "2024-03-31", 5, "1k+", "Y"), (9, 1, 10, "2024-03-30", 5, "1k+", "Y")]
    tx = spark.createDataFrame(rows, "transaction_id long, user_id long, merchant_id_tx long, event_date string, brand_dk long, "
                                     "amount_bucket string, online_transaction_flg string")
    ref = FT.reference_timestamp(tx)
    got = {r["user_id"]: r.asDict() for r in FT.tx_features(tx, ref).collect()}
    parts = FT.tx_window_features(tx, ref), FT.tx_total_features(tx)
    want = {r["user_id"]: r.asDict() for r in parts[0].join(parts[1], "user_id").collect()}
    assert set(got) == set(want) == {1, 2, 3}
    for user, r in want.items():
        assert got[user] == pytest.approx(r, abs=1e-6), user
    assert [f.dataType for f in FT.tx_features(tx, ref).schema] == [f.dataType for f in parts[0].join(parts[1], "user_id").schema]
    assert len(FT._tx_parts(FT._tx_prepared(tx), ref, [7, 30, 90]).columns) <= 8
