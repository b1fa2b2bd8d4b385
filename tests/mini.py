"""The ten-table mini data set of FIXTURES.md section 2, as DataFrames."""

from cohortex.functions import fixed_values as FV

PEOPLE = [(1, "25", "M", "MOSCOW", "2025-06-01"), (2, "30", "F", "MOSCOW", "2025-06-02"),
          (3, "35", "M", "SPB", "2025-06-03"), (4, "25", "F", "SPB", "2025-06-04"),
          (5, "40", "M", "MOSCOW", "2025-06-05")]
SEGMENTS = [(1, "m_02 (35)", "urban", "0", "1", "0", None), (2, "m_03 (28)", "urban", "0", "0", "0", None),
            (3, "t_02 (42)", "town", "1", "0", "0", None), (4, "u_05 (31)", "urban", "0", "1", "1", None),
            (5, "m_01 (55)", "urban", "1", "0", "1", "vip")]
MERCHANT = [(75, "ACT", 18601), (110, "ACT", 18937)]
OFFER = [(42, 75, "2025-06-03", "2025-06-30", "offer 42"), (99, 110, "2025-07-01", "2025-07-31", "offer 99")]
TRANSACTION = [(1, 1, 75, "2025-06-01", "1k+", "N", 18601), (2, 1, 75, "2025-06-02", "5k+", "Y", 18601),
               (3, 2, 110, "2025-06-01", "1k+", "N", 18937), (4, 3, 75, "2025-06-03", "10k+", "N", 18601),
               (5, 4, 110, "2025-06-04", "1k+", "Y", 18937), (6, 5, 75, "2025-06-05", "5k+", "N", 18601)]
ACCOUNTS = [(1, "CARD", "ACT"), (2, "CARD", "ACT"), (3, "SAVINGS", "ACT"), (4, "CARD", "ACT"),
            (5, "PREMIUM", "ACT")]
SEENS = [(1, 42, "2025-06-03"), (2, 99, "2025-06-03"), (3, 42, "2025-06-04")]
ACTIVATION = [(1, 42, "2025-06-05"), (3, 42, "2025-06-10")]
REWARD = [(1, 42, "2025-06-15", "100")]
RECEIPTS = [(1, "2025-06-01", "PRODUCT", 5.0, 1500.0), (2, "2025-06-02", "FOOD", 3.0, 800.0),
            (3, "2025-06-03", "PRODUCT", 2.0, 2000.0)]

SCHEMAS = {
    "people": "user_id long, age_bucket string, gender_cd string, region string, last_activity_day string",
    "segments": ("user_id long, segment string, region_size string, auto string, traveler string, "
                 "entrepreneur string, vip_status string"),
    "merchant": "merchant_id_offer long, merchant_status string, brand_dk long",
    "offer": "offer_id long, merchant_id_offer long, start_date string, end_date string, offer_text string",
    "transaction": ("transaction_id long, user_id long, merchant_id_tx long, event_date string, "
                    "amount_bucket string, online_transaction_flg string, brand_dk long"),
    "financial_account": "user_id long, product_cd string, account_status_cd string",
    "offer_seens": "user_id long, offer_id long, start_date string",
    "offer_activation": "user_id long, offer_id long, activation_date string",
    "offer_reward": "user_id long, offer_id long, event_date string, reward_amt string",
    "receipts": "user_id long, date_operated string, category_name string, items_count double, items_cost double",
}
ROWS = {"people": PEOPLE, "segments": SEGMENTS, "merchant": MERCHANT, "offer": OFFER,
        "transaction": TRANSACTION, "financial_account": ACCOUNTS, "offer_seens": SEENS,
        "offer_activation": ACTIVATION, "offer_reward": REWARD, "receipts": RECEIPTS}


def mini_tables(spark):
    """Logical tables with an ``ordinal`` (arrival order) column appended."""
    out = {}
    for name in FV.TABLE_NAMES:
        rows = [tuple(r) + (i,) for i, r in enumerate(ROWS[name])]
        out[name] = spark.createDataFrame(rows, SCHEMAS[name] + ", ordinal long")
    return out
