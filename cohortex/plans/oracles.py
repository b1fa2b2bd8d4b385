"""DuckDB oracle SQL, one text per registered query of the same name.

Each text rebuilds the logical tables from the driver's views with the
binding CTEs and states the operator's semantics directly in SQL.
"""

from __future__ import annotations

import hashlib

from cohortex.plans.sql_bindings import AMOUNT_SQL, ONLINE_SQL, rounded, with_

ORACLES: dict[str, str] = {}

TS = "'%Y-%m-%d %H:%M:%S'"
REF_TX = "ref AS (SELECT TRY_CAST(max(event_date) AS TIMESTAMP) AS r FROM tx)"
AGE_SQL = ("CASE CAST(age_bucket AS VARCHAR) WHEN '<18' THEN 0 WHEN '15' THEN 0 WHEN '18-24' THEN 1 "
           "WHEN '25' THEN 1 WHEN '25-34' THEN 2 WHEN '30' THEN 2 WHEN '35' THEN 2 WHEN '35-44' THEN 3 "
           "WHEN '40' THEN 3 WHEN '45' THEN 3 WHEN '45-54' THEN 4 WHEN '50' THEN 4 WHEN '55' THEN 4 "
           "WHEN '55+' THEN 5 WHEN '60' THEN 5 WHEN '65' THEN 5 ELSE -1 END")
GENDER_SQL = "CASE gender_cd WHEN 'M' THEN 1 WHEN 'F' THEN 0 ELSE -1 END"
DAYS_SQL = ("CAST(coalesce(floor(epoch(TIMESTAMP '2026-02-18 00:00:00' - TRY_CAST(last_activity_day AS TIMESTAMP))"
            " / 86400), 999) AS INTEGER)")
SEG_CODE_SQL = "nullif(regexp_extract(segment, '^([a-z]_\\d{2})', 1), '')"
SEG_RANK_SQL = "coalesce(TRY_CAST(nullif(regexp_extract(segment, '\\((\\d+)\\)', 1), '') AS DOUBLE), 0.0)"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# ---------------------------------------------------------------- scalars

oracle("reference_date", with_("tx") + "SELECT max(event_date) AS reference_date FROM tx")

oracle("encode_maps", with_("people") + f"""
SELECT user_id, CAST({GENDER_SQL} AS INTEGER) AS gender_encoded, CAST({AGE_SQL} AS INTEGER) AS age_encoded
FROM people""")

oracle("encode_amounts", with_("tx") + f"""
SELECT transaction_id, user_id, {AMOUNT_SQL} AS amount_numeric, CAST({ONLINE_SQL} AS INTEGER) AS online_flag
FROM tx""")

oracle("days_since", with_("people") + f"SELECT user_id, {DAYS_SQL} AS days_since_activity FROM people")

oracle("segment_parse", rounded(with_("segments") + f"""
SELECT user_id, ordinal, {SEG_CODE_SQL} AS segment_code, {SEG_RANK_SQL} AS segment_rank FROM segments""",
                                {"segment_rank": 6}))

oracle("lenient_parse", rounded(with_("offers", "rewards", "segments") + f"""
SELECT 'offer' AS source, offer_id AS id,
       strftime(TRY_CAST(start_date AS TIMESTAMP), {TS}) AS start_ts,
       strftime(TRY_CAST(end_date AS TIMESTAMP), {TS}) AS end_ts,
       CAST(NULL AS DOUBLE) AS amount
FROM offers
UNION ALL
SELECT 'reward', ordinal, strftime(TRY_CAST(event_date AS TIMESTAMP), {TS}), CAST(NULL AS VARCHAR),
       TRY_CAST(reward_amt AS DOUBLE)
FROM rewards
UNION ALL
SELECT 'segment', ordinal, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), TRY_CAST(auto AS DOUBLE)
FROM segments""", {"amount": 6}))


# --------------------------------------------------------------- features

def _tx_windows_sql(windows=(7, 30, 90)) -> str:
    cols = []
    for d in windows:
        w = f"FILTER (WHERE ts >= r - INTERVAL {d} DAY)"
        cols += [f"count(transaction_id) {w} AS tx_count_{d}d",
                 f"coalesce(sum(amount) {w}, 0.0) AS tx_amount_sum_{d}d",
                 f"coalesce(avg(amount) {w}, 0.0) AS tx_amount_avg_{d}d",
                 f"coalesce(avg(online) {w}, 0.0) AS online_share_{d}d",
                 f"count(DISTINCT merchant) {w} AS unique_merchants_{d}d"]
    return ",\n  ".join(cols)


TX_PREP = f"""t AS (
  SELECT user_id, merchant_id_tx AS merchant, brand_dk AS brand, TRY_CAST(event_date AS TIMESTAMP) AS ts,
         {AMOUNT_SQL} AS amount, {ONLINE_SQL} AS online, transaction_id
  FROM tx)"""

TX_WINDOW_SQL = with_("tx", extra=TX_PREP + ",\n" + REF_TX) + f"""
SELECT user_id,
  {_tx_windows_sql()}
FROM t CROSS JOIN ref WHERE user_id IS NOT NULL GROUP BY user_id"""

TX_TOTAL_SQL = with_("tx", extra=TX_PREP) + """
SELECT user_id,
  count(transaction_id) AS tx_count_total,
  sum(amount) AS tx_amount_sum_total,
  avg(amount) AS tx_amount_avg_total,
  coalesce(stddev_samp(amount), 0.0) AS tx_amount_std_total,
  CAST(avg(online) AS DOUBLE) AS online_share_total,
  count(DISTINCT merchant) AS unique_merchants_total,
  count(DISTINCT brand) AS unique_brands_total
FROM t WHERE user_id IS NOT NULL GROUP BY user_id"""

_TXW = {f"{m}_{d}d": 6 for d in (7, 30, 90) for m in ("tx_amount_sum", "tx_amount_avg", "online_share")}
_TXT = {c: 6 for c in ("tx_amount_sum_total", "tx_amount_avg_total", "tx_amount_std_total", "online_share_total")}
oracle("tx_window_features", rounded(TX_WINDOW_SQL, _TXW))
oracle("tx_total_features", rounded(TX_TOTAL_SQL, _TXT))


def _receipt_sql(windows=(30, 90)) -> str:
    cols = []
    for d in windows:
        w = f"FILTER (WHERE ts >= r - INTERVAL {d} DAY)"
        cols += [f"count(*) {w} AS receipts_count_{d}d",
                 f"coalesce(sum(items_count) {w}, 0.0) AS receipts_items_{d}d",
                 f"coalesce(sum(items_cost) {w}, 0.0) AS receipts_cost_{d}d"]
    return ",\n  ".join(cols)


RECEIPT_SQL = with_("tx", "receipts", extra=REF_TX + """,
rc AS (SELECT user_id, TRY_CAST(date_operated AS TIMESTAMP) AS ts, CAST(items_count AS DOUBLE) AS items_count,
              CAST(items_cost AS DOUBLE) AS items_cost FROM receipts)""") + f"""
SELECT user_id,
  {_receipt_sql()}
FROM rc CROSS JOIN ref WHERE user_id IS NOT NULL GROUP BY user_id"""
_RC = {f"receipts_{m}_{d}d": 6 for d in (30, 90) for m in ("items", "cost")}
oracle("receipt_window_features", rounded(RECEIPT_SQL, _RC))

# The columns that the bindings' values give (all of them occur from sf0.01 on): a view cannot store a
# PIVOT that looks its values up. A value with other characters than letters and digits, or with the
# same letters as one before it, is named by them and the head of its md5.
CATEGORIES = ["FOOD", "Food_" + hashlib.md5(b"Food").hexdigest()[:8], "PRODUCT", "Travel_ etc__" + hashlib.md5(b"Travel, etc.").hexdigest()[:8]]
REGIONS = ["AUTOMOBILE", "BUILDING", "Building_" + hashlib.md5(b"Building").hexdigest()[:8],
           "Mach_inery_" + hashlib.md5(b"Mach`inery").hexdigest()[:8], "St_ Petersburg_" + hashlib.md5(b"St. Petersburg").hexdigest()[:8]]
SEGMENT_CODES = [f"{letter}_{nation:02d}" for letter in "mrtu" for nation in range(25)]
REGION_TYPES = ["rural", "town", "urban"]


def _in(*prefixed: tuple[str, list[str]]) -> str:
    return "IN (" + ", ".join(f"'{prefix}{v}'" for prefix, values in prefixed for v in values) + ")"


def _name_sql(prefix: str, c: str, later: str = "'Building', 'Food'") -> str:
    return (f"'{prefix}' || CASE WHEN regexp_full_match({c}, '[A-Za-z0-9_ -]+') AND {c} NOT IN ({later}) THEN {c} "
            f"ELSE regexp_replace({c}, '[^A-Za-z0-9_ -]', '_', 'g') || '_' || md5({c})[:8] END")


_CATS = _in(("cat_", CATEGORIES))
_REGIONS = _in(("region_", REGIONS))
_SEGS = _in(("seg_", SEGMENT_CODES), ("region_type_", REGION_TYPES))

CATEGORY_SQL = with_("receipts") + f"""
SELECT * FROM (
  PIVOT (SELECT user_id, {_name_sql('cat_', 'category_name')} AS cat FROM receipts
         WHERE user_id IS NOT NULL AND category_name IS NOT NULL)
  ON cat {_CATS} USING count(*) GROUP BY user_id)"""
oracle("category_pivot", CATEGORY_SQL)

ACCOUNT_SQL = with_("accounts") + """
SELECT user_id, count(DISTINCT product_cd) AS num_products,
       count(*) FILTER (WHERE account_status_cd = 'ACT') AS active_accounts
FROM accounts WHERE user_id IS NOT NULL GROUP BY user_id"""
oracle("account_features", ACCOUNT_SQL)

SEGMENT_AGG = f"""seg_rows AS (
  SELECT user_id, ordinal, {SEG_CODE_SQL} AS segment_code, {SEG_RANK_SQL} AS segment_rank,
         region_size, vip_status, TRY_CAST(auto AS DOUBLE) AS auto, TRY_CAST(traveler AS DOUBLE) AS traveler,
         TRY_CAST(entrepreneur AS DOUBLE) AS entrepreneur
  FROM segments),
seg AS (
  SELECT user_id,
         arg_min(segment_code, ordinal) FILTER (WHERE segment_code IS NOT NULL) AS segment_code,
         avg(segment_rank) AS segment_rank,
         arg_min(region_size, ordinal) FILTER (WHERE region_size IS NOT NULL) AS region_size,
         avg(auto) AS auto, avg(traveler) AS traveler, avg(entrepreneur) AS entrepreneur,
         arg_min(vip_status, ordinal) FILTER (WHERE vip_status IS NOT NULL) AS vip_status
  FROM seg_rows WHERE user_id IS NOT NULL GROUP BY user_id)"""
_SEG = {c: 6 for c in ("segment_rank", "auto", "traveler", "entrepreneur")}
oracle("segment_features", rounded(with_("segments", extra=SEGMENT_AGG) + "SELECT * FROM seg", _SEG))

ONE_HOT_SQL = with_("segments", "people", extra=SEGMENT_AGG) + f"""
SELECT user_id, CAST(coalesce(COLUMNS(* EXCLUDE (user_id)), 0) AS INTEGER) FROM (
  SELECT * FROM (SELECT user_id FROM people) u
  LEFT JOIN (PIVOT (SELECT user_id, {_name_sql('region_', 'region')} AS k FROM people WHERE region IS NOT NULL)
             ON k {_REGIONS} USING count(*) GROUP BY user_id) p USING (user_id)
  LEFT JOIN (PIVOT (SELECT user_id, 'seg_' || segment_code AS k FROM seg WHERE segment_code IS NOT NULL
                    UNION ALL
                    SELECT user_id, 'region_type_' || region_size FROM seg WHERE region_size IS NOT NULL)
             ON k {_SEGS} USING count(*) GROUP BY user_id) s USING (user_id))"""
oracle("one_hot", ONE_HOT_SQL)

# of BUILDING and Building the second was there first
oracle("feature_dictionary", with_("segments", "people", "receipts", extra=SEGMENT_AGG) + "\nUNION\n".join(
    f"SELECT '{feature}' AS feature, {c} AS value, {_name_sql(feature + '_', c, later)} AS name FROM {source} WHERE {c} IS NOT NULL"
    for feature, c, source, later in (("region", "region", "people", "'BUILDING'"), ("seg", "segment_code", "seg", "''"),
                                      ("region_type", "region_size", "seg", "''"), ("cat", "category_name", "receipts", "'Food'"))))

OFFER_AGG = """sa AS (
  SELECT user_id, count(offer_id) AS offers_seen_count,
         arg_min(start_date, ordinal) FILTER (WHERE start_date IS NOT NULL) AS first_offer_date
  FROM seens WHERE user_id IS NOT NULL GROUP BY user_id),
aa AS (
  SELECT user_id, count(offer_id) AS offers_activated_count,
         arg_min(activation_date, ordinal) FILTER (WHERE activation_date IS NOT NULL) AS first_activation_date
  FROM activations WHERE user_id IS NOT NULL GROUP BY user_id),
ra AS (
  SELECT user_id, count(offer_id) AS rewards_count,
         sum(coalesce(TRY_CAST(reward_amt AS DOUBLE), 0.0)) AS total_reward_amt
  FROM rewards WHERE user_id IS NOT NULL GROUP BY user_id)"""

oracle("offer_features", with_("people", "seens", "activations", "rewards", extra=OFFER_AGG) + """
SELECT p.user_id,
       coalesce(sa.offers_seen_count, 0) AS offers_seen_count, sa.first_offer_date,
       coalesce(aa.offers_activated_count, 0) AS offers_activated_count, aa.first_activation_date,
       coalesce(ra.rewards_count, 0) AS rewards_count,
       round(coalesce(ra.total_reward_amt, 0.0), 2) AS total_reward_amt
FROM people p LEFT JOIN sa ON p.user_id = sa.user_id LEFT JOIN aa ON p.user_id = aa.user_id
LEFT JOIN ra ON p.user_id = ra.user_id""")


def _feature_table_sql() -> str:
    def dbl(src, cols):
        return [f"round(coalesce({src}.{c}, 0.0), 6) AS {c}" for c in cols]

    def cnt(src, cols):
        return [f"coalesce({src}.{c}, 0) AS {c}" for c in cols]

    wins = (7, 30, 90)
    txw_cnt = [f"{m}_{d}d" for d in wins for m in ("tx_count", "unique_merchants")]
    txw_dbl = [f"{m}_{d}d" for d in wins for m in ("tx_amount_sum", "tx_amount_avg", "online_share")]
    txt_cnt = ["tx_count_total", "unique_merchants_total", "unique_brands_total"]
    txt_dbl = ["tx_amount_sum_total", "tx_amount_avg_total", "tx_amount_std_total", "online_share_total"]
    rc_cnt = [f"receipts_count_{d}d" for d in (30, 90)]
    rc_dbl = [f"receipts_{m}_{d}d" for d in (30, 90) for m in ("items", "cost")]
    cols = (["p.user_id", "p.age_bucket", "p.gender_cd", "p.region",
             f"strftime(TRY_CAST(p.last_activity_day AS TIMESTAMP), {TS}) AS last_activity_day",
             f"CAST({GENDER_SQL.replace('gender_cd', 'p.gender_cd')} AS INTEGER) AS gender_encoded",
             f"CAST({AGE_SQL.replace('age_bucket', 'p.age_bucket')} AS INTEGER) AS age_encoded",
             DAYS_SQL.replace("last_activity_day", "p.last_activity_day") + " AS days_since_activity",
             "oh.* EXCLUDE (user_id)",
             "seg.segment_code", "seg.region_size", "seg.vip_status"]
            + dbl("seg", ["segment_rank", "auto", "traveler", "entrepreneur"])
            + cnt("txw", txw_cnt) + dbl("txw", txw_dbl) + cnt("txt", txt_cnt) + dbl("txt", txt_dbl)
            + cnt("rcw", rc_cnt) + dbl("rcw", rc_dbl) + ["cat.* EXCLUDE (user_id)"]
            + cnt("acc", ["num_products", "active_accounts"])
            + cnt("sa", ["offers_seen_count"]) + ["sa.first_offer_date"]
            + cnt("aa", ["offers_activated_count"]) + ["aa.first_activation_date"]
            + cnt("ra", ["rewards_count"]) + dbl("ra", ["total_reward_amt"]))
    extra = ",\n".join([
        SEGMENT_AGG, TX_PREP, REF_TX,
        "txw AS (SELECT user_id,\n  " + _tx_windows_sql() + "\nFROM t CROSS JOIN ref WHERE user_id IS NOT NULL "
        "GROUP BY user_id)",
        "txt AS (SELECT user_id, count(transaction_id) AS tx_count_total, sum(amount) AS tx_amount_sum_total, "
        "avg(amount) AS tx_amount_avg_total, coalesce(stddev_samp(amount), 0.0) AS tx_amount_std_total, "
        "CAST(avg(online) AS DOUBLE) AS online_share_total, count(DISTINCT merchant) AS unique_merchants_total, "
        "count(DISTINCT brand) AS unique_brands_total FROM t WHERE user_id IS NOT NULL GROUP BY user_id)",
        "rc AS (SELECT user_id, TRY_CAST(date_operated AS TIMESTAMP) AS ts, CAST(items_count AS DOUBLE) AS "
        "items_count, CAST(items_cost AS DOUBLE) AS items_cost FROM receipts)",
        "rcw AS (SELECT user_id,\n  " + _receipt_sql() + "\nFROM rc CROSS JOIN ref WHERE user_id IS NOT NULL "
        "GROUP BY user_id)",
        "acc AS (SELECT user_id, count(DISTINCT product_cd) AS num_products, count(*) FILTER "
        "(WHERE account_status_cd = 'ACT') AS active_accounts FROM accounts WHERE user_id IS NOT NULL "
        "GROUP BY user_id)",
        OFFER_AGG])
    body = ONE_HOT_SQL.split("SELECT user_id, CAST(coalesce", 1)[1]
    one_hot_sub = "SELECT user_id, CAST(coalesce" + body
    cat_sub = ("SELECT user_id, coalesce(COLUMNS(* EXCLUDE (user_id)), 0) FROM ("
               "SELECT * FROM (SELECT user_id FROM people) u LEFT JOIN ("
               f"PIVOT (SELECT user_id, {_name_sql('cat_', 'category_name')} AS cat FROM receipts "
               "WHERE user_id IS NOT NULL AND category_name IS NOT NULL) ON cat " + _CATS + " USING count(*) GROUP BY user_id)"
               " c USING (user_id))")
    return (with_("people", "segments", "tx", "receipts", "accounts", "seens", "activations", "rewards",
                  extra=extra)
            + "SELECT " + ",\n  ".join(cols) + "\nFROM people p\n"
            + f"LEFT JOIN ({one_hot_sub}) oh ON p.user_id = oh.user_id\n"
            + "LEFT JOIN seg ON p.user_id = seg.user_id\n"
            + "LEFT JOIN txw ON p.user_id = txw.user_id\nLEFT JOIN txt ON p.user_id = txt.user_id\n"
            + "LEFT JOIN rcw ON p.user_id = rcw.user_id\n"
            + f"LEFT JOIN ({cat_sub}) cat ON p.user_id = cat.user_id\n"
            + "LEFT JOIN acc ON p.user_id = acc.user_id\nLEFT JOIN sa ON p.user_id = sa.user_id\n"
            + "LEFT JOIN aa ON p.user_id = aa.user_id\nLEFT JOIN ra ON p.user_id = ra.user_id")


oracle("feature_table", _feature_table_sql())


# ----------------------------------------------------------- interactions

INTERACTIONS_CTE = """inter AS (
  SELECT user_id, offer_id, max(confidence) AS confidence FROM (
    SELECT CAST(TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS BIGINT) AS user_id,
           CAST(TRY_CAST(CAST(offer_id AS VARCHAR) AS DOUBLE) AS BIGINT) AS offer_id, 1.0::DOUBLE AS confidence
    FROM activations WHERE TRY_CAST(activation_date AS TIMESTAMP) <= TIMESTAMP '2024-01-25 00:00:00'
    UNION ALL
    SELECT CAST(TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS BIGINT),
           CAST(TRY_CAST(CAST(offer_id AS VARCHAR) AS DOUBLE) AS BIGINT), 2.0::DOUBLE
    FROM rewards WHERE TRY_CAST(event_date AS TIMESTAMP) <= TIMESTAMP '2024-01-25 00:00:00')
  WHERE user_id IS NOT NULL AND offer_id IS NOT NULL
  GROUP BY user_id, offer_id)"""
SPLIT_CTE = """split AS (
  SELECT *, CASE WHEN substr(md5(CAST(user_id AS VARCHAR) || ':' || CAST(offer_id AS VARCHAR) || ':42'), 1, 8)
                      < '33333333' THEN 'test' ELSE 'train' END AS split
  FROM inter)"""

oracle("interactions", with_("activations", "rewards", extra=INTERACTIONS_CTE) + "SELECT * FROM inter")
oracle("split_holdout", with_("activations", "rewards", extra=INTERACTIONS_CTE + ",\n" + SPLIT_CTE)
       + "SELECT * FROM split")

MERCHANT_OFFERS_CTE = """mo AS (
  SELECT CAST(TRY_CAST(CAST(merchant_id_offer AS VARCHAR) AS DOUBLE) AS BIGINT) AS merchant_id,
         CAST(TRY_CAST(CAST(offer_id AS VARCHAR) AS DOUBLE) AS BIGINT) AS offer_id, ordinal
  FROM offers)"""
oracle("offer_merchant_map", with_("offers", extra=MERCHANT_OFFERS_CTE) + """
SELECT offer_id, arg_max(merchant_id, ordinal) AS merchant_id FROM mo
WHERE merchant_id IS NOT NULL AND offer_id IS NOT NULL GROUP BY offer_id""")
oracle("merchant_offer_counts", with_("offers", extra=MERCHANT_OFFERS_CTE) + """
SELECT merchant_id, count(*) AS n_offers, count(DISTINCT offer_id) AS n_distinct_offers FROM mo
WHERE merchant_id IS NOT NULL AND offer_id IS NOT NULL GROUP BY merchant_id""")

BRAND_MERCHANT_CTE = """bm AS (
  SELECT brand_dk, arg_max(merchant_id, ordinal) AS merchant_id FROM (
    SELECT coalesce(CAST(TRY_CAST(CAST(brand_dk AS VARCHAR) AS DOUBLE) AS BIGINT), 0) AS brand_dk,
           coalesce(CAST(TRY_CAST(CAST(merchant_id_offer AS VARCHAR) AS DOUBLE) AS BIGINT), 0) AS merchant_id,
           ordinal
    FROM merchants) GROUP BY brand_dk),
existing AS (
  SELECT DISTINCT bm.merchant_id, t.user_id
  FROM (SELECT user_id, coalesce(CAST(TRY_CAST(CAST(brand_dk AS VARCHAR) AS DOUBLE) AS BIGINT), 0) AS brand_dk
        FROM tx) t
  JOIN bm ON t.brand_dk = bm.brand_dk
  WHERE bm.merchant_id > 0)"""
oracle("existing_customers", with_("tx", "merchants", extra=BRAND_MERCHANT_CTE) + "SELECT * FROM existing")

oracle("known_entities", with_("offers", "merchants") + """
SELECT DISTINCT kind, id FROM (
  SELECT 'offer' AS kind, CAST(TRY_CAST(CAST(offer_id AS VARCHAR) AS DOUBLE) AS BIGINT) AS id FROM offers
  UNION ALL
  SELECT 'merchant', CAST(TRY_CAST(CAST(merchant_id_offer AS VARCHAR) AS DOUBLE) AS BIGINT) FROM merchants)
WHERE id IS NOT NULL""")


# ---------------------------------------------------------------- quality

from cohortex.operators.quality import RULES, allowed_values, check_name  # noqa: E402
from cohortex.plans.sql_bindings import CTE_NAME  # noqa: E402

_ALL_CTES = ("people", "segments", "tx", "offers", "merchants", "accounts", "seens", "activations", "rewards",
             "receipts")
_BAD_SQL = {
    "no_null": " null values in {column}", "unique": " duplicate values in {column}",
    "valid_values": " rows with invalid values in {column}", "valid_pattern": " values don't match pattern {pattern}",
    "valid_date": " invalid dates in {column}", "date_order": " records with start_date > end_date",
}
_GOOD_SQL = {
    "no_null": "No null values", "unique": "All values unique", "valid_values": "All values valid",
    "valid_pattern": "All values match pattern", "valid_date": "All dates valid",
    "date_order": "All date ranges valid",
}


def _violation_sql(kind, a):
    txt = lambda c: f"CAST({c} AS VARCHAR)"
    if kind == "no_null":
        return f"{a['column']} IS NULL"
    if kind == "valid_values":
        vals = ", ".join("'" + v.replace("'", "''") + "'" for v in allowed_values(a["values"]))
        c = txt(a["column"])
        return f"{c} IS NOT NULL AND {c} <> '' AND {c} NOT IN ({vals})"
    if kind == "valid_pattern":
        return f"NOT coalesce(regexp_matches({txt(a['column'])}, '{a['pattern']}'), false)"
    if kind == "valid_date":
        c = txt(a["column"])
        return f"{c} IS NOT NULL AND {c} <> '' AND TRY_CAST({c} AS TIMESTAMP) IS NULL"
    if kind == "date_order":
        return f"TRY_CAST({a['start']} AS TIMESTAMP) > TRY_CAST({a['end']} AS TIMESTAMP)"
    raise ValueError(kind)


def _check_sql(table: str, i: int, kind: str, a: dict) -> str:
    cte = CTE_NAME[table]
    name = check_name(kind, a)
    if kind == "min_rows":
        n = "count(*)"
        ok = f"n >= {a['min']}"
        failed = f"CASE WHEN n >= {a['min']} THEN 0 ELSE {a['min']} - n END"
        details = f"'Table has ' || CAST(n AS VARCHAR) || ' rows, minimum required: {a['min']}'"
    else:
        if kind == "unique":
            c = a["column"]
            n = (f"count(*) - count(DISTINCT {c}) - coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0)")
        else:
            n = f"count(*) FILTER (WHERE {_violation_sql(kind, a)})"
        ok, failed = "n = 0", "n"
        bad = _BAD_SQL[kind].format(**a).replace("'", "''")
        details = f"CASE WHEN n = 0 THEN '{_GOOD_SQL[kind]}' ELSE CAST(n AS VARCHAR) || '{bad}' END"
    return (f"SELECT '{table}' AS table_name, {i} AS check_no, '{name}' AS check_name, {ok} AS success, "
            f"CAST({failed} AS BIGINT) AS failed, {details} AS details FROM (SELECT {n} AS n FROM {cte})")


def _quality_checks_sql() -> str:
    parts = []
    for table, rules in RULES.items():
        parts.append(f"SELECT '{table}' AS table_name, 0 AS check_no, 'required_columns' AS check_name, "
                     "true AS success, CAST(0 AS BIGINT) AS failed, 'All required columns present' AS details")
        for i, (kind, a) in enumerate(rules["checks"], start=1):
            parts.append(_check_sql(table, i, kind, a))
    return "checks AS (\n" + "\nUNION ALL\n".join(parts) + ")"


QUALITY_CTE = _quality_checks_sql()
oracle("quality_checks", with_(*_ALL_CTES, extra=QUALITY_CTE) + "SELECT * FROM checks")
oracle("quality_report", with_(*_ALL_CTES, extra=QUALITY_CTE) + """
SELECT coalesce(table_name, '__all__') AS table_name, count(*) AS checks_total,
       count(*) FILTER (WHERE success) AS checks_passed, count(*) FILTER (WHERE NOT success) AS checks_failed,
       bool_and(success) AS valid
FROM checks GROUP BY ROLLUP (table_name)""")


def _violations_sql() -> str:
    parts = []
    for table, rules in RULES.items():
        for kind, a in rules["checks"]:
            if kind in ("min_rows", "unique"):
                continue
            parts.append(f"SELECT '{table}' AS table_name, '{check_name(kind, a)}' AS check_name, "
                         f"CAST(ordinal AS VARCHAR) AS key FROM {CTE_NAME[table]} WHERE {_violation_sql(kind, a)}")
    return "\nUNION ALL\n".join(parts)


oracle("quality_violations", with_(*_ALL_CTES) + _violations_sql())


def _duplicates_sql() -> str:
    parts = []
    for table, rules in RULES.items():
        for kind, a in rules["checks"]:
            if kind == "unique":
                c = a["column"]
                parts.append(f"SELECT '{table}' AS table_name, '{check_name(kind, a)}' AS check_name, "
                             f"CAST({c} AS VARCHAR) AS key, count(*) - 1 AS surplus FROM {CTE_NAME[table]} "
                             f"GROUP BY {c} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


oracle("duplicate_keys", with_(*_ALL_CTES) + _duplicates_sql())


# ------------------------------------------------------------------ drift

_DRIFT_COLS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_QS = "[" + ", ".join(f"{i / 10:.1f}" for i in range(11)) + "]"
# numpy's linear percentile, stated directly: levels linspace(0, 100, 11) / 100 as doubles
_QS_DOUBLE = "[" + ", ".join(f"{i / 10:.1f}::DOUBLE" for i in range(11)) + "]"
def _psi_cte(columns: list[str]) -> str:
    return f"""sides AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'reference' ELSE 'current' END AS side,
         {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)}
  FROM lineitem),
long AS (
  SELECT * FROM (UNPIVOT sides ON {", ".join(columns)} INTO NAME column_name VALUE value)
  WHERE value IS NOT NULL AND NOT isnan(value)),
ordered AS (
  SELECT column_name, list_sort(list(value)) AS xs, count(*) AS n
  FROM long WHERE side = 'reference' GROUP BY column_name),
virt AS (
  SELECT column_name, xs, n, (n - 1)::DOUBLE * q AS v
  FROM ordered CROSS JOIN (SELECT unnest({_QS_DOUBLE}) AS q)),
nb AS (
  SELECT column_name, xs, v - floor(v) AS t,
         CASE WHEN v >= (n - 1)::DOUBLE THEN n - 1 ELSE CAST(floor(v) AS BIGINT) END AS lo,
         CASE WHEN v >= (n - 1)::DOUBLE THEN n - 1 ELSE CAST(floor(v) AS BIGINT) + 1 END AS hi
  FROM virt),
edges AS (
  SELECT column_name,
         list_distinct(list(CASE WHEN t >= 0.5 THEN xs[hi + 1] - (xs[hi + 1] - xs[lo + 1]) * (1 - t)
                                 ELSE xs[lo + 1] + (xs[hi + 1] - xs[lo + 1]) * t END)) AS e
  FROM nb GROUP BY column_name),
edges_sorted AS (SELECT column_name, list_sort(e) AS e FROM edges),
binned AS (
  SELECT l.column_name, l.side,
         CASE WHEN l.value < e[1] OR l.value > e[len(e)] THEN NULL
              WHEN l.value = e[len(e)] THEN len(e) - 2
              ELSE len(list_filter(e, lambda x: x <= l.value)) - 1 END AS bin
  FROM long l JOIN edges_sorted USING (column_name)),
totals AS (
  SELECT column_name, count(*) FILTER (WHERE side = 'reference') AS nr,
         count(*) FILTER (WHERE side = 'current') AS nc
  FROM binned GROUP BY column_name),
grid AS (
  SELECT column_name, unnest(range(0, len(e) - 1)) AS bin FROM edges_sorted WHERE len(e) >= 2),
cnt AS (
  SELECT column_name, bin, count(*) FILTER (WHERE side = 'reference') AS r,
         count(*) FILTER (WHERE side = 'current') AS c
  FROM binned WHERE bin IS NOT NULL GROUP BY column_name, bin),
psi AS (
  SELECT g.column_name,
         CASE WHEN any_value(t.nr) = 0 OR any_value(t.nc) = 0 THEN 0.0 ELSE
         sum(((coalesce(c.c, 0) + 1) / (t.nc + 10.0) - (coalesce(c.r, 0) + 1) / (t.nr + 10.0))
             * ln(((coalesce(c.c, 0) + 1) / (t.nc + 10.0)) / ((coalesce(c.r, 0) + 1) / (t.nr + 10.0)))) END AS psi
  FROM grid g JOIN totals t USING (column_name) LEFT JOIN cnt c USING (column_name, bin)
  GROUP BY g.column_name),
per_col AS (
  SELECT es.column_name, coalesce(psi.psi, 0.0) AS psi, coalesce(psi.psi, 0.0) > 0.5 AS drifted
  FROM edges_sorted es LEFT JOIN psi USING (column_name))"""


PSI_CTE = _psi_cte(_DRIFT_COLS)
oracle("drift_psi", "WITH " + PSI_CTE + "\nSELECT column_name, round(psi, 6) AS psi, drifted FROM per_col")
# every numeric column that both sides have; the empty one counts as not drifted
oracle("drift_common_columns", "WITH " + _psi_cte(["l_orderkey", "l_partkey", "l_suppkey", *_DRIFT_COLS]) + """
SELECT column_name, round(psi, 6) AS psi, drifted FROM per_col
UNION ALL SELECT 'l_empty', 0.0, false""")
oracle("drift_report", "WITH " + PSI_CTE + """
SELECT (coalesce(count(*) FILTER (WHERE drifted) / count(*), 0) > 0.01 OR coalesce(avg(psi), 0) > 0.1)
         AS drift_detected,
       round(coalesce(avg(psi), 0), 4) AS drift_score,
       round(coalesce(count(*) FILTER (WHERE drifted) / count(*), 0), 4) AS drift_share,
       0.5::DOUBLE AS threshold,
       list_sort(coalesce(list(column_name) FILTER (WHERE drifted), [])) AS drifted_columns,
       count(*) AS n_columns_total,
       count(*) FILTER (WHERE drifted) AS n_columns_drifted,
       CAST(NULL AS VARCHAR) AS reference_version,
       true AS retrain
FROM per_col""")


# ------------------------------------------------------------- similarity

EMB_CTE = """nv AS (SELECT vec_id AS user_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nn AS (SELECT user_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v
       FROM nv),
seeds AS (SELECT label AS request_id, user_id FROM nv)"""

EXACT_CTE = EMB_CTE + """,
sizes AS (SELECT request_id, 10 AS top_n, 10 + count(*) AS k FROM seeds GROUP BY request_id),
pairs AS (
  SELECT s.request_id, s.user_id AS seed_id, u.user_id, list_cosine_similarity(sv.v, u.v) AS score
  FROM seeds s JOIN nv sv ON sv.user_id = s.user_id CROSS JOIN nv u),
lists AS (
  SELECT p.* FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, seed_id ORDER BY score DESC, user_id) AS rn
    FROM pairs) p JOIN sizes USING (request_id) WHERE rn <= k),
mean AS (
  SELECT request_id, user_id, avg(score) AS score, arg_max(seed_id, (score, -seed_id)) AS top_seed,
         max(score) AS top_seed_score
  FROM lists GROUP BY request_id, user_id),
cand AS (SELECT m.* FROM mean m ANTI JOIN seeds s ON m.request_id = s.request_id AND m.user_id = s.user_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, user_id) AS INTEGER) AS rank
  FROM cand)"""

oracle("similar_users", "WITH " + EXACT_CTE + """
SELECT request_id, user_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
oracle("audience_reasons", "WITH " + EXACT_CTE + """
SELECT request_id, user_id, round(score, 6) AS score, rank, top_seed, round(top_seed_score, 6) AS top_seed_score
FROM ranked WHERE rank <= 10""")

CENTROID_CTE = """cent AS (
  SELECT request_id, list(x ORDER BY pos) AS c FROM (
    SELECT request_id, pos, avg(x) AS x FROM (
      SELECT s.request_id, unnest(range(1, len(n.v) + 1)) AS pos, unnest(n.v) AS x
      FROM seeds s JOIN nn n USING (user_id))
    GROUP BY request_id, pos)
  GROUP BY request_id)"""

oracle("similar_users_centroid", "WITH " + EMB_CTE + ",\n" + CENTROID_CTE + """,
scored AS (
  SELECT c.request_id, n.user_id, list_dot_product(n.v, c.c) AS score
  FROM cent c CROSS JOIN nn n
  ANTI JOIN seeds s ON s.request_id = c.request_id AND s.user_id = n.user_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, user_id) AS INTEGER) AS rank
  FROM scored)
SELECT request_id, user_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")

oracle("audience_batch", with_("activations", "rewards", "offers", "merchants", "tx",
                               extra=INTERACTIONS_CTE + ",\n" + MERCHANT_OFFERS_CTE + ",\n" + BRAND_MERCHANT_CTE)
       + ", " + EMB_CTE.replace("seeds AS (SELECT label AS request_id, user_id FROM nv)", """om AS (
  SELECT offer_id, arg_max(merchant_id, ordinal) AS merchant_id FROM mo
  WHERE merchant_id IS NOT NULL AND offer_id IS NOT NULL GROUP BY offer_id),
requests AS (
  SELECT i.offer_id AS request_id, coalesce(om.merchant_id, 0) AS merchant_id, i.offer_id, 10 AS top_n
  FROM (SELECT DISTINCT offer_id FROM inter) i LEFT JOIN om USING (offer_id)),
known AS (SELECT DISTINCT CAST(TRY_CAST(CAST(offer_id AS VARCHAR) AS DOUBLE) AS BIGINT) AS offer_id FROM offers),
st AS (
  SELECT r.*, CASE WHEN r.merchant_id < 1 OR r.offer_id < 1 OR r.top_n < 1 OR r.top_n > 1000
                   THEN 'invalid_request' WHEN k.offer_id IS NULL THEN 'offer_not_found' ELSE 'ok' END AS status
  FROM requests r LEFT JOIN known k USING (offer_id)),
ok AS (SELECT * FROM st WHERE status = 'ok'),
direct AS (SELECT DISTINCT ok.request_id, i.user_id FROM ok JOIN inter i USING (offer_id)),
via AS (
  SELECT DISTINCT ok.request_id, i.user_id
  FROM ok ANTI JOIN direct d ON d.request_id = ok.request_id
  JOIN (SELECT DISTINCT merchant_id, offer_id FROM mo WHERE merchant_id IS NOT NULL AND offer_id IS NOT NULL) m
    ON m.merchant_id = ok.merchant_id
  JOIN inter i ON i.offer_id = m.offer_id),
seeds AS (SELECT * FROM direct UNION SELECT * FROM via),
excl AS (SELECT ok.request_id, e.user_id FROM ok JOIN existing e ON e.merchant_id = ok.merchant_id)""")
       + ",\n" + CENTROID_CTE + """,
scored AS (
  SELECT c.request_id, n.user_id, list_dot_product(n.v, c.c) AS score
  FROM cent c CROSS JOIN nn n
  ANTI JOIN seeds s ON s.request_id = c.request_id AND s.user_id = n.user_id
  ANTI JOIN excl x ON x.request_id = c.request_id AND x.user_id = n.user_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, user_id) AS INTEGER) AS rank
  FROM scored),
aud AS (
  SELECT r.request_id, ok.merchant_id, ok.offer_id, r.user_id, round(r.score, 6) AS score, r.rank, 'ok' AS status
  FROM ranked r JOIN ok USING (request_id) WHERE r.rank <= ok.top_n)
SELECT * FROM aud
UNION ALL
SELECT st.request_id, st.merchant_id, st.offer_id, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER),
       CASE WHEN st.status <> 'ok' THEN st.status
            WHEN st.request_id NOT IN (SELECT request_id FROM seeds) THEN 'no_seed' ELSE 'empty' END
FROM st WHERE st.request_id NOT IN (SELECT request_id FROM aud)""")


# ---------------------------------------------------------------- ranking

SIDES_CTE = (INTERACTIONS_CTE + ",\n" + SPLIT_CTE + """,
train AS (SELECT user_id, offer_id, confidence FROM split WHERE split = 'train'),
test AS (SELECT user_id, offer_id, confidence FROM split WHERE split = 'test')""")
_SIDES = with_("activations", "rewards", extra=SIDES_CTE)

oracle("train_metrics", _SIDES + """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT offer_id) AS n_items, count(*) AS n_interactions,
       64 AS factors, 5 AS iterations, 0.1::DOUBLE AS regularization FROM train""")

oracle("ground_truth_lists", _SIDES + """
SELECT user_id, offer_id, confidence,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, offer_id) AS INTEGER) AS position
FROM test""")

POP_CTE = """pop AS (SELECT offer_id, count(DISTINCT user_id) AS pop FROM train GROUP BY offer_id),
prank AS (SELECT offer_id, pop, row_number() OVER (ORDER BY pop DESC, offer_id) AS pos FROM pop),
tusers AS (SELECT DISTINCT user_id FROM test),
cand AS (
  SELECT u.user_id, p.offer_id, p.pop, p.pos FROM tusers u CROSS JOIN prank p
  ANTI JOIN train t ON t.user_id = u.user_id AND t.offer_id = p.offer_id),
pred AS (
  SELECT user_id, offer_id, CAST(pop AS DOUBLE) AS score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS INTEGER) AS rank
  FROM cand QUALIFY rank <= 100)"""
oracle("popularity_recommendations", with_("activations", "rewards", extra=SIDES_CTE + ",\n" + POP_CTE)
       + "SELECT * FROM pred")

oracle("map_at_k", with_("activations", "rewards", extra=SIDES_CTE + ",\n" + POP_CTE + """,
act AS (SELECT DISTINCT user_id, offer_id FROM test),
hits AS (
  SELECT p.user_id, p.rank, row_number() OVER (PARTITION BY p.user_id ORDER BY p.rank) AS hit_no
  FROM pred p JOIN act a ON a.user_id = p.user_id AND a.offer_id = p.offer_id),
ap AS (
  SELECT n.user_id, coalesce(h.s, 0.0) / least(n.n_actual, 100) AS ap,
         n.user_id NOT IN (SELECT user_id FROM pred) AS cold
  FROM (SELECT user_id, count(*) AS n_actual FROM act GROUP BY user_id) n
  LEFT JOIN (SELECT user_id, sum(hit_no / rank) AS s FROM hits GROUP BY user_id) h USING (user_id))""") + """
SELECT round(coalesce(avg(ap), 0.0), 6) AS map_at_k, count(*) AS num_test_users, 100 AS k,
       count(*) FILTER (WHERE cold) AS n_cold_users
FROM ap""")

oracle("recommend_topn_vectors", with_("activations", "rewards", extra=INTERACTIONS_CTE + """,
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
users AS (SELECT vec_id AS user_id, vec FROM v WHERE vec_id % 2 = 0),
items AS (SELECT vec_id AS offer_id, vec FROM v WHERE vec_id % 2 = 1),
seen AS (SELECT DISTINCT user_id * 2 AS user_id, offer_id * 2 + 1 AS offer_id FROM inter),
scored AS (
  SELECT u.user_id, i.offer_id, list_dot_product(u.vec, i.vec) AS score
  FROM users u CROSS JOIN items i
  ANTI JOIN seen s ON s.user_id = u.user_id AND s.offer_id = i.offer_id)""") + """
SELECT user_id, offer_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, offer_id) AS INTEGER) AS rank
FROM scored QUALIFY rank <= 10""")


# ------------------------------------------------- ingest, sources, sinks

_LOGICAL = ["people", "segments", "transaction", "offer", "merchant", "financial_account", "offer_seens",
            "offer_activation", "offer_reward", "receipts"]
COUNTS_CTE = "counts AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {CTE_NAME[t]}" for t in _LOGICAL) + ")"
_WITH_ALL = with_(*_ALL_CTES, extra=COUNTS_CTE)
_WIRE_COLUMNS = {
    "people": "user_id age_bucket gender_cd region last_activity_day",
    "segments": "user_id segment region_size auto traveler entrepreneur vip_status",
    "transaction": "transaction_id user_id merchant_id_tx event_date brand_dk amount_bucket online_transaction_flg",
    "offer": "offer_id merchant_id_offer start_date end_date offer_text",
    "merchant": "merchant_id_offer merchant_status brand_dk",
    "financial_account": "user_id product_cd account_status_cd open_month close_month",
    "offer_seens": "user_id offer_id start_date end_date",
    "offer_activation": "user_id offer_id activation_date",
    "offer_reward": "user_id offer_id event_date reward_amt",
    "receipts": "user_id date_operated category_name items_count items_cost",
}


def _record_sql(columns: str) -> str:
    """A record as JSON with sorted keys and every value as text."""
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || coalesce(CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR), 'null')"
                                         for c in sorted(columns.split())) + " || '}'"


def _numbered_sql(table: str, more: str) -> str:
    ties = ", ".join(f"CAST({c} AS VARCHAR) NULLS FIRST" for c in _WIRE_COLUMNS[table].split())
    return f"SELECT '{table}' AS t, row_number() OVER (ORDER BY ordinal, {ties}) - 1 AS i, {more} FROM {CTE_NAME[table]}"


# every table's batches under version v1, and the first batch of two tables under v2
BATCHES_CTE = "numbered AS (\n" + "\nUNION ALL\n".join(
    _numbered_sql(t, f"{_record_sql(c)} AS record") for t, c in _WIRE_COLUMNS.items()) + """),
v1 AS (
  SELECT t, CAST(i // 5000 + 1 AS INTEGER) AS batch_id, count(*) AS records_count,
         md5('[' || string_agg(record, ',' ORDER BY i) || ']') AS content_hash FROM numbered GROUP BY t, i // 5000),
batches AS (
  SELECT 'v1' AS version, t AS "table", batch_id, CAST(count(*) OVER (PARTITION BY t) AS INTEGER) AS total_batches,
         records_count, content_hash FROM v1
  UNION ALL
  SELECT 'v2', t, batch_id, CAST((SELECT count(*) FROM v1 w WHERE w.t = v1.t) AS INTEGER), records_count, content_hash
  FROM v1 WHERE batch_id = 1 AND t IN ('people', 'receipts'))"""

oracle("batch_assign", with_("accounts") + """
SELECT ordinal, CAST(floor((row_number() OVER (ORDER BY ordinal) - 1) / 5000) + 1 AS INTEGER) AS batch_id,
       CAST(ceil(count(*) OVER () / 5000.0) AS INTEGER) AS total_batches
FROM accounts""")
oracle("scan_catalog", _WITH_ALL + "SELECT table_name, n AS n_rows FROM counts")
oracle("ingest_batches", with_(*_ALL_CTES, extra=COUNTS_CTE + ",\n" + BATCHES_CTE) + "SELECT * FROM batches")
oracle("batch_manifest", with_(*_ALL_CTES, extra=COUNTS_CTE + ",\n" + BATCHES_CTE) + """
SELECT version, "table", count(DISTINCT batch_id) AS n_batches, sum(records_count) AS n_records,
       max(total_batches) AS total_batches,
       CAST(greatest(max(total_batches) - count(DISTINCT batch_id), 0) AS BIGINT) AS n_missing
FROM batches GROUP BY version, "table\"""")
oracle("rejected_batches", with_("people").rstrip() + """,
n AS (SELECT count(*) AS n FROM people),
bad(t, b, total) AS (VALUES ('no_such_table', 1, NULL), ('people', 0, NULL), ('people', 1, 0))
SELECT 'v1' AS version, t AS "table", b AS batch_id, CAST(coalesce(total, ceil(n / 5000.0)) AS INTEGER) AS total_batches,
       least(n, 5000) AS records_count FROM bad, n""")
oracle("missing_batches", with_(*_ALL_CTES, extra=COUNTS_CTE + ",\n" + BATCHES_CTE) + """
SELECT version, "table", batch_id FROM batches WHERE batch_id % 3 = 0 AND version = 'v1'
  AND batch_id <= (SELECT max(b.total_batches) FROM batches b WHERE b."table" = batches."table")""")
oracle("version_completeness", with_(*_ALL_CTES, extra=COUNTS_CTE).rstrip() + """,
got AS (SELECT 'v1' AS version, table_name FROM counts WHERE n > 0
        UNION ALL SELECT 'v2', table_name FROM counts WHERE n > 0 AND table_name IN ('people', 'receipts')),
per AS (SELECT version, count(*) AS n_tables, list(table_name) AS tables FROM got GROUP BY version)
SELECT version, n_tables,
       list_sort(list_filter(['people', 'transaction', 'offer', 'merchant'], lambda t: NOT list_contains(tables, t))) AS missing_tables,
       len(list_filter(['people', 'transaction', 'offer', 'merchant'], lambda t: NOT list_contains(tables, t))) = 0 AS is_complete
FROM per""")
oracle("commit_version", with_(*_ALL_CTES, extra="committed AS (\n" + "\nUNION ALL\n".join(
    _numbered_sql(t, f"CAST({c.split()[0]} AS BIGINT) AS first_id, "
                  + " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in c.split()) + " AS n_values")
    for t, c in _WIRE_COLUMNS.items()) + ")") + """
SELECT t AS "table", CAST(i // 5000 + 1 AS INTEGER) AS batch_id, i AS ordinal, first_id, n_values,
       count(*) OVER (PARTITION BY t) AS total_records,
       CAST(ceil(count(*) OVER (PARTITION BY t) / 5000.0) AS BIGINT) AS n_batches FROM committed""")
_PEOPLE_TXT = """SELECT user_id, age_bucket, gender_cd, region, last_activity_day"""
oracle("scan_jsonl", with_("people") + _PEOPLE_TXT + ", false AS corrupt FROM people")
oracle("scan_csv", with_("people") + _PEOPLE_TXT + " FROM people")
# the model projection: measures as 32-bit floats, counts as 32-bit integers, no text and no timestamps
_SINK_DOUBLES = (["segment_rank", "auto", "traveler", "entrepreneur", "total_reward_amt"]
                 + [f"{m}_{w}" for w in ("7d", "30d", "90d") for m in ("tx_amount_sum", "tx_amount_avg", "online_share")]
                 + [f"{m}_total" for m in ("tx_amount_sum", "tx_amount_avg", "tx_amount_std", "online_share")]
                 + [f"receipts_{m}_{d}d" for d in (30, 90) for m in ("items", "cost")])
_SINK_COUNTS = ([f"{m}_{w}" for w in ("7d", "30d", "90d", "total") for m in ("tx_count", "unique_merchants")]
                + ["unique_brands_total", "receipts_count_30d", "receipts_count_90d", "num_products", "active_accounts",
                   "offers_seen_count", "offers_activated_count", "rewards_count", *(f'"cat_{c}"' for c in CATEGORIES)])
oracle("sink_features", """
SELECT * EXCLUDE (age_bucket, gender_cd, region, last_activity_day, segment_code, region_size, vip_status,
                  first_offer_date, first_activation_date)
         REPLACE (""" + ", ".join([f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS {c}" for c in _SINK_DOUBLES]
                                  + [f"CAST({c} AS INTEGER) AS {c}" for c in _SINK_COUNTS]) + """)
FROM (""" + ORACLES["feature_table"] + ") f")


# ------------------------------------------------ reports, model, offline run

oracle("quality_summary", with_(*_ALL_CTES, extra=QUALITY_CTE) + """
SELECT table_name, check_name, details FROM checks WHERE NOT success ORDER BY table_name, check_no LIMIT 10""")


# the allowed values, stated here once more
_VALID = [("people", "gender_cd", ["M", "F"]), ("transaction", "online_transaction_flg", ["Y", "N", "y", "n", "0", "1"]),
          ("transaction", "amount_bucket", ["<1k", "1k+", "5k+", "10k+", "20k+", "50k+", "100k+"])]
_SPOILT = {"people": ("people", "gender_cd", "CASE WHEN user_id % 5 = 0 THEN '?' || (user_id % 75) END"),
           "transaction": ("tx", "online_transaction_flg", "CASE WHEN ordinal % 7 = 0 THEN 'maybe' END")}


def _invalid_values_sql() -> str:
    parts = []
    for table, column, allowed in _VALID:
        cte, spoilt, value = _SPOILT[table]
        rows = f"(SELECT * REPLACE (coalesce({value}, {spoilt}) AS {spoilt}) FROM {cte})"
        parts.append(f"SELECT DISTINCT '{table}' AS table_name, 'valid_values_{column}' AS check_name, {column} AS value FROM {rows} "
                     f"WHERE {column} IS NOT NULL AND {column} NOT IN ('', " + ", ".join(f"'{v}'" for v in allowed) + ")")
    return ("SELECT table_name, check_name, value FROM (SELECT *, row_number() OVER (PARTITION BY table_name, "
            "check_name ORDER BY value) AS n FROM (" + "\nUNION ALL\n".join(parts) + ")) WHERE n <= 10")


oracle("invalid_values", with_(*_ALL_CTES) + _invalid_values_sql())
oracle("drift_summary", "WITH " + PSI_CTE + """,
rep AS (
  SELECT (coalesce(count(*) FILTER (WHERE drifted) / count(*), 0) > 0.01 OR coalesce(avg(psi), 0) > 0.1)
           AS drift_detected,
         round(coalesce(avg(psi), 0), 4) AS drift_score,
         round(coalesce(count(*) FILTER (WHERE drifted) / count(*), 0), 4) AS drift_share,
         0.5::DOUBLE AS threshold,
         list_sort(coalesce(list(column_name) FILTER (WHERE drifted), [])) AS drifted_columns
  FROM per_col)
SELECT drift_detected, drift_score, drift_share, threshold, list_slice(drifted_columns, 1, 5) AS drifted_columns,
       CASE WHEN drift_detected THEN 'retrained' ELSE 'none' END AS action_taken
FROM rep""")
oracle("scan_batches", with_("people") + """
SELECT user_id, age_bucket, gender_cd, region, last_activity_day,
       CAST(floor((row_number() OVER (ORDER BY ordinal) - 1) / 500) + 1 AS INTEGER) AS batch_id
FROM people""")


# What a trained model leaves determined: who is in it, how many rows a user gets, that no row was seen before.
oracle("als_train", _SIDES + """
SELECT DISTINCT user_id, 64 AS factors, true AS finite FROM train""")
oracle("model_roundtrip", _SIDES + """
SELECT DISTINCT user_id, true AS same FROM train""")
oracle("recommend_offers", _SIDES + """,
n AS (SELECT user_id, least(100, (SELECT count(DISTINCT offer_id) FROM train) - count(DISTINCT offer_id)) AS n_rows
      FROM train WHERE user_id IN (SELECT user_id FROM test) GROUP BY user_id)
SELECT user_id, n_rows, CAST(n_rows AS INTEGER) AS last_rank, 0 AS n_seen FROM n WHERE n_rows > 0""")
oracle("evaluate_als", _SIDES + """
SELECT true AS map_in_range, count(DISTINCT user_id) AS num_test_users, 100 AS k,
       count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT user_id FROM train)) AS n_cold_users
FROM test""")
# a first run is its own reference: no drift, and a model where there was none
oracle("offline_run", with_(*_ALL_CTES, extra=SIDES_CTE + ",\n" + QUALITY_CTE) + """
SELECT 'v1' AS version, bool_and(success) AS valid, count(*) FILTER (WHERE NOT success) AS checks_failed,
       false AS drift_detected, 0.0::DOUBLE AS drift_score, true AS retrained, true AS map_in_range,
       (SELECT count(DISTINCT user_id) FROM test) AS num_test_users
FROM checks""")

# the first version has three quarters of the offers; the third is another in its receipts
oracle("offline_versions", with_(*_ALL_CTES, extra=SIDES_CTE + ",\n" + QUALITY_CTE).rstrip() + """,
q AS (SELECT bool_and(success) AS valid, count(*) FILTER (WHERE NOT success) AS failed FROM checks),
n AS (SELECT (SELECT count(DISTINCT offer_id) FROM offers) + (SELECT count(DISTINCT merchant_id_offer) FROM merchants) AS all_ids,
             (SELECT count(DISTINCT offer_id) FROM offers WHERE offer_id % 4 <> 0)
               + (SELECT count(DISTINCT merchant_id_offer) FROM merchants) AS first_ids,
             (SELECT count(DISTINCT user_id) FROM test) AS users)
SELECT * FROM (
  SELECT 'v1' AS version, valid, failed AS checks_failed, false AS drift_detected, true AS retrained, users AS num_test_users,
         first_ids AS n_known, 'v1' AS reference_version, false AS any_drift FROM q, n
  UNION ALL SELECT 'v2', valid, failed, false, false, NULL, all_ids, 'v1', false FROM q, n
  UNION ALL SELECT 'v3', valid, failed, true, true, users, all_ids, 'v3', true FROM q, n)""")
oracle("entity_numbers", with_("offers", "merchants").rstrip() + """,
known AS (SELECT DISTINCT 'offer' AS kind, offer_id AS id FROM offers UNION SELECT 'merchant', merchant_id_offer FROM merchants),
came AS (SELECT kind, id, CASE id % 3 WHEN 1 THEN 'v1' WHEN 2 THEN 'v2' ELSE 'v3' END AS version FROM known WHERE id IS NOT NULL)
SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY version, id) - 1 AS number, version FROM came""")
