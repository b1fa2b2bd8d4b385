"""The logical-table bindings of ``cohortex.sources.bindings`` as DuckDB SQL.

Used only by the oracle queries; the driver pre-registers the parquet
tables as views named after the files.
"""

from __future__ import annotations

CTE = {
    "people": """
people AS (
  SELECT c.c_custkey AS user_id,
         ['15','25','25-34','40','45-54','60'][c.c_nationkey % 6 + 1] AS age_bucket,
         CASE c.c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender_cd,
         CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'St. Petersburg' WHEN 'HOUSEHOLD' THEN 'Building'
              WHEN 'MACHINERY' THEN 'Mach`inery' ELSE c.c_mktsegment END AS region,
         strftime(lo.last_order, '%Y-%m-%d') AS last_activity_day,
         c.c_custkey AS ordinal
  FROM customer c
  LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) lo
    ON c.c_custkey = lo.o_custkey)""",
    "segments": """
segments AS (
  SELECT c_custkey AS user_id,
         ['m','u','t','r'][c_custkey % 4 + 1] || '_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
           || ' (' || CAST(c_custkey % 90 AS VARCHAR) || ')' AS segment,
         ['urban','town','rural'][c_nationkey % 3 + 1] AS region_size,
         CAST(c_acctbal AS VARCHAR) AS auto,
         CAST(c_custkey % 2 AS VARCHAR) AS traveler,
         CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_nationkey % 2 AS VARCHAR) END AS entrepreneur,
         CASE WHEN c_acctbal > 5000 THEN 'vip' END AS vip_status,
         c_custkey * 2 AS ordinal
  FROM customer
  UNION ALL
  SELECT c_custkey,
         ['m','u','t','r'][(c_custkey + 1) % 4 + 1] || '_' || lpad(CAST((c_nationkey + 1) % 25 AS VARCHAR), 2, '0')
           || ' (' || CAST((c_custkey + 7) % 90 AS VARCHAR) || ')',
         CAST(NULL AS VARCHAR), 'x', '1', '1', 'vip', c_custkey * 2 + 1
  FROM customer WHERE c_custkey % 5 = 0)""",
    "tx": """
tx AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS transaction_id,
         o.o_custkey AS user_id,
         l.l_suppkey + 1 AS merchant_id_tx,
         strftime(l.l_shipdate, '%Y-%m-%d') AS event_date,
         CAST(split_part(p.p_brand, '#', 2) AS BIGINT) AS brand_dk,
         CASE WHEN l.l_extendedprice < 1000 THEN '<1k' WHEN l.l_extendedprice < 5000 THEN '1k+'
              WHEN l.l_extendedprice < 10000 THEN '5k+' WHEN l.l_extendedprice < 20000 THEN '10k+'
              WHEN l.l_extendedprice < 50000 THEN '20k+' WHEN l.l_extendedprice < 100000 THEN '50k+'
              ELSE '100k+' END AS amount_bucket,
         CASE l.l_returnflag WHEN 'R' THEN 'Y' WHEN 'A' THEN '1' ELSE 'N' END AS online_transaction_flg,
         l.l_orderkey * 10 + l.l_linenumber AS ordinal
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)""",
    "offers": """
offers AS (
  SELECT p_partkey AS offer_id,
         p_partkey % 10 + 1 AS merchant_id_offer,
         strftime(DATE '2024-01-01' + CAST(p_size % 10 AS INTEGER), '%Y-%m-%d') AS start_date,
         CASE WHEN p_size = 50 THEN '2024-02-30'
              ELSE strftime(DATE '2024-01-01' + CAST(p_size % 10 AS INTEGER) + CAST(p_size - 3 AS INTEGER), '%Y-%m-%d')
         END AS end_date,
         p_name AS offer_text,
         p_partkey AS ordinal
  FROM part)""",
    "merchants": """
merchants AS (
  SELECT s_suppkey + 1 AS merchant_id_offer,
         CASE WHEN s_acctbal >= 0 THEN 'ACT' ELSE 'DLT' END AS merchant_status,
         s_suppkey % 25 + 1 AS brand_dk,
         s_suppkey AS ordinal
  FROM supplier)""",
    "seens": """
seens AS (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS offer_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_date, CAST(NULL AS VARCHAR) AS end_date,
         event_id AS ordinal
  FROM events WHERE event_type = 'view')""",
    "activations": """
activations AS (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS offer_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS activation_date, event_id AS ordinal
  FROM events WHERE event_type = 'click')""",
    "rewards": """
rewards AS (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS offer_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_date, CAST(value AS VARCHAR) AS reward_amt,
         event_id AS ordinal
  FROM events WHERE event_type = 'purchase')""",
    "receipts": """
receipts AS (
  SELECT o.o_custkey AS user_id, strftime(l.l_shipdate, '%Y-%m-%d') AS date_operated,
         CASE WHEN l.l_linenumber = 7 THEN 'Food' WHEN l.l_returnflag = 'A' THEN 'FOOD' WHEN l.l_returnflag = 'N' THEN 'PRODUCT'
              ELSE 'Travel, etc.' END AS category_name,
         l.l_quantity AS items_count, l.l_extendedprice AS items_cost,
         l.l_orderkey * 10 + l.l_linenumber AS ordinal
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "accounts": """
accounts AS (
  SELECT o_custkey AS user_id, o_orderpriority AS product_cd,
         CASE WHEN o_orderstatus = 'F' THEN 'ACT' ELSE 'CLS' END AS account_status_cd,
         strftime(o_orderdate, '%Y-%m') AS open_month, CAST(NULL AS VARCHAR) AS close_month,
         o_orderkey AS ordinal
  FROM orders)""",
}

# logical table name -> CTE name
CTE_NAME = {
    "people": "people", "segments": "segments", "transaction": "tx", "offer": "offers",
    "merchant": "merchants", "financial_account": "accounts", "offer_seens": "seens",
    "offer_activation": "activations", "offer_reward": "rewards", "receipts": "receipts",
}

# scalar expressions shared by several oracles
AMOUNT_SQL = ("CAST(CASE amount_bucket WHEN '<1k' THEN 500 WHEN '1k+' THEN 1000 WHEN '5k+' THEN 5000 "
              "WHEN '10k+' THEN 10000 WHEN '20k+' THEN 20000 WHEN '50k+' THEN 50000 "
              "WHEN '100k+' THEN 100000 ELSE 0 END AS DOUBLE)")
ONLINE_SQL = "CASE WHEN online_transaction_flg IN ('Y','y','1') THEN 1 ELSE 0 END"


def with_(*ctes: str, extra: str = "") -> str:
    """``WITH`` clause holding the named binding CTEs plus extra CTE text."""
    parts = [CTE[c].strip() for c in ctes]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(sql: str, cols: dict[str, int]) -> str:
    """Round the given columns of a query to the given number of digits."""
    rep = ", ".join(f"round({c}, {d}) AS {c}" for c, d in cols.items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"
