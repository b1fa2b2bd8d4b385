"""Binding of the driver's parquet tables to the ten logical tables.

The logical tables keep the raw, string-typed shape that arrives in
record batches (dates as ISO text, numbers sometimes as text), so that the
lenient parsing of the feature code is exercised. Every logical table also
carries an ``ordinal`` column: the arrival order that "first" / "last wins"
semantics need (D5).

All bindings are lazy DataFrames; Catalyst prunes the columns a query does
not use down to the parquet ``ReadSchema``.

The binding choices (bucket lists, letters, derived dates) are ours; the
same rules are written as DuckDB SQL in ``cohortex.plans.oracles``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGE_BUCKETS = ["15", "25", "25-34", "40", "45-54", "60"]
SEGMENT_LETTERS = ["m", "u", "t", "r"]
REGION_SIZES = ["urban", "town", "rural"]
OFFER_EPOCH = "2024-01-01"
# interactions use their own calendar (events are January 2024)
INTERACTION_REFERENCE_DATE = "2024-01-25"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _amount_bucket(price: Column) -> Column:
    return (F.when(price < 1000, "<1k").when(price < 5000, "1k+").when(price < 10000, "5k+")
            .when(price < 20000, "10k+").when(price < 50000, "20k+").when(price < 100000, "50k+")
            .otherwise("100k+"))


def _region(segment: Column) -> Column:
    """Names as they come: with a dot, a backtick, and one that differs from another by case only."""
    return (F.when(segment == "FURNITURE", "St. Petersburg").when(segment == "HOUSEHOLD", "Building")
            .when(segment == "MACHINERY", "Mach`inery").otherwise(segment))


def people(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    last = (read_table(spark, d, "orders").groupBy("o_custkey")
            .agg(F.max("o_orderdate").alias("last_order")))
    return (c.join(last, c.c_custkey == last.o_custkey, "left")
            .select(F.col("c_custkey").alias("user_id"),
                    _pick(AGE_BUCKETS, F.col("c_nationkey") % 6).alias("age_bucket"),
                    F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F")
                    .alias("gender_cd"),
                    _region(F.col("c_mktsegment")).alias("region"),
                    _day(F.col("last_order")).alias("last_activity_day"),
                    F.col("c_custkey").alias("ordinal")))


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")

    def label(letter_idx, nation, rank):
        return F.concat(_pick(SEGMENT_LETTERS, letter_idx), F.lit("_"),
                        F.lpad(nation.cast("string"), 2, "0"), F.lit(" ("), rank.cast("string"), F.lit(")"))

    first = c.select(
        k.alias("user_id"), label(k % 4, n, k % 90).alias("segment"),
        _pick(REGION_SIZES, n % 3).alias("region_size"),
        F.col("c_acctbal").cast("string").alias("auto"),
        (k % 2).cast("string").alias("traveler"),
        F.when(k % 7 == 0, F.lit("n/a")).otherwise((n % 2).cast("string")).alias("entrepreneur"),
        F.when(F.col("c_acctbal") > 5000, F.lit("vip")).alias("vip_status"),
        (k * 2).alias("ordinal"))
    second = c.filter(k % 5 == 0).select(
        k.alias("user_id"), label((k + 1) % 4, (n + 1) % 25, (k + 7) % 90).alias("segment"),
        F.lit(None).cast("string").alias("region_size"),
        F.lit("x").alias("auto"), F.lit("1").alias("traveler"), F.lit("1").alias("entrepreneur"),
        F.lit("vip").alias("vip_status"), (k * 2 + 1).alias("ordinal"))
    return first.unionByName(second)


def transaction(spark: SparkSession, d: str) -> DataFrame:
    # what comes from one row of lineitem is made before the joins: a bucket and an id travel better than what they are made of
    li = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        (F.col("l_suppkey") + 1).alias("merchant_id_tx"),
        _amount_bucket(F.col("l_extendedprice")).alias("amount_bucket"),
        F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "A", "1")
        .otherwise("N").alias("online_transaction_flg"))
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = read_table(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        "transaction_id",
        F.col("o_custkey").alias("user_id"),
        "merchant_id_tx",
        _day(F.col("l_shipdate")).alias("event_date"),
        F.substring_index(F.col("p_brand"), "#", -1).cast("bigint").alias("brand_dk"),
        "amount_bucket",
        "online_transaction_flg",
        F.col("transaction_id").alias("ordinal"))


def offer(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    start = F.date_add(F.to_date(F.lit(OFFER_EPOCH)), (F.col("p_size") % 10).cast("int"))
    end = F.date_add(start, (F.col("p_size") - 3).cast("int"))
    return p.select(
        F.col("p_partkey").alias("offer_id"),
        (F.col("p_partkey") % 10 + 1).alias("merchant_id_offer"),
        _day(start).alias("start_date"),
        F.when(F.col("p_size") == 50, F.lit("2024-02-30")).otherwise(_day(end)).alias("end_date"),
        F.col("p_name").alias("offer_text"),
        F.col("p_partkey").alias("ordinal"))


def merchant(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    return s.select(
        (F.col("s_suppkey") + 1).alias("merchant_id_offer"),
        F.when(F.col("s_acctbal") >= 0, "ACT").otherwise("DLT").alias("merchant_status"),
        (F.col("s_suppkey") % 25 + 1).alias("brand_dk"),
        F.col("s_suppkey").alias("ordinal"))


def _events(spark: SparkSession, d: str, kind: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return (e.filter(F.col("event_type") == kind)
            .withColumn("offer_id", F.get_json_object("props", "$.k").cast("bigint")))


def offer_seens(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "view").select(
        "user_id", "offer_id", _second(F.col("ts")).alias("start_date"),
        F.lit(None).cast("string").alias("end_date"), F.col("event_id").alias("ordinal"))


def offer_activation(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "click").select(
        "user_id", "offer_id", _second(F.col("ts")).alias("activation_date"),
        F.col("event_id").alias("ordinal"))


def offer_reward(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "purchase").select(
        "user_id", "offer_id", _second(F.col("ts")).alias("event_date"),
        F.col("value").cast("string").alias("reward_amt"), F.col("event_id").alias("ordinal"))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice",
        F.when(F.col("l_linenumber") == 7, "Food").when(F.col("l_returnflag") == "A", "FOOD")
        .when(F.col("l_returnflag") == "N", "PRODUCT").otherwise("Travel, etc.").alias("category_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        _day(F.col("l_shipdate")).alias("date_operated"),
        "category_name",
        F.col("l_quantity").alias("items_count"),
        F.col("l_extendedprice").alias("items_cost"),
        "ordinal")


def financial_account(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("product_cd"),
        F.when(F.col("o_orderstatus") == "F", "ACT").otherwise("CLS").alias("account_status_cd"),
        F.date_format("o_orderdate", "yyyy-MM").alias("open_month"),
        F.lit(None).cast("string").alias("close_month"),
        F.col("o_orderkey").alias("ordinal"))


BINDERS = {
    "people": people, "segments": segments, "transaction": transaction, "offer": offer,
    "merchant": merchant, "financial_account": financial_account, "offer_seens": offer_seens,
    "offer_activation": offer_activation, "offer_reward": offer_reward, "receipts": receipts,
}


class TableSet(dict):
    """Logical tables by name, built lazily on first access; a missing
    table simply is not in the set (the operator that needs it is skipped)."""

    def __init__(self, spark: SparkSession, sf_dir: str, names=None):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self._names = list(names or BINDERS)

    def __missing__(self, name):
        if name not in self._names:
            raise KeyError(name)
        df = BINDERS[name](self.spark, self.sf_dir)
        self[name] = df
        return df

    def __contains__(self, name):
        return name in self._names

    def get(self, name, default=None):
        return self[name] if name in self else default

    def names(self):
        return list(self._names)


class TableSubset(dict):
    """The tables of ``base`` with some replaced."""

    def __init__(self, base: TableSet, **replaced):
        super().__init__(replaced)
        self.base = base

    def __missing__(self, name):
        return self.base[name]

    def __contains__(self, name):
        return super().__contains__(name) or name in self.base

    def get(self, name, default=None):
        return self[name] if name in self else default

    def names(self):
        return self.base.names()


def bind(spark: SparkSession, sf_dir: str, names=None) -> TableSet:
    return TableSet(spark, sf_dir, names)
