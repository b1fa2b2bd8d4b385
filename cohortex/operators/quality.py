"""Declarative data-quality checks.

A rule list per table is compiled into Column expressions; all row-level
rules of one table are evaluated by ONE aggregate over one scan, and the
single result row is turned into one row per check with ``inline`` (no
driver round trip). Required-column checks read the schema only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.functions import columns as C

# --- fixed values: the rule catalogue ---------------------------------------
# (check type, arguments) per table, in the order they are reported.
RULES = {
    "people": {
        "required_columns": ["user_id", "age_bucket", "gender_cd", "region"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "age_bucket"}),
            ("no_null", {"column": "region"}),
            ("unique", {"column": "user_id"}),
            ("valid_values", {"column": "gender_cd", "values": ["M", "F", None, ""]}),
        ],
    },
    "segments": {
        "required_columns": ["user_id", "segment"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "segment"}),
            ("unique", {"column": "user_id"}),
            ("valid_pattern", {"column": "segment", "pattern": r"^[mutr]_\d{2}"}),
            ("min_rows", {"min": 1000}),
        ],
    },
    "transaction": {
        "required_columns": ["transaction_id", "user_id", "merchant_id_tx", "event_date", "brand_dk"],
        "checks": [
            ("no_null", {"column": "transaction_id"}),
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "merchant_id_tx"}),
            ("no_null", {"column": "event_date"}),
            ("no_null", {"column": "brand_dk"}),
            ("unique", {"column": "transaction_id"}),
            ("valid_date", {"column": "event_date"}),
            ("min_rows", {"min": 10000}),
            ("valid_values", {"column": "online_transaction_flg", "values": ["Y", "N", "y", "n", 0, 1]}),
            ("valid_values", {"column": "amount_bucket",
                              "values": ["<1k", "1k+", "5k+", "10k+", "20k+", "50k+", "100k+", None, ""]}),
        ],
    },
    "offer": {
        "required_columns": ["offer_id", "merchant_id_offer", "start_date", "end_date"],
        "checks": [
            ("no_null", {"column": "offer_id"}),
            ("no_null", {"column": "merchant_id_offer"}),
            ("no_null", {"column": "start_date"}),
            ("no_null", {"column": "end_date"}),
            ("valid_date", {"column": "start_date"}),
            ("valid_date", {"column": "end_date"}),
            ("date_order", {"start": "start_date", "end": "end_date"}),
            ("min_rows", {"min": 10}),
        ],
    },
    "merchant": {
        "required_columns": ["merchant_id_offer", "merchant_status", "brand_dk"],
        "checks": [
            ("no_null", {"column": "merchant_id_offer"}),
            ("no_null", {"column": "brand_dk"}),
            ("unique", {"column": "merchant_id_offer"}),
            ("min_rows", {"min": 10}),
        ],
    },
    "financial_account": {
        "required_columns": ["user_id", "product_cd", "account_status_cd"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "product_cd"}),
            ("no_null", {"column": "account_status_cd"}),
            ("min_rows", {"min": 100}),
        ],
    },
    "offer_seens": {
        "required_columns": ["user_id", "offer_id", "start_date"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "offer_id"}),
            ("no_null", {"column": "start_date"}),
            ("valid_date", {"column": "start_date"}),
            ("min_rows", {"min": 100}),
        ],
    },
    "offer_activation": {
        "required_columns": ["user_id", "offer_id", "activation_date"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "offer_id"}),
            ("no_null", {"column": "activation_date"}),
            ("valid_date", {"column": "activation_date"}),
            ("min_rows", {"min": 10}),
        ],
    },
    "offer_reward": {
        "required_columns": ["user_id", "offer_id", "event_date"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "offer_id"}),
            ("no_null", {"column": "event_date"}),
            ("valid_date", {"column": "event_date"}),
            ("min_rows", {"min": 1}),
        ],
    },
    "receipts": {
        "required_columns": ["user_id", "date_operated", "category_name"],
        "checks": [
            ("no_null", {"column": "user_id"}),
            ("no_null", {"column": "date_operated"}),
            ("no_null", {"column": "category_name"}),
            ("valid_date", {"column": "date_operated"}),
            ("min_rows", {"min": 100}),
        ],
    },
}
# -----------------------------------------------------------------------------


def check_name(kind: str, args: dict) -> str:
    if kind == "min_rows":
        return "min_rows"
    if kind == "date_order":
        return f"date_order_{args['start']}_{args['end']}"
    return f"{kind}_{args['column']}" if "column" in args else kind


def allowed_values(values: list) -> list[str]:
    """Allowed values as text; NULL and '' are always allowed."""
    return [str(v) for v in values if v is not None and v != ""]


ROW_KINDS = ("no_null", "valid_values", "valid_pattern", "valid_date", "date_order")


def _violations(kind: str, args: dict) -> Column:
    """Row predicate that is true for a row violating the rule (row rules)."""
    if kind == "no_null":
        return F.col(args["column"]).isNull()
    if kind == "valid_values":
        c = F.col(args["column"]).cast("string")
        return c.isNotNull() & (c != "") & ~c.isin(*allowed_values(args["values"]))
    if kind == "valid_pattern":
        return ~F.coalesce(F.col(args["column"]).cast("string").rlike(args["pattern"]), F.lit(False))
    if kind == "valid_date":
        c = F.col(args["column"]).cast("string")
        return c.isNotNull() & (c != "") & C.lenient_ts(c).isNull()
    if kind == "date_order":
        return C.lenient_ts(args["start"]) > C.lenient_ts(args["end"])
    raise ValueError(kind)


def _counter(kind: str, args: dict) -> Column:
    if kind == "min_rows":
        return F.count(F.lit(1))
    if kind == "unique":
        c = F.col(args["column"])
        return (F.count(F.lit(1)) - F.count_distinct(c)
                - F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)))
    return F.count_if(_violations(kind, args))


def _details(kind: str, args: dict, n: Column, ok: Column) -> Column:
    s = n.cast("string")
    if kind == "min_rows":
        return F.concat(F.lit("Table has "), s, F.lit(f" rows, minimum required: {args['min']}"))
    msgs = {
        "no_null": (" null values in {column}", "No null values"),
        "unique": (" duplicate values in {column}", "All values unique"),
        "valid_values": (" rows with invalid values in {column}", "All values valid"),
        "valid_pattern": (" values don't match pattern {pattern}", "All values match pattern"),
        "valid_date": (" invalid dates in {column}", "All dates valid"),
        "date_order": (" records with start_date > end_date", "All date ranges valid"),
    }
    bad, good = msgs[kind]
    return F.when(ok, F.lit(good)).otherwise(F.concat(s, F.lit(bad.format(**args))))


CHECK_SCHEMA = "table_name string, check_no int, check_name string, success boolean, failed bigint, details string"


def table_checks(df: DataFrame, table: str, rules: dict | None = None) -> DataFrame:
    """One row per check of ``table``: (table_name, check_no, check_name,
    success, failed, details). An unknown table has no checks."""
    rules = RULES.get(table) if rules is None else rules
    spark = df.sparkSession
    if not rules:
        return spark.createDataFrame([], CHECK_SCHEMA)
    missing = [c for c in rules["required_columns"] if c not in df.columns]
    req = F.struct(F.lit(table).alias("table_name"), F.lit(0).alias("check_no"),
                   F.lit("required_columns").alias("check_name"), F.lit(not missing).alias("success"),
                   F.lit(len(missing)).cast("bigint").alias("failed"),
                   F.lit(f"Missing columns: {', '.join(missing)}" if missing
                         else "All required columns present").alias("details"))
    structs, aggs = [req], []
    for i, (kind, args) in enumerate(rules["checks"], start=1):
        name = check_name(kind, args)
        cols = [args[k] for k in ("column", "start", "end") if k in args]
        error = ("unknown check type" if kind not in ("min_rows", "unique", *ROW_KINDS)
                 else "missing column" if any(c not in df.columns for c in cols) else None)
        if error:
            structs.append(F.struct(F.lit(table).alias("table_name"), F.lit(i).alias("check_no"),
                                    F.lit(name).alias("check_name"), F.lit(False).alias("success"),
                                    F.lit(None).cast("bigint").alias("failed"),
                                    F.lit(f"Error running check: {error}").alias("details")))
            continue
        aggs.append(_counter(kind, args).alias(f"c{i}"))
        n = F.col(f"c{i}")
        ok = (n >= args["min"]) if kind == "min_rows" else (n == 0)
        failed = F.when(ok, F.lit(0)).otherwise(F.lit(args["min"]) - n) if kind == "min_rows" else n
        structs.append(F.struct(F.lit(table).alias("table_name"), F.lit(i).alias("check_no"),
                                F.lit(name).alias("check_name"), ok.alias("success"),
                                failed.cast("bigint").alias("failed"), _details(kind, args, n, ok).alias("details")))
    one_row = df.agg(*aggs) if aggs else spark.range(1)
    return one_row.select(F.inline(F.array(*structs)))


def quality_checks(tables: dict) -> DataFrame:
    """Q1-Q9 over every table present in ``tables``."""
    out = None
    for name in tables.names() if hasattr(tables, "names") else list(tables):
        part = table_checks(tables[name], name)
        out = part if out is None else out.unionByName(part)
    return out


def quality_report(checks: DataFrame) -> DataFrame:
    """Per table and overall ('__all__'): totals, passed, failed, valid."""
    return (checks.rollup("table_name").agg(
        F.count("*").alias("checks_total"),
        F.count_if("success").alias("checks_passed"),
        F.count_if(~F.col("success")).alias("checks_failed"),
        F.bool_and("success").alias("valid"))
        .withColumn("table_name", F.coalesce("table_name", F.lit("__all__"))))


def _row_rules(df: DataFrame, table: str, kinds=None) -> list[tuple[str, dict]]:
    """The row-level rules of ``table`` whose columns ``df`` has."""
    return [(kind, args) for kind, args in RULES.get(table, {}).get("checks", [])
            if kind in (kinds or ROW_KINDS) and all(args[k] in df.columns for k in ("column", "start", "end") if k in args)]


def quality_violations(df: DataFrame, table: str, key: str) -> DataFrame:
    """The offending rows of the row-level rules of ``table``:
    (table_name, check_name, key) with ``key`` the row's identifying column.
    One scan: a row becomes one output row per rule that it breaks."""
    rules = _row_rules(df, table)
    if not rules:
        return None
    broken = F.array_compact(F.array(*[F.when(_violations(kind, args), F.lit(check_name(kind, args))) for kind, args in rules]))
    return df.select(F.lit(table).alias("table_name"), F.explode(broken).alias("check_name"),
                     F.col(key).cast("string").alias("key"))


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Values that break a ``unique`` rule, with their surplus row count."""
    out = None
    for kind, args in RULES.get(table, {}).get("checks", []):
        if kind != "unique":
            continue
        c = args["column"]
        part = (df.groupBy(c).count().where(F.col("count") > 1)
                .select(F.lit(table).alias("table_name"), F.lit(check_name(kind, args)).alias("check_name"),
                        F.col(c).cast("string").alias("key"), (F.col("count") - 1).alias("surplus")))
        out = part if out is None else out.unionByName(part)
    return out


def failed_checks(checks: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` failed checks in (table, check order) order."""
    return (checks.where(~F.col("success")).orderBy("table_name", "check_no")
            .limit(limit).select("table_name", "check_name", "details"))


def invalid_values(df: DataFrame, table: str, per_check: int = 10) -> DataFrame:
    """U4 + T6: distinct values outside the allowed set of every
    ``valid_values`` rule, at most ``per_check`` (smallest first) per rule.
    Distinct values are aggregated map-side, so a value repeated by a third
    of all rows is one row before the shuffle."""
    rules = _row_rules(df, table, ("valid_values",))
    if not rules:
        return None
    bad = F.array_compact(F.array(*[
        F.when(_violations(kind, args), F.struct(F.lit(check_name(kind, args)).alias("check_name"),
                                                 F.col(args["column"]).cast("string").alias("value")))
        for kind, args in rules]))
    out = df.select(F.lit(table).alias("table_name"), F.inline(bad)).distinct()
    w = Window.partitionBy("table_name", "check_name").orderBy("value")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_check).drop("n")
