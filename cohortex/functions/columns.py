"""Scalar Column expressions (P1-P10): code maps and lenient parsing.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen; none is a Python UDF. ANSI mode is on by default in
Spark 4, therefore every parse of dirty text goes through a ``try_*``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortex.functions import fixed_values as FV


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def gender_code(c) -> Column:
    """M -> 1, F -> 0, anything else or NULL -> -1."""
    return F.coalesce(F.try_element_at(literal_map(FV.GENDER_CODES), _col(c)),
                      F.lit(FV.GENDER_DEFAULT)).cast("int")


def age_code(c) -> Column:
    """Age bucket text -> 0..5, unknown or NULL -> -1."""
    return F.coalesce(F.try_element_at(literal_map(FV.AGE_BUCKET_CODES), _col(c).cast("string")),
                      F.lit(FV.AGE_DEFAULT)).cast("int")


def amount_value(c) -> Column:
    """Amount bucket -> representative amount, else 0."""
    return F.coalesce(F.try_element_at(literal_map(FV.AMOUNT_BUCKET_VALUES), _col(c)),
                      F.lit(FV.AMOUNT_DEFAULT)).cast("double")


def online_flag(c) -> Column:
    """1 when the flag is one of the online values, NULL -> 0."""
    return F.coalesce(_col(c).cast("string").isin(*FV.ONLINE_FLAG_VALUES), F.lit(False)).cast("int")


def lenient_ts(c) -> Column:
    """Text -> timestamp without time zone (dates are local wall-clock
    values, so no session zone or DST may shift them), unparsable -> NULL."""
    return _col(c).cast("string").try_cast("timestamp_ntz")


def ts_literal(value: str) -> Column:
    """A fixed date / timestamp as a zone-free timestamp."""
    return F.lit(value).try_cast("timestamp_ntz")


def today() -> Column:
    return F.current_date().cast("timestamp_ntz")


def lenient_double(c) -> Column:
    """Text -> double, unparsable -> NULL."""
    return _col(c).cast("string").try_cast("double")


def lenient_long(c) -> Column:
    """Text such as '12.0' -> 12; goes through DOUBLE because a
    direct try_cast of '12.0' to BIGINT is NULL."""
    return lenient_double(c).try_cast("bigint")


def segment_code(c) -> Column:
    """P10: leading 'x_NN' of a segment label, NULL when absent."""
    return F.nullif(F.regexp_extract(_col(c), FV.SEGMENT_CODE_PATTERN, 1), F.lit(""))


def segment_rank(c) -> Column:
    """P10: number in parentheses, 0 when absent."""
    return F.coalesce(lenient_double(F.nullif(F.regexp_extract(_col(c), FV.SEGMENT_RANK_PATTERN, 1),
                                              F.lit(""))), F.lit(0.0))


def days_between_floor(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, floored (timedelta.days)."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000))


def days_since(c, reference: str = FV.ACTIVITY_REFERENCE_DATE) -> Column:
    """Floor of days from the parsed date to ``reference``; NULL -> 999."""
    return F.coalesce(days_between_floor(ts_literal(reference), lenient_ts(c)),
                      F.lit(FV.ACTIVITY_MISSING_DAYS)).cast("int")
