"""Every registered query against its DuckDB oracle on sf0.001; queries
without an oracle must at least run and return their rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# their oracles name every value of the pivoted columns, which all occur from sf0.01 on
PIVOTED = {"category_pivot", "one_hot", "feature_table", "sink_features"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def _connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, name):
    sf = SF.replace("0.001", "0.01") if name in PIVOTED else SF
    got = E.queries()[name](spark, sf).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    con = _connect(sf)
    con.execute(f"CREATE VIEW wanted AS {sql}")          # an oracle must be storable as a view
    want = con.sql("SELECT * FROM wanted").df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "user_id" in df.columns
