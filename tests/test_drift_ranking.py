"""PSI, AP@k and similarity values of FIXTURES.md sections 3-4, plus invariants."""

import datetime as dt

import pytest
import numpy as np
from pyspark.sql import functions as F

from cohortex.operators import drift as DX
from cohortex.operators import merchants as MX
from cohortex.operators import ranking as RX
from cohortex.operators import similarity as SX
from cohortex.plans import offline_run as OR
from cohortex.plans import queries as Q
from cohortex.sources.bindings import bind


def _psi(spark, ref, cur):
    r = spark.createDataFrame([(float(x),) for x in ref], "x double")
    c = spark.createDataFrame([(float(x),) for x in cur], "x double")
    return DX.psi_by_column(r, c, ["x"]).collect()[0]["psi"]


@pytest.mark.parametrize("ref,cur,expected", [
    (range(1, 101), range(1, 101), 0.0),
    (range(1, 101), range(21, 121), 0.435981),
    ([0] * 50 + [1] * 50, [0] * 90 + [1] * 10, 0.768351),
    ([0] * 95 + [1, 2, 3, 4, 5], [0] * 50 + [5] * 50, 0.0),
    ([5] * 10, [6] * 10, 0.0),
    (range(1, 11), [], 0.0),
])
def test_psi_values(spark, ref, cur, expected):
    assert _psi(spark, list(ref), list(cur)) == pytest.approx(expected, abs=1e-6)


def test_edges_are_exact_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=20_000), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(7)
    got = DX.reference_edges(DX.value_counts(df, ["x"])).collect()[0]
    assert got["edges"] == np.unique(np.percentile(values, np.linspace(0, 100, 11))).tolist()
    assert got["n_ref"] == len(values)


def test_column_without_reference_values_scores_zero(spark):
    r = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    c = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], "x double, y double")
    rows = {x["column_name"]: x["psi"] for x in DX.psi_by_column(r, c).collect()}
    assert rows["y"] == 0.0 and set(rows) == {"x", "y"}
    assert DX.drift_report(DX.psi_by_column(r, c)).collect()[0]["n_columns_total"] == 2


def test_no_common_columns_is_no_drift(spark):
    r, c = spark.createDataFrame([(1.0,)], "a double"), spark.createDataFrame([(1.0,)], "b double")
    report = DX.drift_report(DX.psi_by_column(r, c), model_exists=True).collect()[0]
    assert report["n_columns_total"] == 0 and not report["drift_detected"] and not report["retrain"]


def test_audience_larger_than_a_thousand(spark):
    vectors = spark.range(3000).select(F.col("id").alias("user_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("vec"))
    seeds = spark.createDataFrame([(1, 0)], "request_id long, user_id long")
    for fn in (SX.similar_users, SX.similar_users_centroid):
        assert fn(vectors, seeds, 2000).count() == 2000


def test_model_is_found_by_uri_and_stale_maps_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    assert not RX.model_exists(spark, path)
    wide = spark.createDataFrame([(2 ** 33 + u, o, 1.0) for u in range(6) for o in range(4) if (u + o) % 2],
                                 "user_id long, offer_id long, confidence double")
    RX.save_model(RX.train_als(wide, rank=2, max_iter=1), path)
    assert RX.model_exists(spark, path)
    assert {r["user_id"] for r in RX.load_model(spark, path).user_vectors().collect()} == {2 ** 33 + u for u in range(6)}
    RX.save_model(RX.train_als(wide.withColumn("user_id", F.col("user_id") - 2 ** 33), rank=2, max_iter=1), path)
    assert {r["user_id"] for r in RX.load_model(spark, path).user_vectors().collect()} == set(range(6))


def test_drift_report_rule(spark):
    psi = spark.createDataFrame([("a", 0.435981, False), ("b", 0.0, False)], "column_name string, psi double, "
                                                                             "drifted boolean")
    r = DX.drift_report(psi, model_exists=True).collect()[0]
    assert r["drift_detected"] is True and r["drift_score"] == pytest.approx(0.218, abs=1e-3)
    assert r["n_columns_drifted"] == 0 and r["retrain"] is True


def _preds(spark, rows):
    return spark.createDataFrame(rows, "user_id long, offer_id long, rank int")


def test_average_precision_values(spark):
    preds = _preds(spark, [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 5, 1), (2, 6, 2)])
    actual = spark.createDataFrame([(1, 2), (1, 9), (2, 5), (2, 6), (2, 7), (3, 4)], "user_id long, offer_id long")
    r = RX.map_at_k(preds, actual, k=2).collect()[0]
    assert r["map_at_k"] == pytest.approx(0.416667, abs=1e-6)
    assert r["num_test_users"] == 3 and r["n_cold_users"] == 1


def test_average_precision_duplicates(spark):
    preds = _preds(spark, [(1, 5, 1), (1, 5, 2), (1, 6, 3)])
    actual = spark.createDataFrame([(1, 5), (1, 6)], "user_id long, offer_id long")
    assert RX.map_at_k(preds, actual, k=3).collect()[0]["map_at_k"] == pytest.approx(0.833333, abs=1e-6)


def _vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.5]),
                                  (5, [-1.0, 0.0])], "user_id long, vec array<float>")


def test_similar_users_fixture(spark):
    seeds = spark.createDataFrame([(0, 1), (0, 2)], "request_id int, user_id long")
    got = [(r["user_id"], round(r["score"], 6)) for r in
           SX.similar_users(_vectors(spark), seeds, 2).orderBy("rank").collect()]
    assert got == [(3, 0.707107), (4, 0.606339)]


def test_similar_users_invariants(spark):
    v = spark.range(0, 300).select(F.col("id").alias("user_id"),
                                   F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("vec"))
    seeds = spark.range(0, 300).where(F.col("id") % 17 == 0).select(F.lit(1).alias("request_id"),
                                                                    F.col("id").alias("user_id"))
    for fn in (SX.similar_users, SX.similar_users_centroid):
        out = fn(v, seeds, 25).orderBy("rank").collect()
        assert len(out) == 25
        assert not {r["user_id"] for r in out} & {r["user_id"] for r in seeds.collect()}
        scores = [r["score"] for r in out]
        assert scores == sorted(scores, reverse=True)
        assert all(-1.0 - 1e-9 <= s <= 1.0 + 1e-9 for s in scores)


def test_recommend_unseen_invariants(spark):
    users = spark.range(0, 40).select(F.col("id").alias("user_id"),
                                      F.array(F.sin("id"), F.cos("id")).alias("vec"))
    items = spark.range(0, 30).select(F.col("id").alias("offer_id"),
                                      F.array(F.cos("id"), F.sin("id")).alias("vec"))
    seen = spark.range(0, 40).select(F.col("id").alias("user_id"), (F.col("id") % 30).alias("offer_id"))
    rec = RX.recommend_unseen(users, items, seen, users, 5)
    assert rec.groupBy("user_id").count().where("count != 5").count() == 0
    assert rec.join(seen, ["user_id", "offer_id"]).count() == 0


def test_als_invariants(spark):
    inter = spark.range(0, 400).select((F.col("id") % 40).alias("user_id"), (F.col("id") % 23).alias("offer_id"),
                                       F.lit(1.0).alias("confidence")).distinct()
    a = RX.train_als(inter, rank=8, max_iter=3)
    b = RX.train_als(inter, rank=8, max_iter=3)
    fa = {r["user_id"]: r["vec"] for r in a.user_vectors().collect()}
    fb = {r["user_id"]: r["vec"] for r in b.user_vectors().collect()}
    assert fa.keys() == fb.keys() and all(fa[k] == pytest.approx(fb[k], abs=1e-5) for k in fa)
    rec = RX.recommend_unseen(a.user_vectors(), a.item_vectors(), inter, inter, 5)
    assert rec.join(inter, ["user_id", "offer_id"]).count() == 0


def test_als_dense_index_for_large_ids(spark):
    inter = spark.range(0, 200).select((F.col("id") % 20 + 3_000_000_000).alias("user_id"),
                                       (F.col("id") % 11).alias("offer_id"), F.lit(2.0).alias("confidence"))
    fit = RX.train_als(inter.distinct(), rank=4, max_iter=2)
    ids = {r["user_id"] for r in fit.user_vectors().collect()}
    assert ids == {3_000_000_000 + i for i in range(20)}


def test_a_kept_snapshot_gives_the_same_psi_to_the_last_bit(spark, tmp_path):
    rng = np.random.default_rng(6)
    side = lambda n, at: spark.createDataFrame(
        [(float(x), float(y), int(x * 3), None, 7.0) for x, y in zip(np.round(rng.normal(at, 2, n), 2), rng.random(n))],
        "a double, b double, `c.d` long, e double, same double").repartition(3)
    ref, cur = side(3_000, 0), side(2_000, 1)
    cols = DX.common_numeric_columns(ref, cur)
    path = str(tmp_path / "snapshot")
    DX.reference_snapshot(ref, cols).write.parquet(path)
    kept = spark.read.schema(DX.SNAPSHOT).parquet(path)
    now, later = (sorted(map(tuple, x.collect())) for x in (DX.psi_by_column(ref, cur), DX.psi_against(kept, cur)))
    assert [r[0] for r in now] == sorted(cols) and [(c, d) for c, _, d in now] == [(c, d) for c, _, d in later]
    assert [p for _, p, _ in now] == pytest.approx([p for _, p, _ in later], abs=1e-15)
    # by hand, for one column
    a, b = (np.array([r["a"] for r in x.select("a").collect()]) for x in (ref, cur))
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    r, c = ((np.histogram(x, edges)[0] + 1) / (len(x) + 10) for x in (a, b))
    assert dict((x[0], x[1]) for x in later)["a"] == pytest.approx(float(((c - r) * np.log(c / r)).sum()), abs=1e-12)
    # value counts of two parts are those of the whole
    half = ref.where("b < 0.5"), ref.where("b >= 0.5")
    merged = DX.merged_counts(*(DX.value_counts(x, cols) for x in half))
    whole = sorted(map(str, DX.reference_snapshot(ref, cols).collect()))
    assert sorted(map(str, DX.reference_snapshot(ref, cols, counts=merged).collect())) == whole
    assert DX.psi_against(kept.where("column_name = 'none'"), cur).count() == 0


def test_ids_keep_their_numbers_over_versions(spark, tmp_path):
    path = str(tmp_path / "entities")
    known = lambda *ids: spark.createDataFrame([(k, i) for k, i in ids], "kind string, id long")
    MX.keep_entities(known(("offer", 50), ("offer", 7), ("merchant", 1)), path, "v1")
    MX.keep_entities(known(("offer", 7), ("offer", 3), ("offer", 9)), path, "v2")
    last = MX.keep_entities(known(("offer", 1), ("offer", 3), ("shop", 4)), path, "v3")
    want = {("merchant", 1, 0, "v1"), ("offer", 7, 0, "v1"), ("offer", 50, 1, "v1"), ("offer", 3, 2, "v2"), ("offer", 9, 3, "v2"),
            ("offer", 1, 4, "v3"), ("shop", 4, 0, "v3")}
    assert set(map(tuple, last.collect())) == want
    MX.keep_entities(known(("offer", 1), ("offer", 3), ("shop", 4)), path, "v3")              # run again
    assert set(map(tuple, MX.read_entities(spark, path).collect())) == want


def test_a_later_model_keeps_the_ids_of_an_earlier_one(spark, tmp_path):
    path = str(tmp_path / "model")
    inter = lambda users: spark.createDataFrame([(2 ** 40 + u, o, 1.0) for u in users for o in range(4) if (u + o) % 2],
                                                "user_id long, offer_id long, confidence double")
    RX.save_model(RX.train_als(inter(range(3, 9)), rank=2, max_iter=1), path)
    first = {r["user_id"]: r["idx"] for r in RX.load_model(spark, path).user_index.collect()}
    RX.save_model(RX.train_als(inter(range(0, 12)), rank=2, max_iter=1, previous=RX.load_model(spark, path)), path)
    later = RX.load_model(spark, path)
    second = {r["user_id"]: r["idx"] for r in later.user_index.collect()}
    assert first.items() <= second.items() and sorted(second.values()) == list(range(12))
    assert {r["user_id"] for r in later.user_vectors().collect()} == {2 ** 40 + u for u in range(12)}


def test_there_is_a_whole_reference_while_one_is_replaced(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    features = spark.range(50).select(F.col("id").alias("user_id"), (F.col("id") * 1.5).alias("x"))
    assert OR.read_reference(spark, out) == (None, None)
    OR.replace_reference(spark, out, "v1", features)
    with monkeypatch.context() as m:
        m.setattr(OR.FS, "write_if_absent", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            OR.replace_reference(spark, out, "v2", features.withColumn("x", F.lit(0.0)))
    version, kept = OR.read_reference(spark, out)
    assert version == "v1" and kept.first()["n_ref"] == 50
    OR.replace_reference(spark, out, "v2", features.limit(10))
    assert OR.read_reference(spark, out)[0] == "v2" and OR.read_reference(spark, out)[1].first()["n_ref"] == 10


def test_versions_read_joined_tables_that_were_written_once(spark, tmp_path, monkeypatch):
    """Rows with null and repeated users and keys, in several files; each version would join and shuffle them anew."""
    cols = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(i % 7 if i else None, f"c{i}", i % 5, i * 900.0, ["FURNITURE", None][i % 2]) for i in range(10)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, f"s{i}", i, i - 1.0) for i in range(3)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
                 [(i % 4, f"p{i}", f"Brand#{i}", "t", i, 1.0) for i in range(6)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(i % 9, i % 7 if i % 5 else None, "F", 1.0, dt.datetime(2024, 1, 1 + i % 20), "1-URGENT") for i in range(12)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(i % 9, i % 5, i % 3 if i % 7 else None, i % 7, 1.0 * i, 500.0 * i, 0.0, 0.0, "ARN"[i % 3], "O",
                       dt.datetime(2024, 2, 1 + i % 20) if i % 11 else None) for i in range(60)]),
        "events": ("event_id long, ts timestamp, user_id long, event_type string, value double, props string",
                   [(i, dt.datetime(2024, 1, 3, i), i % 6, ["click", "purchase", "view"][i % 3], 1.0, '{"k": %d}' % i) for i in range(20)]),
    }
    d = str(tmp_path / "tables")
    for name, (schema, rows) in cols.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
    given = []

    def run_version(spark, tables, out_dir, version, *more):
        given.append({name: tables[name] for name in OR.JOINED})
        return OR._summary(spark, {"version": version, "drift_score": 0.0})

    monkeypatch.setattr(OR, "run_version", run_version)
    Q.QUERIES["offline_run"](spark, d)
    Q.QUERIES["offline_versions"](spark, d)
    assert len(given) == 4
    plain = bind(spark, d)
    for tables in given[:3]:                                            # the last one's receipts are meant to differ
        for name, df in tables.items():
            assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
            assert df.dtypes == plain[name].dtypes
            assert sorted(map(repr, df.collect())) == sorted(map(repr, plain[name].collect())) and df.count()
    assert "Join" not in given[3]["receipts"]._jdf.queryExecution().executedPlan().toString()
