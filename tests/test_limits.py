"""Chunked scoring, open domains, unknown checks, frozen commits, sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortex.operators import features as FT
from cohortex.operators import quality as QX
from cohortex.operators import topk as TK
from cohortex.plans import queries as QR
from cohortex.session import checkpoint_dir
from cohortex.sources import files as FS
from cohortex.streaming import ingest as IN


def _vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(n)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("limit", [16_000_000, 40])
def test_scorers_agree_with_numpy_in_one_chunk_and_in_many(spark, monkeypatch, limit):
    monkeypatch.setattr(TK, "MAX_BROADCAST_VALUES", limit)
    users, items = _vectors(spark, 60, 1, "u"), _vectors(spark, 25, 2, "b")
    u = np.array([r["vec"] for r in users.orderBy("u").collect()])
    b = np.array([r["vec"] for r in items.orderBy("b").collect()])
    asked = items.withColumn("k", (F.col("b") % 3 + 1).cast("int"))
    hidden = users.where(F.col("u") % 2 == 0).select("u", F.explode(F.array(F.col("u") % 25, F.lit(3).cast("long"))).alias("no"))
    hidden = hidden.unionByName(spark.createDataFrame([(999, 1), (5, None)], "u long, no long"))
    got = TK.per_broadcast_row_topk(users, "u", "vec", asked, ["b"], "vec", "k", normalize=False, masks=[(hidden, "b")]).collect()
    want = set()
    for j in range(25):
        free = [i for i in range(60) if not (i % 2 == 0 and j in (i % 25, 3))]
        want |= {(j, i) for i in sorted(free, key=lambda i: (-(u[i] @ b[j]), i))[:j % 3 + 1]}
    assert {(r["b"], r["u"]) for r in got} == want and len(got) == len(want)
    got = TK.per_stream_row_topk(users, "u", "vec", 5, items, "b", "vec").collect()
    assert {(r["u"], r["b"]) for r in got} == {(i, int(j)) for i in range(60) for j in np.argsort(-(b @ u[i]), kind="stable")[:5]}
    seen = spark.createDataFrame([(u, b) for u in range(60) for b in range(25) if (u * b) % 3 == 0 or u == 7], "u long, b long")
    monkeypatch.setattr(TK, "ITEM_BLOCK", 4)
    got = TK.per_stream_row_topk(users, "u", "vec", 5, items, "b", "vec", seen).collect()
    want = {(i, int(j), n + 1) for i in range(60) if i != 7
            for n, j in enumerate([j for j in np.argsort(-(b @ u[i]), kind="stable") if (i * j) % 3][:5])}
    assert {(r["u"], r["b"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_open_domains_have_a_long_form_and_an_optional_limit(spark):
    df = spark.range(1500).select(F.col("id").alias("user_id"), F.concat(F.lit("v"), "id").alias("c"))
    assert len(FT.observed_domain(df, "c")) == 1500
    with pytest.raises(ValueError):
        FT.observed_domain(df, "c", max_values=1000)
    long = FT.one_hot_long(df.unionByName(df.limit(1).withColumn("c", F.lit(None).cast("string"))), "user_id", "c", "p")
    assert long.count() == 1500 and long.where("user_id = 7").first()["feature"] == "p_v7"


def test_an_unknown_check_is_a_failed_row(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "ordinal long, a string")
    rules = {"required_columns": ["a"], "checks": [("no_null", {"column": "a"}), ("no_such_check", {"column": "a"})]}
    rows = {r["check_name"]: r for r in QX.table_checks(df, "t", rules).collect()}
    assert rows["no_null_a"]["failed"] == 1
    assert rows["no_such_check_a"]["success"] is False and "unknown" in rows["no_such_check_a"]["details"]


def test_violations_and_invalid_values_come_from_one_scan(spark, monkeypatch):
    monkeypatch.setitem(QX.RULES, "t", {"required_columns": [], "checks": [
        ("no_null", {"column": "a"}), ("valid_values", {"column": "b", "values": ["x", "y"]}),
        ("valid_values", {"column": "a", "values": ["1"]})]})
    df = spark.createDataFrame([(1, None, "x"), (2, "1", "q"), (3, None, "q"), (4, "2", None)], "ordinal long, a string, b string")
    got = QX.quality_violations(df, "t", "ordinal")
    assert sorted((r["check_name"], r["key"]) for r in got.collect()) == [
        ("no_null_a", "1"), ("no_null_a", "3"), ("valid_values_a", "4"), ("valid_values_b", "2"), ("valid_values_b", "3")]
    bad = QX.invalid_values(df, "t").collect()
    assert sorted((r["check_name"], r["value"]) for r in bad) == [("valid_values_a", "2"), ("valid_values_b", "q")]
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_a_late_batch_does_not_change_a_committed_version(spark, tmp_path):
    store, out, landing = (str(tmp_path / x) for x in ("store", "out", "landing"))

    def send(batch_id, n):
        rows = [("v1", "people", batch_id, 2, [{"a": str(i)} for i in range(n)])]
        IN.write_landing(spark.createDataFrame(rows, "version string, table string, batch_id int, total_batches int, "
                                                     "records array<map<string,string>>"), landing)
        IN.ingest(spark, landing, store, str(tmp_path / "checkpoint"))

    assert IN.committed_manifest(spark, out, "v1") is None
    send(1, 3)
    first = IN.commit_version(spark, store, "v1", out, {"people": ["a"]}).collect()
    send(2, 3)
    assert IN.read_manifest(spark, store).count() == 2
    assert IN.commit_version(spark, store, "v1", out, {"people": ["a"]}).collect() == first
    assert IN.read_committed(spark, out, "v1", "people").count() == 3 and first[0]["total_records"] == 3


def test_a_repeated_run_replaces_its_report_rows(spark, tmp_path):
    path = str(tmp_path / "report")
    for run, n in (("a", 2), ("b", 1), ("a", 3)):
        FS.append_report(spark.range(n), path, run)
    assert {r["run_id"]: r["count"] for r in spark.read.json(path).groupBy("run_id").count().collect()} == {"a": 3, "b": 1}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster)


def test_tables_load_from_committed_and_batch_files_and_absent_ones_are_left_out(spark, tmp_path):
    (tmp_path / "people.jsonl").write_text('{"a": "1"}\n{"a": "2"}\n')
    for n in (2, 10):
        (tmp_path / f"t_offer_batch_{n}.jsonl").write_text(f'{{"a": "{n}"}}\n')
    got = FS.load_tables(spark, str(tmp_path), {t: ["a"] for t in ("people", "offer", "merchant")})
    assert set(got) == {"people", "offer"}
    assert sorted(r["a"] for r in got["people"].collect()) == ["1", "2"]
    assert [(r["a"], r["batch_id"]) for r in got["offer"].orderBy("batch_id").collect()] == [("2", 2), ("10", 10)]


def test_nan_is_written_as_null(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), 1), (2.5, 1)], "x double, batch_id int")
    FS.write_batch_files(df, str(tmp_path), "t")
    assert sorted((r["x"] for r in FS.scan_batches(spark, str(tmp_path), "t", ["x"]).collect()), key=str) == ["2.5", None]


def test_als_audience_invariants(spark):
    sf = "/root/testdata/sf0.001"
    rows = QR.QUERIES["als_audience"](spark, sf).collect()
    requests = {r["request_id"]: r for r in QR.offer_requests(spark, sf).collect()}
    customers = {(r["merchant_id"], r["user_id"]) for r in QR.QUERIES["existing_customers"](spark, sf).collect()}
    inter = {(r["offer_id"], r["user_id"]) for r in QR.interactions_of(spark, sf).collect()}
    ranks = {}
    for r in rows:
        ranks.setdefault(r["request_id"], []).append(r["rank"])
        assert (r["status"] == "ok") == (r["user_id"] is not None)
        if r["status"] == "ok":
            assert (r["merchant_id"], r["user_id"]) not in customers and (r["offer_id"], r["user_id"]) not in inter
    assert ranks.keys() == requests.keys()
    for k, got in ranks.items():
        assert got == [None] or sorted(got) == list(range(1, len(got) + 1)) and len(got) <= requests[k]["top_n"]
    assert any(r["status"] == "ok" for r in rows)
