"""Ingest idempotency: first write wins, re-sending changes nothing."""

import hashlib
import json
import os
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortex.streaming import ingest as IN
from tests.mini import mini_tables


def _store(spark, tables, extra=()):
    root = tempfile.mkdtemp(prefix="ingest-test-")
    landing, store = os.path.join(root, "landing"), os.path.join(root, "store")
    for name, df in tables.items():
        IN.write_landing(IN.to_wire(df, "v1", name, 2), landing)
    for wire in extra:
        IN.write_landing(wire, landing)
    IN.ingest(spark, landing, store, os.path.join(root, "ckpt"))
    return root, landing, store


def test_first_write_wins_and_resend(spark):
    t = mini_tables(spark)
    dup = IN.to_wire(t["people"], "v1", "people", 2).where("batch_id = 1").withColumn("records",
                                                                                     F.slice("records", 1, 1))
    bad = dup.withColumn("table", F.lit("not_a_table"))
    root, landing, store = _store(spark, t, [dup, bad])
    man = IN.read_manifest(spark, store)
    people = {r["batch_id"]: r["records_count"] for r in man.where("table = 'people'").collect()}
    assert people == {1: 2, 2: 2, 3: 1}
    assert man.count() == sum(-(-len(v.collect()) // 2) for v in t.values())
    # re-send everything: a second stream run over a new landing file set adds nothing
    before = man.count()
    IN.write_landing(IN.to_wire(t["people"], "v1", "people", 2), landing)
    IN.ingest(spark, landing, store, os.path.join(root, "ckpt"))
    assert IN.read_manifest(spark, store).count() == before
    comp = IN.version_completeness(IN.read_manifest(spark, store)).collect()[0]
    assert comp["is_complete"] is True and comp["n_tables"] == 10
    rep = {r["table"]: r for r in IN.batch_manifest(IN.read_manifest(spark, store)).collect()}
    assert rep["people"]["n_records"] == 5 and rep["people"]["n_missing"] == 0


def test_commit_is_idempotent(spark):
    t = mini_tables(spark)
    root, landing, store = _store(spark, t)
    out = os.path.join(root, "committed")
    cols = {"people": ["user_id", "age_bucket", "gender_cd", "region", "last_activity_day"]}
    IN.commit_version(spark, store, "v1", out, cols)
    first = sorted(map(tuple, IN.read_committed(spark, out, "v1", "people").collect()))
    IN.commit_version(spark, store, "v1", out, cols)
    second = sorted(map(tuple, IN.read_committed(spark, out, "v1", "people").collect()))
    assert first == second and len(first) == 5
    assert [r["user_id"] for r in IN.read_committed(spark, out, "v1", "people").orderBy("ordinal").collect()] \
        == ["1", "2", "3", "4", "5"]


def test_batch_assign(spark):
    df = spark.range(0, 23).select(F.col("id").alias("ordinal"))
    rows = IN.batch_assign(df, 5).collect()
    assert {r["batch_id"] for r in rows} == {1, 2, 3, 4, 5}
    assert all(r["total_batches"] == 5 for r in rows)
    assert all(r["batch_id"] == r["ordinal"] // 5 + 1 for r in rows)


def test_first_line_of_a_file_wins(spark):
    root = tempfile.mkdtemp(prefix="ingest-test-")
    landing, store = os.path.join(root, "landing"), os.path.join(root, "store")
    os.makedirs(landing)
    lines = [json.dumps({"version": "v1", "table": "people", "batch_id": 1 + i % 3, "total_batches": 3,
                         "records": [{"user_id": str(i)}] * (1 + i // 3)}) for i in range(600)]
    with open(os.path.join(landing, "part-0.json"), "w") as f:
        f.write("\n".join([*lines, "{not json", ""]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")                # several blocks of one file
    try:
        IN.ingest(spark, landing, store, os.path.join(root, "ckpt"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert _records(spark, store) == [("people", 1, "0"), ("people", 2, "1"), ("people", 3, "2")]
    assert [r["malformed"] for r in IN.read_rejected(spark, store).collect()] == ["{not json"]


def _records(spark, store):
    kept = IN.read_batches(spark, store, IN.read_manifest(spark, store), 1)
    return sorted((r["table"], r["batch_id"], x["user_id"]) for r in kept.collect() for x in r["records"])


def _lines(path, name, *batches):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.writelines(json.dumps({"version": "v1", "table": t, "batch_id": b, "total_batches": 3,
                                 "records": [{"user_id": u} for u in users]}) + "\n" for t, b, users in batches)


def test_arrivals_are_kept_in_small_row_groups(spark, tmp_path):
    """A row group is what a writer buffers for each open table, and what a reader turns into columns at once."""
    store, landing, n = str(tmp_path / "store"), str(tmp_path / "landing"), 5 * IN.RAW_BATCHES + 1
    _lines(landing, "a.json", *[("people", b, [str(b), "x"]) for b in range(1, n + 1)], ("offer", 1, ["y"]))
    IN.ingest(spark, landing, store, str(tmp_path / "c"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "store" / "raw").rglob("*.parquet")]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == n + 1 and max(groups) <= IN.RAW_BATCHES
    assert _records(spark, store) == sorted([("people", b, x) for b in range(1, n + 1) for x in (str(b), "x")] + [("offer", 1, "y")])


def test_a_second_stream_adds_and_never_replaces(spark, tmp_path):
    """Two landing folders with checkpoints of their own, then a lost checkpoint, on one store."""
    store, one, two = (str(tmp_path / x) for x in ("store", "one", "two"))
    _lines(one, "a.json", ("people", 1, ["1"]), ("people", 2, ["2", "3"]))
    IN.ingest(spark, one, store, str(tmp_path / "c1"))
    _lines(two, "a.json", ("people", 2, ["late"]), ("people", 3, ["4"]), ("nothing", 1, ["x"]))
    IN.ingest(spark, two, store, str(tmp_path / "c2"))
    want = [("people", 1, "1"), ("people", 2, "2"), ("people", 2, "3"), ("people", 3, "4")]
    assert _records(spark, store) == want
    assert IN.read_manifest(spark, store).count() == 3 and IN.read_rejected(spark, store).count() == 1
    # the first stream loses its checkpoint: everything is sent again, with one batch more
    _lines(one, "b.json", ("people", 1, ["again"]), ("offer", 1, ["5"]))
    IN.ingest(spark, one, store, str(tmp_path / "c1-made-anew"))
    assert _records(spark, store) == [("offer", 1, "5"), *want]
    man = {(r["table"], r["batch_id"]): r for r in IN.read_manifest(spark, store).collect()}
    assert len({r["stream_id"] for r in man.values()}) == 3
    assert man["people", 1]["content_hash"] == hashlib.md5(b'[{"user_id":"1"}]').hexdigest()


def test_a_replayed_micro_batch_replaces_only_itself(spark, tmp_path, monkeypatch):
    """The stream breaks off after its arrivals are written and before the manifest is; another
    stream takes one of its batches meanwhile; the restarted stream gets the rest."""
    store, one, two, c1 = (str(tmp_path / x) for x in ("store", "one", "two", "c1"))
    _lines(one, "a.json", ("people", 1, ["1"]), ("people", 2, ["2"]))
    with monkeypatch.context() as m:
        m.setattr(IN, "_first_of_key", lambda rows: 1 / 0)
        with pytest.raises(Exception):
            IN.ingest(spark, one, store, c1)
    _lines(two, "a.json", ("people", 2, ["other"]))
    IN.ingest(spark, two, store, str(tmp_path / "c2"))
    assert _records(spark, store) == [("people", 2, "other")]
    IN.ingest(spark, one, store, c1)
    assert _records(spark, store) == [("people", 1, "1"), ("people", 2, "other")]
    IN.ingest(spark, one, store, c1)
    assert _records(spark, store) == [("people", 1, "1"), ("people", 2, "other")]


def test_committed_rows_follow_their_batches_over_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IN, "ROWS_PER_FILE", 40)
    store, landing, out = (str(tmp_path / x) for x in ("store", "landing", "out"))
    n = 237
    df = spark.range(n).select(F.col("id").alias("user_id"), (F.lit(1000) - F.col("id")).alias("ordinal"))
    IN.write_landing(IN.to_wire(df, "v1", "people", 9).repartition(5), landing)
    IN.ingest(spark, landing, store, str(tmp_path / "c"))
    first = IN.commit_version(spark, store, "v1", out, {"people": ["user_id"], "offer": ["offer_id"]}).collect()
    assert [tuple(r) for r in first] == [("people", n, 27)]
    back = IN.read_committed(spark, out, "v1", "people")
    rows = back.select("ordinal", "user_id", "batch_id").collect()
    assert sorted((r["ordinal"], int(r["user_id"]), r["batch_id"]) for r in rows) == [(i, n - 1 - i, i // 9 + 1) for i in range(n)]
    files = back.groupBy(F.col("_metadata.file_path")).agg(F.min("ordinal"), F.max("ordinal"), F.count("*")).collect()
    assert len(files) == 6 and all(hi - lo + 1 == k for _, lo, hi, k in files)
    assert IN.read_committed(spark, out, "v1", "offer").count() == 0
    with pytest.raises(ValueError, match="not in order"):
        IN._check_order(back.where("ordinal <> 5"), n, "people")


def test_batches_are_packed_on_their_way_and_whole_at_the_end(spark, tmp_path):
    """Ties, nulls, quotes and tables of different width, in batches that cross the pieces they travel in."""
    n = 700
    wide = spark.range(n).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('"é\n'), F.col("id") % 5)).alias("region"),
                                 F.lit("the same text " * 20).alias("note"), (F.col("id") % 7).alias("ordinal"))
    narrow = spark.range(5).select(F.col("id").alias("offer_id"), F.col("id").alias("ordinal"))
    tables = {"people": wide.repartition(6), "offer": narrow}
    text = lambda v: None if v is None else str(v)
    rows = sorted(wide.collect(), key=lambda r: (r["ordinal"], text(r["user_id"])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {(r["table"], r["batch_id"]): r for r in IN.to_wires(tables, "v1", 150).collect()}
        landing = tmp_path / "landing"
        IN.write_landing(IN.to_wires(tables, "v1", 150), str(landing))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == [("offer", 1), *(("people", i) for i in range(1, 6))]
    assert {r["total_batches"] for k, r in got.items() if k[0] == "people"} == {5}
    assert [x for i in range(1, 6) for x in got["people", i]["records"]] == \
        [{"user_id": text(r["user_id"]), "region": r["region"], "note": r["note"]} for r in rows]
    assert got["offer", 1]["records"] == [{"offer_id": str(i)} for i in range(5)]
    whole = sum(len(json.dumps({k: v for k, v in r.asDict().items()})) for r in got.values())
    assert sum(f.stat().st_size for f in landing.glob("part-*")) * 4 < whole
    back = {(r["table"], r["batch_id"]): r["records"] for r in spark.read.schema(IN.WIRE_SCHEMA).json(str(landing)).collect()}
    assert back == {k: r["records"] for k, r in got.items()}


def test_a_commit_sends_values_without_their_names(spark, tmp_path):
    store, landing, out = (str(tmp_path / x) for x in ("store", "landing", "out"))
    df = spark.createDataFrame([(1, None, 2), (None, "b", 1), (3, "c", 0)], "user_id long, region string, ordinal long")
    IN.write_landing(IN.to_wire(df, "v1", "people", 2), landing)
    IN.ingest(spark, landing, store, str(tmp_path / "c"))
    IN.commit_version(spark, store, "v1", out, {"people": ["region", "absent", "user_id"]})
    back = IN.read_committed(spark, out, "v1", "people")
    assert sorted((r["ordinal"], r["user_id"], r["region"], r["absent"], r["batch_id"]) for r in back.collect()) == \
        [(0, "3", "c", None, 1), (1, None, "b", None, 1), (2, "1", None, None, 2)]
    assert all(".zstd." in f for f in back.inputFiles())


def test_arrivals_are_written_without_a_sort_and_the_session_is_left_alone(spark, tmp_path, monkeypatch):
    asked = []
    process = IN._process

    def watched(batch, epoch_id, store_dir):
        process(batch, epoch_id, store_dir)
        asked.append(batch.sparkSession.conf.get("spark.sql.maxConcurrentOutputFileWriters"))

    monkeypatch.setattr(IN, "_process", watched)
    one, store = str(tmp_path / "one"), str(tmp_path / "store")
    _lines(one, "a.json", ("people", 1, ["1"]), ("offer", 1, ["2"]), ("people", 2, ["3"]), ("offer", 2, ["4"]))
    IN.ingest(spark, one, store, str(tmp_path / "c"))
    assert asked == ["64"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert _records(spark, store) == [("offer", 1, "2"), ("offer", 2, "4"), ("people", 1, "1"), ("people", 2, "3")]
