"""Stored tables, streams that feed them, typed sources, files, open JSON."""

import datetime as dt
import glob
import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobtide.operators import records as R
from jobtide.sources import parsing as P
from jobtide.sources.tables import KeyedTable
from jobtide.sources.typed import SCHEMAS, read_database, read_typed, typed
from jobtide.streaming import jobs as J

# Keyed tables


def files(path):
    return {f for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def bucket_of(f):
    return int(f.split("bucket=")[1].split("/")[0])


def test_upsert_touches_its_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "k long, x string, n int", buckets=8)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(k, "old", 0) for k in range(200)], "k long, x string, n int"), 0)
    before = files(table.path)
    assert len({bucket_of(f) for f in before}) == 8
    touched = table.upsert(spark.createDataFrame([(3, "new", 1), (1000, "new", 1)], "k long, x string, n int"), 1)
    after = files(table.path)
    assert 1 <= len(touched) <= 2
    assert {f for f in before if bucket_of(f) not in touched} == {f for f in after if bucket_of(f) not in touched}
    assert not {f for f in before if bucket_of(f) in touched} & after
    got = {r["k"]: (r["x"], r["n"]) for r in table.read().collect()}
    assert got == {k: ("old", 0) for k in range(200)} | {3: ("new", 1), 1000: ("new", 1)}
    plan = table._stored().filter(F.col("bucket").isin(touched))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60]


def test_upsert_repeats_and_interruptions(spark, tmp_path, monkeypatch):
    vaults = spark.createDataFrame([(1, "a", 3, True), (2, "b", None, False)], "user_id long, raw_content string, version int, confirmed boolean")
    incoming = spark.createDataFrame([(2, 1, "early", "{}"), (2, 5, "late", '{"s":1}'), (9, 1, "first", None)], "user_id long, seq long, raw_content string, structured_data string")
    table = KeyedTable(spark, str(tmp_path / "v"), "user_id", "user_id long, raw_content string, structured_data string, version int, confirmed boolean", buckets=4)
    table.upsert(vaults, 0)
    want = {(1, "a", None, 3, True), (2, "late", '{"s":1}', 1, False), (9, "first", None, 1, False)}
    for _ in range(3):  # the same batch again and again
        table.upsert(R.last_incoming(incoming), 1, R.vault_change)
        assert {tuple(r) for r in table.read().collect()} == want
    move = table._move
    monkeypatch.setattr(table, "_move", lambda batch: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        table.upsert(R.last_incoming(incoming), 2, R.vault_change)
    assert {tuple(r) for r in table.read().collect()} == want  # nothing of it is seen
    monkeypatch.setattr(table, "_move", move)
    os.makedirs(f"{table.pending}/batch=3/bucket=0")  # a write that ended early
    table.recover()
    assert {(r["user_id"], r["version"]) for r in table.read().collect()} == {(1, 3), (2, 2), (9, 2)}
    assert not os.listdir(table.pending)
    table.upsert(R.last_incoming(incoming), 2, R.vault_change)  # the interrupted batch comes once more
    assert {(r["user_id"], r["version"]) for r in table.read().collect()} == {(1, 3), (2, 2), (9, 2)}
    assert table.upsert(R.last_incoming(incoming.limit(0)), 4, R.vault_change) == []


# Streams

KINDS = ("applied", "interview_scheduled", "offered", "rejected", "withdrawn")
EVENT = "id long, job_id long, new_status string, changed_at timestamp"
START = dt.datetime(2024, 1, 1)


def events(n=150):
    rng = random.Random(8)
    return [(k, k % 9, rng.choice(KINDS), START + dt.timedelta(minutes=rng.randrange(600))) for k in range(n)]


def spread(spark, rows, path, parts=4):
    for part in range(parts):
        spark.createDataFrame(rows[part::parts] + rows[:3], EVENT).coalesce(1).write.mode("append").parquet(path)  # some come twice


def finish(query):
    try:
        query.awaitTermination()
    finally:
        query.stop()


def twins(spark, rows):
    batch = spark.createDataFrame(rows, EVENT)
    return sorted(map(tuple, J.batch_status(batch).collect())), sorted(map(tuple, R.status_timeline(batch).select("id", "job_id", "new_status", "changed_at", "old_status").collect()))


@pytest.mark.parametrize("fault", [None, "before", "between"])
def test_one_stream_two_tables(spark, tmp_path, fault, monkeypatch):
    rows = events()
    spread(spark, rows, str(tmp_path / "in"))
    tables = J.StatusTables(spark, str(tmp_path / "out"), buckets=4)
    source = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if fault:
        upsert, calls = tables.current.upsert, []

        def stop(rows, batch, change):
            calls.append(batch)
            if batch == 2 and calls.count(2) == 1:
                if fault == "between":
                    upsert(rows, batch, change)  # both outputs are written, but the stream doesn't learn of it
                raise OSError("stopped")
            return upsert(rows, batch, change)

        monkeypatch.setattr(tables.current, "upsert", stop)
        with pytest.raises(Exception, match="stopped"):
            finish(tables.start(source(), availableNow=True))
    finish(tables.start(source(), availableNow=True))
    status, history = twins(spark, rows)
    assert sorted(map(tuple, tables.current.read().collect())) == status
    assert sorted(map(tuple, tables.history().select("id", "job_id", "new_status", "changed_at", "old_status").collect())) == history


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(1, 1, "applied", START + dt.timedelta(days=5))], [(2, 1, "offered", START + dt.timedelta(days=6))], [(3, 1, "rejected", START)]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)  # files are read in order of their times
    tables = J.StatusTables(spark, str(tmp_path / "out"), buckets=2)
    query = tables.start(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path), availableNow=True)
    query.awaitTermination()
    assert J.dropped(query) == 1
    assert [(r["status"], r["changes"]) for r in tables.current.read().collect()] == [("offered", 2)]


def test_state_with_timers_gives_the_same(spark, tmp_path):
    rows = events(80)
    spread(spark, rows, str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = J.status_states(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        finish(writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")).start())
    finally:
        spark.conf.unset(name)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("job_id").agg(F.max_by(F.struct("status", "applied_at", "interview_scheduled_at", "final_result_at", "changes"), "changes").alias("x")).select("job_id", "x.*")
    want = J.batch_status(spark.createDataFrame(rows, EVENT)).select("job_id", "applied_at", "interview_scheduled_at", "final_result_at", "changes")
    assert sorted(map(tuple, got.drop("status").collect())) == sorted(map(tuple, want.collect()))


def test_windows_are_appended_behind_the_watermark(spark, tmp_path):
    kind = "client long, ts timestamp, path string, seconds double, code int"
    at = lambda **x: START + dt.timedelta(**x)
    import time

    for rows in (
        [(1, at(minutes=0, seconds=s), "/a", float(s), 200) for s in range(40)] + [(1, at(minutes=30), "/a", 1.0, 500)],
        [(1, at(minutes=31), "/c", 4.0, 200)],  # a watermark holds from the batch after the next one on
        [(2, at(minutes=1), "/a", 9.0, 200), (2, at(minutes=29), "/b", 2.0, 500), (2, at(minutes=50), "/b", 1.0, 200)],  # the first is too late
    ):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        finish(J.write_request_metrics(stream, str(tmp_path / "out"), availableNow=True))
        got = spark.read.schema("start timestamp, path string, requests long, errors long, mean_seconds double, p95_seconds double").parquet(str(tmp_path / "out/windows"))
        assert sorted(map(tuple, got.collect())) == [(at(minutes=0), "/a", 40, 0, 19.5, 37.0), (at(minutes=29), "/b", 1, 1, 2.0, 2.0), (at(minutes=30), "/a", 1, 1, 1.0, 1.0), (at(minutes=31), "/c", 1, 0, 4.0, 4.0)]


# Typed sources


def test_typed_rows(spark):
    rows = spark.createDataFrame([(1, "12", {"a": 1}, 1.5), (2, "x", None, None), (3, None, {"a": 2}, 2.0)], "k long, n string, m map<string,int>, more double")
    got = typed(rows, "k int, n int, m int, absent string").collect()
    assert [tuple(r) for r in got] == [(1, 12, None, None, ["m", "absent"]), (2, None, None, None, ["n", "absent"]), (3, None, None, None, ["m", "absent"])]
    with pytest.raises(ValueError, match="absent"):
        typed(rows, "k int, absent string", strict=True)
    assert typed(rows.limit(0), "k int").count() == 0


def test_typed_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "7", "2024-01-02"), (2, "seven", "soon")], "k long, n string, d string")
    want = [(1, 7, dt.date(2024, 1, 2), []), (2, None, None, ["n", "d"])]
    for form in ("csv", "json", "parquet"):
        path = str(tmp_path / form)
        (rows.write.option("header", "true") if form == "csv" else rows.write).format(form).save(path)
        assert sorted(tuple(r) for r in read_typed(spark, path, "k long, n int, d date", form).collect()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_database_and_files_give_the_same_rows(spark):
    files_ = read_typed(spark, "/root/testdata/sf0.001/customer.parquet", SCHEMAS["customer"])
    url, driver = "jdbc:derby:memory:tests;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    files_.drop("bad_columns").write.format("jdbc").options(url=url, driver=driver, dbtable="customer", createTableColumnTypes="c_name VARCHAR(200), c_mktsegment VARCHAR(100)").mode("overwrite").save()
    rows = read_database(spark, url, "customer", SCHEMAS["customer"], "c_custkey", 4, driver)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, files_.collect()))
    files_.limit(0).drop("bad_columns").write.format("jdbc").options(url=url, driver=driver, dbtable="nobody", createTableColumnTypes="c_name VARCHAR(200), c_mktsegment VARCHAR(100)").mode("overwrite").save()
    assert read_database(spark, url, "nobody", SCHEMAS["customer"], "c_custkey", 4, driver).count() == 0


# Files


def test_files_of_a_folder(spark, tmp_path):
    for name, size in (("a.PDF", 10), ("sub/b.png", 5000), ("c.docx", 7), ("d.exe", 1), ("e", 1), ("f.doc", 1), ("g.pdf", 0)):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    found = P.read_files(spark, str(tmp_path / "in"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    shown = lambda rows: {r["path"].rsplit("/", 1)[1]: (r["extension"], r["kind"], r["reason"]) for r in rows.collect()}
    assert shown(P.file_inventory(found, 1000)) == {
        "a.PDF": ("pdf", "pdf", None), "b.png": ("png", "image", "too large"), "c.docx": ("docx", "unknown", "not allowed"), "d.exe": ("exe", "unknown", "not allowed"), "e": ("", "unknown", "not allowed"), "f.doc": ("doc", "unknown", "not allowed"),
    }
    resumes = shown(P.file_inventory(found, 1000, P.RESUMES))
    assert resumes["c.docx"] == ("docx", "docx", None) and resumes["f.doc"] == ("doc", "doc", None) and resumes["a.PDF"] == ("pdf", "pdf", None)


# Open JSON


def leaves(value, path=()):
    if isinstance(value, dict | list):
        inner = value.items() if isinstance(value, dict) else ((str(k), x) for k, x in enumerate(value))
        return [leaf for k, x in inner if k != "_confirmed" for leaf in leaves(x, (*path, k))]
    text = str(value).lower() if isinstance(value, bool) else "" if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return [(json.dumps(path, ensure_ascii=False, separators=(",", ":")), text)]


KEYS = st.text(st.sampled_from('abé中 "\\{[_/'), max_size=4) | st.just("_confirmed")
LEAF = st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.integers(-400, 400).map(lambda x: x / 4) | st.text(st.sampled_from('ab"\\{}[]é\n'), max_size=5)
TREE = st.recursive(LEAF, lambda kids: st.lists(kids, max_size=3) | st.dictionaries(KEYS, kids, max_size=3), max_leaves=12)


def test_open_documents(spark):
    docs = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(TREE)
    def gather(tree):
        docs.append(tree)

    gather()
    texts = [json.dumps(d, ensure_ascii=bool(k % 2)) for k, d in enumerate(docs)] + [None, "", "no json", '{"a":', "[[[[[]]]]]", '{"a":1,"a":2}']
    want = sorted((k, *leaf) for k, d in enumerate(docs) if isinstance(d, dict | list) for leaf in leaves(d))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, doc string")
    got = P.flatten_json(rows, "k", "doc")
    assert sorted(map(tuple, got.collect())) == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert P.flatten_json(rows.limit(0), "k", "doc").count() == 0


def test_deep_documents(spark):
    n = 3 * P.LEVELS_AT_ONCE
    text = '{"a":' * n + "[1,true]" + "}" * n
    got = P.flatten_json(spark.createDataFrame([(1, text), (2, '{"x":"}}[["}')], "k long, doc string"), "k", "doc").collect()
    path = lambda *more: json.dumps([*["a"] * n, *more], separators=(",", ":"))
    assert sorted(map(tuple, got)) == [(1, path("0"), "1"), (1, path("1"), "true"), (2, '["x"]', "}}[[")]
