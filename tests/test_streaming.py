"""The status stream gives what the batch plan gives, whatever the order of the events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from jobtide.operators.records import first_milestones
from jobtide.streaming.jobs import request_metrics, status_stream

KINDS = ("applied", "interview_scheduled", "offered", "rejected", "withdrawn")


def test_status_stream(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, k % 7, rng.choice(KINDS), start + dt.timedelta(minutes=rng.randrange(600))) for k in range(120)]
    schema = "id long, job_id long, new_status string, changed_at timestamp"
    for part in range(3):
        spark.createDataFrame(rows[part::3] + rows[:5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = status_stream(stream).writeStream.outputMode("update").format("memory").queryName("status").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("status").groupBy("job_id").agg(F.max_by(F.struct("status", "applied_at", "interview_scheduled_at", "final_result_at", "changes"), "changes").alias("x")).select("job_id", "x.*")
    batch = spark.createDataFrame(rows, schema)
    want = first_milestones(batch).join(batch.groupBy("job_id").agg(F.max("changed_at").alias("last"), F.count("*").alias("changes")), "job_id")
    have = {r["job_id"]: (r["applied_at"], r["interview_scheduled_at"], r["final_result_at"], r["changes"]) for r in got.collect()}
    assert have == {r["job_id"]: (r["applied_at"], r["interview_scheduled_at"], r["final_result_at"], r["changes"]) for r in want.collect()}


def test_request_metrics(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, s), "/a", 0.5 * s, 500 if s == 2 else 200) for s in range(3)], "client long, ts timestamp, path string, seconds double, code int")
    r = request_metrics(rows).first()
    assert (r["requests"], r["errors"], r["mean_seconds"]) == (3, 1, 0.5)
