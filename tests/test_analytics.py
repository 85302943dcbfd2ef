"""Worked cases of the analytics, gates, scores and histories."""

import datetime as dt
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from jobtide.functions.scalar import RANGE_DAYS, date_range, days_between
from jobtide.operators import analytics as A
from jobtide.operators import lexicon as L
from jobtide.operators import records as R
from jobtide.plans import registry

DAY = dt.datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def apps(spark):
    rows = [(1, "offered", "referral"), (2, "rejected", "site"), (3, "applied", ""), (4, "interviewing", None), (5, "preparing", "referral")]
    made = spark.createDataFrame([(k, "u1", s, c) for k, s, c in rows], "id int, user_id string, status string, channel string")
    stamp = F.lit(DAY).cast("timestamp")
    return made.select("*", *[stamp.alias(c) for c in ("created_at", "applied_at", "first_response_at", "final_result_at", "updated_at")], F.lit("big").alias("company_size"), F.lit(None).cast("int").alias("match_score"))


def test_totals(apps):
    r = A.application_totals(apps).first()
    assert (r["applications"], r["interviews"], r["offers"], r["rejections"]) == (5, 3, 1, 1)
    assert (r["interview_rate"], r["offer_rate"], r["success_rate"]) == (0.6, 1 / 3, 0.2)


def test_funnel_never_grows(apps):
    rows = A.funnel(apps).collect()
    assert [(r["count"], r["percentage"]) for r in rows] == [(5, 100.0), (3, 60.0), (1, 20.0)]
    assert (rows[0]["interview_rate"], rows[0]["offer_rate"], rows[0]["overall_rate"]) == (0.6, 0.3333, 0.2)


def test_channels(apps):
    rows = {r["channel"]: r for r in A.channel_ranking(apps).collect()}
    assert {k: (r["conversion_rate"], r["rank"]) for k, r in rows.items()} == {"site": (1.0, 1), "referral": (0.5, 2), "unknown": (0.5, 3)}
    assert sum(r["applications"] for r in rows.values()) == 5


@pytest.mark.parametrize(("code", "n"), [("1m", 5), ("3m", 13), ("6m", 26), ("1y", 53)])
def test_spine(apps, code, n):
    assert A.weekly_trend(apps, "2024-01-11", code).count() == n == RANGE_DAYS[code] // 7 + 1


def test_summary_of_user_without_rows(spark, apps):
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    reviews = spark.createDataFrame([("u1", DAY, 0)], "user_id string, interview_date timestamp, overall_rating int")
    rows = {r["user_id"]: r for r in A.user_summary(users, apps, reviews).collect()}
    assert rows["u2"]["applications"] == 0 and rows["u2"]["interview_rate"] is None and rows["u2"]["rating_trend"] is None
    assert rows["u1"]["rating_trend"] == {}


def test_days_round_down(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2))], "a timestamp, b timestamp")
    assert row.select(days_between("a", "b")).first()[0] == 0


def test_usage(spark):
    rows = spark.createDataFrame([("o", s) for s in ("succeeded", "running", "failed", "failed")], "owner string, state string")
    assert tuple(A.usage_account(rows).first()) == ("o", 1, 1, 1)


@pytest.mark.parametrize(("text", "want"), [("2020.09-2024.06 x", ("2020", "")), ("2020 - 2024", ("2020", "2024")), ("2020 - 至今", ("2020", "至今")), (None, ("", "")), ("none", ("", ""))])
def test_date_range(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(date_range("t")).first()[0]) == want


def test_export_gate(spark):
    """One application for each refusal, in the order in which they are tried."""
    jobs = spark.createDataFrame(
        [(0, "u", "text", "jd"), (1, "u", "text", "jd"), (2, "u", "text", "jd"), (3, "u", "text", "jd"), (4, "u", "edited", "jd"), (5, "u", "text", "new jd"), (6, "u", "", "jd"), (7, "u", None, "jd"), (8, "none", "text", "jd"), (9, "w", "text", "jd"), (10, "u", "text", None)],
        "id int, user_id string, resume_text string, jd_text string",
    )
    vaults = spark.createDataFrame([("u", 2, True), ("w", 2, False)], "user_id string, version int, confirmed boolean")
    rows = [(0, 1, False, 1, "other", "jd"), (0, 2, True, 2, "text", "jd"), (1, 1, False, 2, "text", "jd"), (2, 1, True, 1, "text", "jd"), (4, 1, True, 2, "text", "jd"), (5, 1, True, 2, "text", "jd"), (9, 1, True, 2, "text", "jd"), (10, 1, True, 2, "text", None)]
    versions = spark.createDataFrame(rows, "job_id int, version int, reviewed boolean, source_version int, content string, jd string")
    versions = versions.select("job_id", "version", "reviewed", "source_version", R.digest("content").alias("content_digest"), R.digest("jd").alias("source_jd_digest"))
    gate = R.export_gate(jobs, vaults, versions)
    assert {r["id"]: r["reason"] for r in gate.collect()} == {
        0: None, 1: "not reviewed", 2: "vault changed", 3: "no version", 4: "résumé changed", 5: "description changed", 6: "no résumé", 7: "no résumé", 8: "vault not confirmed", 9: "vault not confirmed", 10: None,
    }
    for exchange in [x for x in gate._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]:
        assert "resume_text" not in exchange and "jd_text" not in exchange  # texts don't cross a join


def test_version_gate(spark):
    jobs = spark.createDataFrame([(1, "u", "jd")], "id int, user_id string, jd_text string")
    vaults = spark.createDataFrame([("u", 2, True)], "user_id string, version int, confirmed boolean")
    drafts = [(1, 1, "a", True, 2, "jd"), (1, 2, "b", True, 1, "jd"), (1, 3, "c", True, 2, "old"), (1, 4, "d", False, 1, "old")]
    rows = R.version_gate(spark.createDataFrame(drafts, "job_id int, id int, content string, reviewed boolean, source_version int, source_jd_text string"), jobs, vaults)
    assert {r["id"]: r["reason"] for r in rows.collect()} == {1: None, 2: "vault changed", 3: "description changed", 4: None}


def test_stale_analysis(spark):
    jobs = spark.createDataFrame([(k, u, score, version, "jd", source) for k, (u, score, version, source) in enumerate([("u", 5, 2, "jd"), ("u", 0, 0, "jd"), ("u", 5, 1, "jd"), ("u", 5, 2, "old"), ("u", None, 1, "old"), ("x", 5, 2, "jd"), ("u", 5, 2, None)])],
                                 "id int, user_id string, match_score int, source_vault_version int, jd_text string, source string")
    vaults = spark.createDataFrame([("u", 2)], "user_id string, version int")
    rows = R.stale_analysis(jobs.withColumn("source_jd_digest", R.digest("source")), vaults)
    assert {r["id"]: r["stale"] for r in rows.collect()} == {0: False, 1: True, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_rules_of_rows(spark):
    rows = spark.createDataFrame([(0, 6, "x" * 5001, None), (1, None, None, "r")], "round_number int, overall_rating int, what_went_well string, round_type string")
    assert [r["violations"] for r in R.validate_rows(rows, R.review_rules(rows.columns)).collect()] == [["overall_rating", "round_number", "what_went_well", "round_type"], []]
    rows = spark.createDataFrame([("  ", "t" * 255, "jd"), (None, " " + "t" * 255 + "\n", "j" * 50_001)], "company_name string, job_title string, jd_text string")
    assert [r["violations"] for r in R.validate_rows(rows, R.application_rules(rows.columns)).collect()] == [["company_name"], ["company_name", "jd_text"]]
    rows = spark.createDataFrame([("offer_pending", None), ("waiting", "n" * 1001)], "new_status string, notes string")
    assert [r["violations"] for r in R.validate_rows(rows, R.status_rules(rows.columns)).collect()] == [[], ["new_status", "notes"]]


def test_rules_of_long_texts(spark):
    """Blanks at the ends don't count, those inside do and cost no more than letters; characters count, not bytes."""
    blanks, few = "\u3000 \x85\n", ("c", "t")
    texts = ["中" * 50_000, "中" * 50_001, "𝄞" * 50_000, "𝄞" * 50_001, blanks + "j" * 50_000 + " \t" + blanks + "  ", blanks * 20_000, "\x1f", "a" + " " * 49_998 + "b", "a" + "\n " * 150_000 + "b", None]
    rows = spark.createDataFrame([(k, *few, x) for k, x in enumerate(texts)], "id int, company_name string, job_title string, jd_text string").coalesce(1)
    start = time.monotonic()
    got = {r["id"]: r["violations"] for r in R.validate_rows(rows, R.application_rules(rows.columns)).select("id", "violations").collect()}
    assert time.monotonic() - start < 15
    assert got == {k: ["jd_text"] if k in (1, 3, 5, 8, 9) else [] for k in range(len(texts))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_applications_are_checked_by_all_cores(spark):
    rows = registry.queries()["flt6_validate_applications"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_combined_score(spark):
    rows = [("p", d, s, ["a"], ["b"], ["c"]) for d, s in (("skills", 85), ("experience", 75), ("projects", 80), ("education", 70))]
    scores = spark.createDataFrame(rows, "pair_id string, dimension string, score int, matched array<string>, missing array<string>, suggestions array<string>")
    r = L.score_summary(scores, L.combine_scores(scores)).first()
    assert (r["score"], r["band"], r["strong"], r["weak"]) == (79, "good", ["experience", "projects", "skills"], [])


#: Reviews of two users: order, line, round type, date. Both ends of the dates count; the order of user 3 has none within.
REVIEWS = [
    (1, 1, "N", dt.datetime(1996, 1, 1)), (1, 2, "A", dt.datetime(1999, 12, 31)), (1, 3, "R", dt.datetime(1997, 5, 5)), (1, 4, None, dt.datetime(1998, 1, 1)), (1, 5, "N", dt.datetime(1995, 12, 31)),
    (2, 1, "A", dt.datetime(1997, 1, 1)), (2, 2, "A", dt.datetime(1997, 1, 1)), (2, 3, "R", None), (3, 1, "N", dt.datetime(2000, 1, 1)),
]


@pytest.fixture(scope="module")
def review_tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reviews"))
    lines = spark.createDataFrame(REVIEWS, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz")
    rest = {"l_partkey": F.lit(6).cast("long"), "l_suppkey": F.lit(1).cast("long"), "l_quantity": F.lit(6.0), "l_extendedprice": F.lit(6.0), "l_linestatus": F.lit("O")}  # no ratings
    lines.withColumns(rest).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return path


def test_counted_reviews_have_every_round_type(spark, review_tables):
    """Neither round type nor ratings nor tags take a review out of the count; the SQL says the same."""
    want = {7: 4, 8: 2}
    assert {r["user_id"]: r["n"] for r in registry.queries()["flt4_count_reviews"](spark, review_tables).collect()} == want
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{review_tables}/{t}.parquet/*.parquet'")
    assert dict(con.execute(registry.oracle_sql()["flt4_count_reviews"]).fetchall()) == want


def test_count_reviews_by_date_and_round(spark):
    rows = spark.createDataFrame([(1, *r) for r in REVIEWS], "user_id int, o long, l int, round_type string, interview_date timestamp")
    n = lambda **bounds: [r["n"] for r in R.count_reviews(rows, **bounds).collect()]
    dates = {"start": dt.datetime(1996, 1, 1), "end": dt.datetime(1999, 12, 31)}
    assert (n(), n(**dates), n(**dates, round_type="A"), n(round_type="N"), n(round_type="X")) == ([9], [6], [3], [3], [])
