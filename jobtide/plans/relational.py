"""Queries of the relational operators: analytics, filters, joins, histories, writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalar import RANGE_DAYS, rate
from jobtide.operators import analytics as A
from jobtide.operators import records as R
from jobtide.plans.book import query
from jobtide.session import shared_folder
from jobtide.sources.tables import KeyedTable
from jobtide.sources.typed import SCHEMAS, read_database, read_typed
from jobtide.sources.views import STATUSES, Views

AS_OF = "2001-08-02"
IV = "status IN ('interviewing','offered','rejected')"
COUNTS = f"count(*)::BIGINT AS applications, count(*) FILTER ({IV})::BIGINT AS interviews, count(*) FILTER (status = 'offered')::BIGINT AS offers"


def _r(a: str, b: str, n: int = 4, empty: str | None = "0") -> str:
    p = f"1e{n}::DOUBLE"
    value = f"floor(({a})::DOUBLE / nullif(({b})::DOUBLE, 0) * {p} + 0.5) / {p}"
    return value if empty is None else f"coalesce({value}, {empty}::DOUBLE)"


def _days(a: str, b: str) -> str:
    return f"floor((epoch_us({b}) - epoch_us({a})) / 86400000000)"


TOTALS = f"""
SELECT user_id, {COUNTS}, count(*) FILTER (status = 'rejected')::BIGINT AS rejections,
       avg(CASE WHEN {_days('applied_at', 'first_response_at')} >= 0 THEN {_days('applied_at', 'first_response_at')} END) AS avg_days_to_response,
       avg(CASE WHEN {_days('applied_at', 'final_result_at')} >= 0 THEN {_days('applied_at', 'final_result_at')} END) AS avg_days_to_result
FROM applications GROUP BY user_id"""


@query(f"SELECT *, interviews / nullif(applications, 0)::DOUBLE AS interview_rate, offers / nullif(interviews, 0)::DOUBLE AS offer_rate, offers / nullif(applications, 0)::DOUBLE AS success_rate FROM ({TOTALS}) WHERE true")
def agg1_application_totals(v: Views) -> DataFrame:
    return A.application_totals(v.applications)


@query(f"SELECT user_id, avg_days_to_response, avg_days_to_result FROM ({TOTALS})")
def agg2_time_to_response(v: Views) -> DataFrame:
    return A.application_totals(v.applications).select("user_id", "avg_days_to_response", "avg_days_to_result")


CHANNELS = f"SELECT user_id, coalesce(nullif(channel, ''), 'unknown') AS channel, {COUNTS} FROM applications GROUP BY 1, 2"


@query(f"SELECT user_id, channel, {_r('interviews', 'applications', 4, None)} AS effectiveness FROM ({CHANNELS})")
def agg3_channel_effectiveness(v: Views) -> DataFrame:
    return A.channel_effectiveness(v.applications)


@query("SELECT user_id, coalesce(nullif(company_size, ''), 'unknown') AS company_size, count(*)::BIGINT AS n FROM applications GROUP BY 1, 2")
def agg4_company_size_distribution(v: Views) -> DataFrame:
    return A.company_size_distribution(v.applications_with_company)


MONTHS = f"SELECT user_id, strftime(interview_date, '%Y-%m') AS month, {_r('sum(overall_rating)', 'count(*)', 2, None)} AS mean_rating FROM reviews WHERE overall_rating IS NOT NULL AND overall_rating <> 0 GROUP BY 1, 2"


@query(MONTHS)
def agg5_rating_trend(v: Views) -> DataFrame:
    return A.rating_trend(v.reviews)


@query(f""", t AS ({TOTALS}),
c AS (SELECT user_id, string_agg(channel || '=' || cast(round(effectiveness * 10000) AS BIGINT), ',' ORDER BY channel) AS channels FROM (SELECT user_id, channel, {_r('interviews', 'applications', 4, None)} AS effectiveness FROM ({CHANNELS})) GROUP BY 1),
m AS (SELECT user_id, count(*)::INTEGER AS months FROM ({MONTHS}) GROUP BY 1),
r AS (SELECT DISTINCT user_id FROM reviews)
SELECT u.user_id, coalesce(applications, 0)::BIGINT AS applications, coalesce(interviews, 0)::BIGINT AS interviews, coalesce(offers, 0)::BIGINT AS offers, coalesce(rejections, 0)::BIGINT AS rejections,
  interviews / nullif(applications, 0)::DOUBLE AS interview_rate, avg_days_to_response, coalesce(channels, '') AS channels, CASE WHEN r.user_id IS NOT NULL THEN coalesce(months, 0) END::INTEGER AS months
FROM users u LEFT JOIN t ON t.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id LEFT JOIN m ON m.user_id = u.user_id LEFT JOIN r ON r.user_id = u.user_id""")
def agg6_user_summary(v: Views) -> DataFrame:
    rows = A.user_summary(v.users, v.applications_with_company, v.reviews)
    entries = F.array_sort(F.transform(F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("long").cast("string"))))
    return rows.select(
        "user_id", "applications", "interviews", "offers", "rejections", "interview_rate", "avg_days_to_response",
        F.coalesce(F.array_join(entries, ","), F.lit("")).alias("channels"), F.when(F.col("rating_trend").isNotNull(), F.size("rating_trend")).alias("months"),
    )


@query(f""", t AS (SELECT user_id, {COUNTS} FROM applications GROUP BY 1)
SELECT user_id, stage, count, {_r('count', 'applications / 100.0::DOUBLE', 2, None).replace("(count)::DOUBLE / nullif((applications / 100.0::DOUBLE)::DOUBLE, 0)", "count::DOUBLE / applications::DOUBLE * 100")} AS percentage,
  {_r('interviews', 'applications')} AS interview_rate, {_r('offers', 'interviews')} AS offer_rate, {_r('offers', 'applications')} AS overall_rate
FROM (SELECT *, unnest(['投递', '面试', 'Offer']) AS stage, unnest([applications, interviews, offers]) AS count FROM t)""")
def agg7_funnel(v: Views) -> DataFrame:
    return A.funnel(v.applications)


def _weekly_sql(code: str) -> str:
    days = RANGE_DAYS[code]
    start = f"(TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY)"
    return f"""
SELECT s.user_id, s.bucket::INTEGER AS bucket, strftime({start} + INTERVAL 7 DAY * s.bucket, '%Y-%m-%d') AS date,
  coalesce(applications, 0)::BIGINT AS applications, coalesce(interviews, 0)::BIGINT AS interviews, coalesce(offers, 0)::BIGINT AS offers,
  {_r('interviews', 'applications')} AS interview_rate, {_r('offers', 'interviews')} AS offer_rate
FROM (SELECT user_id, unnest(range({days // 7 + 1})) AS bucket FROM (SELECT DISTINCT user_id FROM applications)) s
LEFT JOIN (SELECT user_id, floor((epoch_us(created_at) - epoch_us({start})) / 604800000000)::INTEGER AS bucket, {COUNTS} FROM applications WHERE created_at >= {start} GROUP BY 1, 2) c
ON c.user_id = s.user_id AND c.bucket = s.bucket"""


@query(_weekly_sql("3m"))
def agg8_weekly_trend(v: Views) -> DataFrame:
    return A.weekly_trend(v.applications, AS_OF, "3m")


@query(f""", w AS ({_weekly_sql('1y')}), m AS (
SELECT user_id, avg(CASE WHEN bucket > 48 AND applications > 0 THEN interview_rate END) AS recent, avg(CASE WHEN bucket < 4 AND applications > 0 THEN interview_rate END) AS early FROM w GROUP BY 1)
SELECT user_id, CASE WHEN recent > early * 1.1::DOUBLE THEN 'improving' WHEN recent < early * 0.9::DOUBLE THEN 'declining' ELSE 'stable' END AS direction FROM m""")
def agg9_trend_direction(v: Views) -> DataFrame:
    return A.trend_direction(A.weekly_trend(v.applications, AS_OF, "1y"), "1y")


RANKED = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conversion_rate DESC, channel)::INTEGER AS rank FROM (SELECT *, {_r('interviews', 'applications', 4, None)} AS conversion_rate FROM ({CHANNELS}))"


@query(f"SELECT *, CASE WHEN rank = 1 AND channel <> 'unknown' THEN 'Use more: ' || channel END AS recommendation FROM ({RANKED})")
def agg10_channel_ranking(v: Views) -> DataFrame:
    return A.channel_ranking(v.applications)


@query(f""", s AS (SELECT TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY AS t),
a AS (SELECT user_id, {COUNTS} FROM applications, s WHERE created_at >= t GROUP BY 1),
r AS (SELECT user_id, count(*)::BIGINT AS reviews, sum(overall_rating) AS sm, count(overall_rating) AS n FROM reviews, s WHERE interview_date >= t GROUP BY 1)
SELECT coalesce(a.user_id, r.user_id) AS user_id, coalesce(applications, 0)::BIGINT AS applications, coalesce(interviews, 0)::BIGINT AS interviews, coalesce(offers, 0)::BIGINT AS offers,
 coalesce(reviews, 0)::BIGINT AS reviews, {_r('sm', 'n', 2, None)} AS mean_rating, {_r('interviews', 'applications')} AS interview_rate, {_r('offers', 'interviews')} AS offer_rate
FROM a FULL JOIN r ON a.user_id = r.user_id""")
def agg11_period_insight(v: Views) -> DataFrame:
    return A.period_insight(v.applications, v.reviews, AS_OF, "6m")


@query("SELECT user_id, count(*)::BIGINT AS reviews, avg(overall_rating) AS mean_overall_rating, avg(technical_rating) AS mean_technical_rating, avg(communication_rating) AS mean_communication_rating FROM reviews GROUP BY 1")
def agg12_review_stats(v: Views) -> DataFrame:
    return A.review_stats(v.reviews)


@query("SELECT user_id, overall_rating, count(*)::BIGINT AS n FROM reviews WHERE overall_rating IS NOT NULL GROUP BY 1, 2")
def agg13_rating_histogram(v: Views) -> DataFrame:
    return A.value_histogram(v.reviews, "overall_rating")


@query("SELECT user_id, round_type, count(*)::BIGINT AS n FROM reviews WHERE round_type IS NOT NULL GROUP BY 1, 2")
def agg13_round_type_histogram(v: Views) -> DataFrame:
    return A.value_histogram(v.reviews, "round_type")


@query("SELECT user_id, tag, count(*)::BIGINT AS n FROM (SELECT user_id, unnest(tags) AS tag FROM reviews) GROUP BY 1, 2")
def agg14_tag_frequency(v: Views) -> DataFrame:
    return A.tag_frequency(v.reviews)


@query(f""", t AS (SELECT user_id, count(*)::BIGINT AS total, count(match_score)::BIGINT AS analysed, count(*) FILTER (coalesce(resume_text, '') <> '')::BIGINT AS with_resume FROM applications GROUP BY 1)
SELECT t.*, s.status, coalesce(n, 0)::BIGINT AS n, {_r('coalesce(n, 0)', 'total', 4, None)} AS share
FROM t CROSS JOIN (SELECT unnest({list(STATUSES)}) AS status) s LEFT JOIN (SELECT user_id, status, count(*) AS n FROM applications GROUP BY 1, 2) c ON c.user_id = t.user_id AND c.status = s.status""")
def agg15_status_snapshot(v: Views) -> DataFrame:
    return A.status_snapshot(v.applications, STATUSES)


@query(f""", t AS (SELECT user_id, {COUNTS} FROM applications GROUP BY 1)
SELECT u.user_id, coalesce(applications, 0)::BIGINT AS applications, coalesce(interviews, 0)::BIGINT AS interviews, coalesce(offers, 0)::BIGINT AS offers,
 {_r('interviews', 'applications')} AS interview_rate, {_r('offers', 'interviews')} AS offer_rate, {_r('offers', 'applications')} AS overall_rate, 'stable' AS recent_trend
FROM users u LEFT JOIN t ON t.user_id = u.user_id""")
def agg16_overview(v: Views) -> DataFrame:
    return A.overview(v.users, v.applications)


@query("""SELECT user_id AS owner, count(*) FILTER (event_type = 'purchase')::BIGINT AS used, count(*) FILTER (event_type = 'view')::BIGINT AS reserved,
 greatest(0, 50 - count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'view'))::BIGINT AS remaining FROM events GROUP BY 1""")
def agg18_usage_account(v: Views) -> DataFrame:
    kind = F.col("event_type")
    states = v.table("events").select(F.col("user_id").alias("owner"), F.when(kind == "purchase", "succeeded").when(kind == "view", "running").otherwise("failed").alias("state"))
    return A.usage_account(states, 50)


# Filters


@query("SELECT id, status, strftime(updated_at, '%Y-%m-%d') AS updated FROM applications WHERE user_id = 7")
def flt1_user_jobs(v: Views) -> DataFrame:
    return R.user_jobs(v.applications, 7).select("id", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("SELECT id, company_name, job_title FROM applications WHERE status = 'offered' AND contains(lower(company_name || ' ' || job_title), '11 engineer')")
def flt2_search_jobs(v: Views) -> DataFrame:
    return R.search_jobs(v.applications_with_company, "11 Engineer", "offered").select("id", "company_name", "job_title")


FLT3 = "interview_date >= TIMESTAMP '1996-01-01' AND interview_date <= TIMESTAMP '1999-12-31' AND overall_rating >= 3 AND overall_rating <= 5 AND list_contains(tags, 'A') AND list_contains(tags, 'F')"
BOUNDS = {"least": 3, "most": 5, "tags": ("A", "F")}


def _bounds() -> dict:
    import datetime as dt

    return BOUNDS | {"start": dt.datetime(1996, 1, 1), "end": dt.datetime(1999, 12, 31)}


@query(f"SELECT user_id, id, overall_rating FROM reviews WHERE {FLT3}")
def flt3_filter_reviews(v: Views) -> DataFrame:
    return R.filter_reviews(v.reviews, **_bounds()).select("user_id", "id", "overall_rating")


@query("SELECT user_id, count(*)::BIGINT AS n FROM reviews WHERE interview_date >= TIMESTAMP '1996-01-01' AND interview_date <= TIMESTAMP '1999-12-31' GROUP BY 1")
def flt4_count_reviews(v: Views) -> DataFrame:
    dates = {k: x for k, x in _bounds().items() if k in ("start", "end")}
    return R.count_reviews(v.reviews, **dates)


@query("SELECT id, new_status, coalesce(new_status IN ('preparing','applied','interviewing','offered','rejected'), false) AS valid FROM status_events")
def flt5_check_status(v: Views) -> DataFrame:
    return R.check_status(v.status_events, column="new_status").select("id", "new_status", "valid")


#: Reviews, applications and changes with every fault the rules know, by key.
FAULTY = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS id, l_linenumber - 1 AS round_number, (l_partkey % 7)::INTEGER AS overall_rating, CASE WHEN l_partkey % 5 <> 0 THEN (l_suppkey % 8)::INTEGER END AS stress_level,
 CASE WHEN l_linenumber % 4 > 0 THEN repeat('x', (l_partkey % 4 * 1700)::INTEGER) END AS what_went_well, repeat('y', (l_suppkey % 5 * 1000)::INTEGER) AS next_steps, repeat('z', (l_linenumber % 3 * 1500)::INTEGER) AS mood_notes,
 CASE WHEN l_linenumber % 3 > 0 THEN 19 + l_partkey % 4 END AS n_tags, CASE WHEN l_linenumber % 5 > 0 THEN l_returnflag END AS round_type FROM lineitem"""


@query(f"""SELECT id, concat_ws(',', CASE WHEN overall_rating NOT BETWEEN 1 AND 5 THEN 'overall_rating' END, CASE WHEN stress_level NOT BETWEEN 1 AND 5 THEN 'stress_level' END, CASE WHEN round_number < 1 THEN 'round_number' END,
 CASE WHEN len(what_went_well) > 5000 THEN 'what_went_well' END, CASE WHEN len(next_steps) > 3000 THEN 'next_steps' END, CASE WHEN len(mood_notes) > 2000 THEN 'mood_notes' END,
 CASE WHEN n_tags > 20 THEN 'tags' END, CASE WHEN round_type IS NULL THEN 'round_type' END) AS violations FROM ({FAULTY})""")
def flt6_validate_rows(v: Views) -> DataFrame:
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    rows = v.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"), (n - 1).alias("round_number"), (part % 7).cast("int").alias("overall_rating"), F.when(part % 5 != 0, (supp % 8).cast("int")).alias("stress_level"),
        F.when(n % 4 > 0, F.repeat(F.lit("x"), (part % 4 * 1700).cast("int"))).alias("what_went_well"), F.repeat(F.lit("y"), (supp % 5 * 1000).cast("int")).alias("next_steps"), F.repeat(F.lit("z"), n % 3 * 1500).alias("mood_notes"),
        F.when(n % 3 > 0, F.array_repeat(F.lit("t"), (19 + part % 4).cast("int"))).alias("tags"), F.when(n % 5 > 0, F.col("l_returnflag")).alias("round_type"),
    )
    return R.validate_rows(rows, R.review_rules(rows.columns)).select("id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN len(trim(company)) NOT BETWEEN 1 AND 255 OR company IS NULL THEN 'company_name' END, CASE WHEN len(trim(title)) NOT BETWEEN 1 AND 255 THEN 'job_title' END,
 CASE WHEN len(trim(jd)) NOT BETWEEN 1 AND 50000 THEN 'jd_text' END) AS violations
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE repeat(p_brand, (p_size % 50)::INTEGER) END AS company, '  ' || repeat('t', (p_partkey % 7 * 50)::INTEGER) || ' ' AS title, repeat('jd text ', (p_size * 200)::INTEGER) AS jd FROM part)""")
def flt6_validate_applications(v: Views) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    company = F.when(key % 5 == 0, "   ").when(key % 5 != 1, F.repeat("p_brand", size % 50))
    rows = v.spread(v.table("part").select("p_partkey", "p_brand", "p_size"))
    rows = rows.select(key.alias("id"), company.alias("company_name"), F.concat(F.lit("  "), F.repeat(F.lit("t"), (key % 7 * 50).cast("int")), F.lit(" ")).alias("job_title"), F.repeat(F.lit("jd text "), size * 200).alias("jd_text"))
    return R.validate_rows(rows, R.application_rules(rows.columns)).select("id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT event_id AS id, concat_ws(',', CASE WHEN event_type = 'view' THEN 'new_status' END, CASE WHEN event_id % 3 <> 0 AND (event_id % 30) * 40 > 1000 THEN 'notes' END) AS violations FROM events""")
def flt6_validate_changes(v: Views) -> DataFrame:
    key = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "waiting").when(F.col("event_type") == "click", "offer_pending").otherwise("applied")
    rows = v.table("events").select(key.alias("id"), status.alias("new_status"), F.when(key % 3 != 0, F.repeat(F.lit("n"), (key % 30 * 40).cast("int"))).alias("notes"))
    return R.validate_rows(rows, R.status_rules(rows.columns)).select("id", F.array_join("violations", ",").alias("violations"))


@query("SELECT id, round_type FROM reviews WHERE application_id = (SELECT min(application_id) FROM reviews WHERE user_id = 7) AND user_id = 7")
def flt7_reviews_of_application(v: Views) -> DataFrame:
    first = v.reviews.filter(F.col("user_id") == 7).agg(F.min("application_id")).first()[0]
    return R.reviews_of_application(v.reviews, first, 7).select("id", "round_type")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def flt8_questions_of_job(v: Views) -> DataFrame:
    asked = v.table("conversations").select(F.col("role").alias("job_id"), "conv_id", F.col("turn").alias("position"))
    return R.questions_of_job(asked, "user", ("conv_id",)).select("conv_id", F.col("position").alias("turn"))


# Joins


@query("SELECT id, user_id, version FROM applications JOIN vaults USING (user_id)")
def jon1_jobs_with_vault(v: Views) -> DataFrame:
    return R.jobs_with_vault(v.applications.select("id", "user_id"), v.vaults.select("user_id", "version")).select("id", "user_id", "version")


@query("SELECT id, user_id FROM applications WHERE user_id NOT IN (SELECT user_id FROM vaults)")
def jon1_jobs_without_vault(v: Views) -> DataFrame:
    return R.jobs_without_vault(v.applications.select("id", "user_id"), v.vaults)


@query("SELECT r.id, coalesce(a.company_name, 'Unknown') AS company_name, coalesce(a.job_title, 'Unknown') AS job_title FROM reviews r LEFT JOIN (SELECT * FROM applications WHERE id % 3 <> 0) a ON a.id = r.application_id")
def jon2_reviews_with_job(v: Views) -> DataFrame:
    return R.reviews_with_job(v.reviews, v.applications_with_company.filter("id % 3 <> 0")).select("id", "company_name", "job_title")


@query("SELECT id FROM reviews WHERE application_id IN (SELECT id FROM applications WHERE user_id = 11)")
def jon3_owned_rows(v: Views) -> DataFrame:
    return R.owned_rows(v.reviews, v.applications, 11).select("id")


@query("SELECT id FROM applications a WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.application_id = a.id AND r.round_type = 'R')")
def jon4_jobs_without_questions(v: Views) -> DataFrame:
    return R.jobs_without_questions(v.applications.select("id"), v.reviews.filter("round_type = 'R'"))


@query("""SELECT 'users' AS kind, count(*)::BIGINT AS n FROM users WHERE user_id % 5 <> 0 UNION ALL SELECT 'applications', count(*)::BIGINT FROM applications WHERE user_id % 5 <> 0
UNION ALL SELECT 'reviews', count(*)::BIGINT FROM reviews WHERE user_id % 5 <> 0 UNION ALL SELECT 'vaults', count(*)::BIGINT FROM vaults WHERE user_id % 5 <> 0""")
def jon5_cascade_delete(v: Views) -> DataFrame:
    users = v.users.select("user_id")
    left = R.cascade_delete(users, v.applications.select("id", "user_id"), {"reviews": v.reviews.select("application_id", "user_id"), "vaults": v.vaults.select("user_id")}, users.filter("user_id % 5 = 0"))
    out = None
    for kind, rows in left.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT app_id, openid, user_id, created FROM (
  SELECT DISTINCT event_type AS app_id, user_id::VARCHAR AS openid, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id ELSE md5(event_type || '/' || user_id)[1:16] END AS user_id, user_id % 3 <> 0 AS created FROM events)""")
def jon6_resolve_identities(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_type").alias("app_id"), F.col("user_id").cast("string").alias("openid"), "user_id")
    known = rows.filter("user_id % 3 = 0").select("app_id", "openid", F.concat(F.lit("u"), F.col("openid")).alias("user_id")).distinct()
    return R.resolve_identities(known, rows)


@query("""SELECT a.id, match_score IS NOT NULL AND (nullif(source_vault_version, 0) IS NULL OR nullif(source_vault_version, 0) IS DISTINCT FROM v.version OR source_jd_text IS DISTINCT FROM jd_text) AS stale
FROM applications a LEFT JOIN vaults v USING (user_id)""")
def jon7_stale_analysis(v: Views) -> DataFrame:
    return R.stale_analysis(v.applications, v.vaults).select("id", "stale")


def _drafts(v: Views) -> DataFrame:
    """Drafts of résumés: the reviews of an application stand for them; some differ from the current text, some were written for another description."""
    job, n = F.col("application_id"), F.col("round_number")
    return v.reviews.select(
        job.alias("job_id"), F.col("interview_date").alias("created_at"), "id", (F.col("round_type") != "R").alias("reviewed"), F.coalesce(F.when(n % 5 == 0, n % 4), job % 4).cast("int").alias("source_version"),
        F.when(job % 3 == 0, F.concat(v.content_of(job), F.lit(" edited"))).otherwise(v.content_of(job)).alias("content"), F.when(job % 7 == 0, "an older description").otherwise(v.jd_of(job)).alias("source_jd_text"),
    )


def _versions(v: Views) -> DataFrame:
    """The drafts as stored versions: texts by their digests."""
    drafts = _drafts(v).withColumns({"content_digest": R.digest("content"), "source_jd_digest": R.digest("source_jd_text")})
    return R.number_versions(drafts.drop("content", "source_jd_text"))


VERSIONS = """SELECT application_id AS job_id, id, round_type <> 'R' AS reviewed, (CASE WHEN round_number % 5 = 0 THEN round_number % 4 ELSE application_id % 4 END)::INTEGER AS source_version,
 '# Résumé ' || application_id || CASE WHEN application_id % 3 = 0 THEN ' edited' ELSE '' END AS content, CASE WHEN application_id % 7 = 0 THEN 'an older description' ELSE 'Engineer wanted for team ' || (application_id % 29) || '. Five years of practice.' END AS source_jd_text,
 row_number() OVER (PARTITION BY application_id ORDER BY interview_date, id)::INTEGER AS version FROM reviews"""
LATEST = f"SELECT * FROM ({VERSIONS}) QUALIFY version = max(version) OVER (PARTITION BY job_id)"


@query(f"""SELECT id, user_id, reason IS NULL AS allowed, reason FROM (
 SELECT a.id, a.user_id, CASE WHEN coalesce(resume_text, '') = '' THEN 'no résumé' WHEN NOT coalesce(confirmed, false) THEN 'vault not confirmed' WHEN l.job_id IS NULL THEN 'no version' WHEN NOT coalesce(reviewed, false) THEN 'not reviewed'
   WHEN l.content IS DISTINCT FROM resume_text THEN 'résumé changed' WHEN source_version IS DISTINCT FROM v.version THEN 'vault changed' WHEN l.source_jd_text IS DISTINCT FROM a.jd_text THEN 'description changed' END AS reason
 FROM applications a LEFT JOIN vaults v USING (user_id) LEFT JOIN ({LATEST}) l ON l.job_id = a.id)""")
def jon8_export_gate(v: Views) -> DataFrame:
    return R.export_gate(v.applications, v.vaults, _versions(v))


@query(f"""SELECT d.job_id, d.id, CASE WHEN reviewed THEN CASE WHEN NOT coalesce(confirmed, false) THEN 'vault not confirmed' WHEN source_version IS DISTINCT FROM v.version THEN 'vault changed'
  WHEN d.source_jd_text IS DISTINCT FROM a.jd_text THEN 'description changed' END END AS reason
FROM ({VERSIONS}) d JOIN applications a ON a.id = d.job_id LEFT JOIN vaults v USING (user_id)""")
def jon8_version_gate(v: Views) -> DataFrame:
    return R.version_gate(_drafts(v), v.applications, v.vaults).select("job_id", "id", "reason")


# Histories and pages


@query("SELECT id, job_id, new_status, lag(new_status) OVER (PARTITION BY job_id ORDER BY changed_at, id) AS old_status FROM status_events")
def win1_status_timeline(v: Views) -> DataFrame:
    return R.status_timeline(v.status_events).select("id", "job_id", "new_status", "old_status")


RECENT = "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY interview_date DESC, id)::INTEGER AS place FROM reviews"


@query(f"SELECT * FROM ({RECENT}) WHERE place <= 5")
def win2_recent_reviews(v: Views) -> DataFrame:
    return R.recent_reviews(v.reviews).select("user_id", "id", "place")


@query(f"SELECT job_id, id, version FROM ({VERSIONS})")
def win3_number_versions(v: Views) -> DataFrame:
    return _versions(v).select("job_id", "id", "version")


@query(f"SELECT job_id, id, version, reviewed FROM ({LATEST})")
def win4_latest_version(v: Views) -> DataFrame:
    return R.latest_version(_versions(v)).select("job_id", "id", "version", "reviewed")


MILESTONES = """SELECT job_id, epoch_us(min(CASE WHEN new_status = 'applied' THEN changed_at END)) AS applied_at, epoch_us(min(CASE WHEN new_status = 'interview_scheduled' THEN changed_at END)) AS interview_scheduled_at,
 epoch_us(min(CASE WHEN new_status IN ('offered', 'rejected') THEN changed_at END)) AS final_result_at FROM status_events GROUP BY 1"""


@query(MILESTONES)
def win5_first_milestones(v: Views) -> DataFrame:
    return R.first_milestones(v.status_events).select("job_id", *[F.unix_micros(c).alias(c) for c in R.MILESTONES])


@query("""SELECT u.user_id, j.id AS job_id, (CASE WHEN confirmed IS NULL THEN 0 WHEN NOT confirmed THEN 1 WHEN j.id IS NULL THEN 2 ELSE 3 END)::INTEGER AS stage
FROM users u LEFT JOIN vaults v USING (user_id) LEFT JOIN (SELECT user_id, id FROM applications QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (status = 'preparing') DESC, updated_at DESC, id) = 1) j USING (user_id)""")
def win6_next_step(v: Views) -> DataFrame:
    return R.next_step(v.users, v.vaults, v.applications)


@query("""SELECT user_id AS request_id, string_agg(concat_ws(':', place, company_name, round_number, round_type, strftime(interview_date, '%Y-%m-%d'), coalesce(overall_rating::VARCHAR, '-'), coalesce(technical_rating::VARCHAR, '-'), coalesce(communication_rating::VARCHAR, '-'),
  coalesce(what_went_well, ''), coalesce(what_to_improve, '')), '|' ORDER BY place) AS items, CASE WHEN count(*) < 2 THEN 'needs two reviews' END AS error
FROM (SELECT r.*, company_name, row_number() OVER (PARTITION BY r.user_id ORDER BY interview_date DESC, r.id) AS place FROM reviews r JOIN applications a ON a.id = r.application_id) WHERE place <= 3 GROUP BY 1""")
def win7_review_timeline(v: Views) -> DataFrame:
    rows = R.reviews_with_job(v.reviews, v.applications_with_company)
    chosen = R.recent_reviews(rows, 3)
    requests = chosen.select(F.col("user_id").alias("request_id"), F.col("place").alias("pos"), "id")
    out = R.review_timeline(requests, chosen.drop("user_id", "place"))
    rating = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    shown = F.transform("items", lambda x: F.concat_ws(":", x["pos"], x["company_name"], x["round_number"], x["round_type"], x["date"], *[rating(x[c]) for c in ("overall_rating", "technical_rating", "communication_rating")], x["what_went_well"], x["what_to_improve"]))
    return out.select("request_id", F.array_join(shown, "|").alias("items"), "error")


@query(f"SELECT * FROM ({RECENT}) WHERE place > 5 AND place <= 15")
def top1_page(v: Views) -> DataFrame:
    return R.page(v.reviews, [F.desc("interview_date"), F.col("id")], 5, 10, "user_id").select("user_id", "id", "place")


@query(f"SELECT user_id, channel AS best FROM ({RANKED}) WHERE rank = 1")
def top3_top_channel(v: Views) -> DataFrame:
    return A.channel_ranking(v.applications).filter("rank = 1").select("user_id", F.col("channel").alias("best"))


# Sources and sinks


@query("SELECT 'applications' AS kind, count(*)::BIGINT AS n FROM applications UNION ALL SELECT 'reviews', count(*)::BIGINT FROM reviews UNION ALL SELECT 'users', count(*)::BIGINT FROM users UNION ALL SELECT 'status_events', count(*)::BIGINT FROM status_events")
def src1_read_tables(v: Views) -> DataFrame:
    out = None
    for kind in ("applications", "reviews", "users", "status_events"):
        one = getattr(v, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal::BIGINT AS cents, c_mktsegment FROM (SELECT * REPLACE (floor(c_acctbal * 100 + 0.5) AS c_acctbal) FROM customer)")
def src1_typed_table(v: Views) -> DataFrame:
    """Written as text (one account in three spoilt), read back by the declared schema, the spoilt values taken from the table by key."""
    rows = v.table("customer")
    path = f"{shared_folder(v.spark)}/customer_{uuid.uuid4().hex}"
    spoilt = F.when(F.col("c_custkey") % 3 == 0, "unknown").otherwise(F.col("c_acctbal").cast("string"))
    rows.withColumn("c_acctbal", spoilt).write.option("header", "true").csv(path)
    read = read_typed(v.spark, path, SCHEMAS["customer"], "csv")
    read = read.join(rows.select("c_custkey", F.col("c_acctbal").alias("own")), "c_custkey")
    lost = F.array_contains("bad_columns", "c_acctbal")
    return read.select("c_custkey", "c_name", "c_nationkey", F.floor(F.when(lost, F.col("own")).otherwise(F.col("c_acctbal")) * 100 + 0.5).alias("cents"), "c_mktsegment")


def _database(v: Views) -> dict[str, str]:
    """The database of the setting ``jobtide.database.url``; on a single machine an embedded one in memory, if it is unset."""
    url = v.spark.conf.get("jobtide.database.url", None)
    master = v.spark.sparkContext.master
    if url is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("jobtide.database.url must name a database that all executors reach")
    driver = v.spark.conf.get("jobtide.database.driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver" if url is None else "")
    return {"url": url or "jdbc:derby:memory:jobtide;create=true"} | ({"driver": driver} if driver else {})


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src1_database_table(v: Views) -> DataFrame:
    """Users put into a database and read back by ranges of their key."""
    source, name = _database(v), f"customer_{uuid.uuid4().hex}"
    v.typed("customer").drop("bad_columns").write.format("jdbc").options(**source).option("dbtable", name).option("createTableColumnTypes", "c_name VARCHAR(200), c_mktsegment VARCHAR(100)").save()
    rows = read_database(v.spark, source["url"], name, SCHEMAS["customer"], "c_custkey", 8, source.get("driver"))
    return rows.drop("bad_columns")


VAULT = "user_id long, raw_content string, structured_data string, version int, confirmed boolean"


def _uploads(v: Views, status: str) -> DataFrame:
    rows = v.applications.filter(F.col("status") == status)
    data = F.concat(F.lit('{"skills":["'), "status", F.lit('"]}'))
    return rows.select("user_id", F.col("id").alias("seq"), F.concat("status", F.lit(" draft "), F.col("id").cast("string")).alias("raw_content"), data.alias("structured_data"))


UPLOADS = "SELECT user_id, max_by(status || ' draft ' || id, id) AS c, '{{\"skills\":[\"{0}\"]}}' AS d FROM applications WHERE status = '{0}' GROUP BY 1"


@query(f"""SELECT coalesce(v.user_id, a.user_id, b.user_id) AS user_id, coalesce(b.c, a.c, raw_content) AS raw_content, coalesce(b.d, a.d) AS structured_data,
 (coalesce(version, 0) + CASE WHEN a.c IS NULL THEN 0 ELSE 1 END + CASE WHEN b.c IS NULL THEN 0 ELSE 1 END)::INTEGER AS version, a.c IS NULL AND b.c IS NULL AND confirmed AS confirmed
FROM vaults v FULL JOIN ({UPLOADS.format('preparing')}) a ON a.user_id = v.user_id FULL JOIN ({UPLOADS.format('rejected')}) b ON b.user_id = coalesce(v.user_id, a.user_id)""")
def src5_upsert_vault(v: Views) -> DataFrame:
    """A stored table of vaults, two batches of uploads put into it, the second one twice, and the table read back."""
    table = KeyedTable(v.spark, f"{shared_folder(v.spark)}/vaults_{uuid.uuid4().hex}", "user_id", VAULT, buckets=16)
    table.upsert(v.vaults, 0)
    for batch, status in ((1, "preparing"), (2, "rejected"), (2, "rejected")):
        table.upsert(R.last_incoming(_uploads(v, status)), batch, R.vault_change)
    return table.read()


@query("""SELECT user_id, count(*)::BIGINT AS reviews, avg(overall_rating) AS mean_overall_rating, avg(technical_rating) AS mean_technical_rating, avg(communication_rating) AS mean_communication_rating FROM reviews GROUP BY 1""")
def src6_write_user_summary(v: Views) -> DataFrame:
    """One row a user, made from a part of the reviews, replaced by those of all reviews, and read back."""
    stats = A.review_stats(v.reviews)
    table = KeyedTable(v.spark, f"{shared_folder(v.spark)}/user_summary_{uuid.uuid4().hex}", "user_id", stats.schema, buckets=16)
    for batch, rows in enumerate((A.review_stats(v.reviews.filter("round_number < 3")), stats)):
        R.write_user_summary(table, rows, batch)
    return table.read()


def flagship(v: Views) -> DataFrame:
    """Weekly trend of every user beside the user's summary."""
    summary = A.user_summary(v.users, v.applications_with_company, v.reviews).select("user_id", F.col("applications").alias("total_applications"), F.col("interview_rate").alias("total_interview_rate"), "avg_days_to_response")
    trend = A.weekly_trend(v.applications, AS_OF, "3m")
    return trend.join(summary, "user_id").withColumn("share_of_user", rate("applications", "total_applications", 4, 0))
