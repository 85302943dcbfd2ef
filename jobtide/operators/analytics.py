"""Application analytics per user: totals, times, channels, trends, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.scalar import RANGE_DAYS, days_between, falsy_text, rate, round_n, truthy

INTERVIEW, OFFER = ("interviewing", "offered", "rejected"), "offered"
WEEK = 7 * 86_400_000_000


def _interview() -> Column:
    return F.col("status").isin(*INTERVIEW)


def _counts() -> list[Column]:
    return [
        F.count("*").alias("applications"),
        F.count_if(_interview()).alias("interviews"),
        F.count_if(F.col("status") == OFFER).alias("offers"),
    ]


def _mean_days(start: str, end: str) -> Column:
    days = days_between(start, end)
    return F.avg(F.when(days >= 0, days))


def application_totals(applications: DataFrame) -> DataFrame:
    """Per user: counts and unrounded rates, and mean whole days to first response and to the result.

    One shuffle by user, partially aggregated.
    """
    out = applications.groupBy("user_id").agg(
        *_counts(), F.count_if(F.col("status") == "rejected").alias("rejections"),
        _mean_days("applied_at", "first_response_at").alias("avg_days_to_response"), _mean_days("applied_at", "final_result_at").alias("avg_days_to_result"),
    )
    return out.select(
        "*", rate("interviews", "applications").alias("interview_rate"), rate("offers", "interviews").alias("offer_rate"), rate("offers", "applications").alias("success_rate")
    )


def channel_effectiveness(applications: DataFrame) -> DataFrame:
    """Per user and channel: share of applications with an interview, 4 digits."""
    rows = applications.groupBy("user_id", falsy_text("channel").alias("channel")).agg(*_counts())
    return rows.select("user_id", "channel", rate("interviews", "applications", 4).alias("effectiveness"))


def company_size_distribution(applications: DataFrame) -> DataFrame:
    """Per user and company size: count."""
    return applications.groupBy("user_id", falsy_text("company_size").alias("company_size")).agg(F.count("*").alias("n"))


def rating_trend(reviews: DataFrame) -> DataFrame:
    """Per user and month: mean overall rating over rated reviews, 2 digits."""
    rated = reviews.filter(truthy("overall_rating").isNotNull())
    rows = rated.groupBy("user_id", F.date_format("interview_date", "yyyy-MM").alias("month")).agg(F.sum("overall_rating").alias("s"), F.count("*").alias("n"))
    return rows.select("user_id", "month", rate("s", "n", 2).alias("mean_rating"))


def _totals_of(parts: Column, key: str, *sums: str) -> Column:
    """The sums of some parts (structs) by a key of theirs: array of struct(key, sums), by key."""

    def one(k: Column) -> Column:
        own = F.filter(parts, lambda x: x[key] == k)
        total = lambda c: F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x[c])
        return F.struct(k.alias("key"), *[total(c).alias(c) for c in sums])

    return F.transform(F.array_sort(F.array_distinct(F.transform(parts, lambda x: x[key]))), one)


def user_summary(users: DataFrame, applications: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per user with all of the above; users without applications get zeros and null rates.

    ``rating_trend`` is null for users without reviews and an empty map where none is rated. Applications and reviews are
    read once each: counted by channel and size (by month), then put together by user, who has few of either.
    """
    days = {"response": days_between("applied_at", "first_response_at"), "result": days_between("applied_at", "final_result_at")}
    waits = [f(F.when(d >= 0, d)).alias(f"{name}_{k}") for name, d in days.items() for k, f in (("s", F.sum), ("n", F.count))]
    by_kind = applications.groupBy("user_id", falsy_text("channel").alias("channel"), falsy_text("company_size").alias("company_size")).agg(*_counts(), F.count_if(F.col("status") == "rejected").alias("rejections"), *waits)
    sums = ("applications", "interviews", "offers", "rejections", "response_s", "response_n", "result_s", "result_n")
    totals = by_kind.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in sums], F.collect_list(F.struct("channel", "company_size", "applications", "interviews")).alias("parts"))
    channels = F.transform(_totals_of(F.col("parts"), "channel", "applications", "interviews"), lambda x: F.struct(x["key"], rate(x["interviews"], x["applications"], 4)))
    sizes = F.transform(_totals_of(F.col("parts"), "company_size", "applications"), lambda x: F.struct(x["key"], x["applications"]))
    rated = truthy("overall_rating")
    months = reviews.groupBy("user_id", F.when(rated.isNotNull(), F.date_format("interview_date", "yyyy-MM")).alias("month")).agg(F.sum(rated).alias("s"), F.count("*").alias("n"))
    trend = months.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", rate("s", "n", 2))))))).alias("rating_trend"))
    out = users.select("user_id").join(totals, "user_id", "left").join(trend, "user_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("applications", "interviews", "offers", "rejections")]
    return out.select(
        "user_id", *zero, rate("interviews", "applications").alias("interview_rate"), rate("offers", "interviews").alias("offer_rate"), rate("offers", "applications").alias("success_rate"),
        rate("response_s", "response_n").alias("avg_days_to_response"), rate("result_s", "result_n").alias("avg_days_to_result"),
        F.map_from_entries(channels).alias("channels"), F.map_from_entries(sizes).alias("company_sizes"), "rating_trend",
    )


def funnel(applications: DataFrame) -> DataFrame:
    """Per user three stages with count and percentage of all applications, and the three rates (0 where empty)."""
    rows = applications.groupBy("user_id").agg(*_counts())
    rates = [rate("interviews", "applications", 4, 0).alias("interview_rate"), rate("offers", "interviews", 4, 0).alias("offer_rate"), rate("offers", "applications", 4, 0).alias("overall_rate")]
    stage = lambda name, n: F.struct(F.lit(name).alias("stage"), F.col(n).alias("count"), round_n(F.col(n) / F.col("applications") * 100, 2).alias("percentage"))
    stages = F.array(stage("投递", "applications"), stage("面试", "interviews"), stage("Offer", "offers"))
    return rows.select("user_id", *rates, F.explode(stages).alias("s")).select("user_id", "s.*", "interview_rate", "offer_rate", "overall_rate")


def weekly_trend(applications: DataFrame, as_of: str, time_range: str = "3m") -> DataFrame:
    """Per user and 7-day bucket from the start of the range: counts and rates, empty buckets kept.

    Applications are aggregated first; the spine has at most 53 buckets a user.
    """
    days = RANGE_DAYS[time_range]
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(days))
    bucket = F.floor((F.unix_micros("created_at") - F.unix_micros(start)) / F.lit(WEEK)).cast("int")
    n = days // 7 + 1
    inside = applications.withColumn("bucket", bucket).filter((F.col("created_at") >= start) & (F.col("bucket") < n))
    counts = inside.groupBy("user_id", "bucket").agg(*_counts())
    spine = applications.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    rows = spine.join(counts, ["user_id", "bucket"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("applications", "interviews", "offers")]
    rows = rows.select("user_id", "bucket", F.date_format(start + F.col("bucket") * F.expr("interval 7 days"), "yyyy-MM-dd").alias("date"), *zero)
    return rows.select("*", rate("interviews", "applications", 4, 0).alias("interview_rate"), rate("offers", "interviews", 4, 0).alias("offer_rate"))


def trend_direction(trend: DataFrame, time_range: str) -> DataFrame:
    """Per user: mean interview rate of the last four buckets with applications against the first four."""
    last = RANGE_DAYS[time_range] // 7
    mean = lambda cond: F.avg(F.when(cond & (F.col("applications") > 0), F.col("interview_rate")))
    rows = trend.groupBy("user_id").agg(mean(F.col("bucket") > last - 4).alias("recent"), mean(F.col("bucket") < 4).alias("early"))
    direction = F.when(F.col("recent") > F.col("early") * 1.1, "improving").when(F.col("recent") < F.col("early") * 0.9, "declining").otherwise("stable")
    return rows.select("user_id", direction.alias("direction"))


def channel_ranking(applications: DataFrame) -> DataFrame:
    """Per user and channel counts, conversion and rank by conversion (ties by name); the best one is marked."""
    rows = applications.groupBy("user_id", falsy_text("channel").alias("channel")).agg(*_counts())
    rows = rows.withColumn("conversion_rate", rate("interviews", "applications", 4))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("conversion_rate"), "channel")))
    advice = F.when((F.col("rank") == 1) & (F.col("channel") != "unknown"), F.concat(F.lit("Use more: "), "channel"))
    return rows.withColumn("recommendation", advice)


def period_insight(applications: DataFrame, reviews: DataFrame, as_of: str, time_range: str = "3m") -> DataFrame:
    """Per user inside the range: totals, rates, mean rating over truthy ratings, number of reviews."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(RANGE_DAYS[time_range]))
    apps = applications.filter(F.col("created_at") >= start).groupBy("user_id").agg(*_counts())
    revs = reviews.filter(F.col("interview_date") >= start).groupBy("user_id").agg(F.count("*").alias("reviews"), F.sum(truthy("overall_rating")).alias("s"), F.count(truthy("overall_rating")).alias("n"))
    out = apps.join(revs, "user_id", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("applications", "interviews", "offers", "reviews")]
    return out.select("user_id", *zero, rate("s", "n", 2).alias("mean_rating")).select("*", rate("interviews", "applications", 4, 0).alias("interview_rate"), rate("offers", "interviews", 4, 0).alias("offer_rate"))


def review_stats(reviews: DataFrame, ratings: tuple[str, ...] = ("overall_rating", "technical_rating", "communication_rating")) -> DataFrame:
    """Per user: number of reviews and means over truthy ratings."""
    return reviews.groupBy("user_id").agg(F.count("*").alias("reviews"), *[F.avg(truthy(r)).alias(f"mean_{r}") for r in ratings])


def value_histogram(rows: DataFrame, value: str) -> DataFrame:
    """Per user and value: count; null and 0 are left out."""
    return rows.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != "0")).groupBy("user_id", value).agg(F.count("*").alias("n"))


def tag_frequency(reviews: DataFrame) -> DataFrame:
    """Per user and tag: count."""
    return reviews.select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag").agg(F.count("*").alias("n"))


def status_snapshot(applications: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Per user and each listed status (absent ones too): count and share, with the numbers of applications, analysed ones and those with a résumé."""
    n = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    rows = applications.groupBy("user_id").agg(F.count("*").alias("total"), F.count("match_score").alias("analysed"), F.count(F.nullif("resume_text", F.lit(""))).alias("with_resume"), *n)
    own = ("user_id", "total", "analysed", "with_resume")
    items = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in statuses])
    rows = rows.select(*own, F.explode(items).alias("x")).select(*own, "x.status", "x.n")
    return rows.withColumn("share", rate("n", "total", 4))


def overview(users: DataFrame, applications: DataFrame) -> DataFrame:
    """Per user: totals and rounded rates, zeros when empty."""
    rows = users.select("user_id").join(applications.groupBy("user_id").agg(*_counts()), "user_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("applications", "interviews", "offers")]
    return rows.select("user_id", *zero).select(
        "*", rate("interviews", "applications", 4, 0).alias("interview_rate"), rate("offers", "interviews", 4, 0).alias("offer_rate"),
        rate("offers", "applications", 4, 0).alias("overall_rate"), F.lit("stable").alias("recent_trend"),
    )


def usage_account(operations: DataFrame, limit: int = 3) -> DataFrame:
    """Per owner: succeeded, running, remaining of the limit."""
    rows = operations.groupBy("owner").agg(F.count_if(F.col("state") == "succeeded").alias("used"), F.count_if(F.col("state") == "running").alias("reserved"))
    return rows.withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used") - F.col("reserved")))
