"""Filters, joins, gates, histories and versions of application records."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.operators.jd import WHITE
from jobtide.operators.resume import let
from jobtide.sources.tables import KeyedTable

SIMPLE_STATUSES = ("preparing", "applied", "interviewing", "offered", "rejected")
HISTORY_STATUSES = ("preparing", "applied", "resume_screening", "interview_scheduled", "interviewing", "offer_pending", "offered", "rejected", "withdrawn")
MILESTONES = {"applied_at": ("applied",), "interview_scheduled_at": ("interview_scheduled",), "final_result_at": ("offered", "rejected")}


# Filters


def user_jobs(applications: DataFrame, user_id) -> DataFrame:
    """A user's applications, newest change first."""
    return applications.filter(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "id")


def search_jobs(applications: DataFrame, needle: str = "", status: str | None = None, blank: str = " ") -> DataFrame:
    """Status equality and a substring of company and title, without regard to case."""
    rows = applications if status is None else applications.filter(F.col("status") == status)
    return rows.filter(F.contains(F.lower(F.concat_ws(blank, "company_name", "job_title")), F.lit(needle.lower())))


def filter_reviews(reviews: DataFrame, start=None, end=None, round_type: str | None = None, least=None, most=None, tags: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive bounds; a bound on the rating drops null ratings; all tags must be present."""
    rows = reviews
    for cond, value in ((F.col("interview_date") >= F.lit(start), start), (F.col("interview_date") <= F.lit(end), end), (F.col("round_type") == F.lit(round_type), round_type), (F.col("overall_rating") >= F.lit(least), least), (F.col("overall_rating") <= F.lit(most), most)):
        rows = rows if value is None else rows.filter(cond)
    if tags:
        rows = rows.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    return rows


def count_reviews(reviews: DataFrame, start=None, end=None, round_type: str | None = None) -> DataFrame:
    """Reviews of each user by date and round; ratings and tags bound a page, not the count beside it."""
    return filter_reviews(reviews, start, end, round_type).groupBy("user_id").agg(F.count("*").alias("n"))


def reviews_of_application(reviews: DataFrame, application_id, user_id) -> DataFrame:
    """A user's reviews of one application, newest first."""
    return reviews.filter((F.col("application_id") == application_id) & (F.col("user_id") == user_id)).orderBy(F.desc("interview_date"), "id")


def questions_of_job(questions: DataFrame, job_id, ties: tuple[str, ...] = ()) -> DataFrame:
    """Questions of one job by position."""
    return questions.filter(F.col("job_id") == job_id).orderBy("position", *ties)


def page(rows: DataFrame, by: list[Column], skip: int = 0, limit: int = 20, within: str | None = None) -> DataFrame:
    """One page of the ordered rows; with ``within``, one page of each group."""
    if within is None:
        return rows.orderBy(*by).offset(skip).limit(limit)
    place = F.row_number().over(W.partitionBy(within).orderBy(*by))
    return rows.withColumn("place", place).filter((F.col("place") > skip) & (F.col("place") <= skip + limit))


def check_status(rows: DataFrame, allowed: tuple[str, ...] = SIMPLE_STATUSES, column: str = "status") -> DataFrame:
    """Marks rows with an allowed status."""
    return rows.withColumn("valid", F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def _within(column: str, least: int, most: int | None = None, null: bool = True) -> Column:
    """A number in its bounds; null passes where the field may be absent."""
    ok = (F.col(column) >= least) if most is None else F.col(column).between(least, most)
    return F.coalesce(ok, F.lit(null))


#: White space of Unicode; the four separators of ASCII, which ``WHITE`` has too, count as characters.
BLANKS = "".join(c for c in WHITE if not "\x1c" <= c <= "\x1f")


def _bare(text: Column) -> Column:
    """Without blanks at both ends; a long text is gone through for that only if another one than the space ends it."""

    def end(x: Column) -> Column:
        other = reduce(or_, (F.endswith(x, F.lit(c)) for c in BLANKS if c != " "))
        return F.when(other, F.rtrim(x, F.lit(BLANKS))).otherwise(x)

    return let(F.rtrim(F.ltrim(text, F.lit(BLANKS))), end)


def _short(column: str, most: int, least: int = 0, null: bool = True, trim: bool = False) -> Column:
    """A length in its bounds. A character has one to four bytes: characters are counted where the bytes leave it open."""

    def fits(x: Column) -> Column:
        size, n = F.octet_length(x), F.length(x)
        return ((size >= 4 * least) | (n >= least)) & ((size <= most) | ((size <= 4 * most) & (n <= most)))

    return F.coalesce(let(_bare(F.col(column)), fits) if trim else fits(F.col(column)), F.lit(null))


RATINGS = ("overall_rating", "technical_rating", "communication_rating", "problem_solving_rating", "cultural_fit_rating", "confidence_level", "stress_level")
TEXTS = {"what_went_well": 5000, "what_to_improve": 5000, "key_takeaways": 3000, "next_steps": 3000, "mood_notes": 2000}


def review_rules(columns: list[str]) -> dict[str, Column]:
    """Constraints of a review for those of its columns that are there; the code is the column's name.

    Ratings and levels 1 to 5, round and interviewers from 1, texts up to 5000, 3000 or 2000 characters, at most 20 tags;
    round type, date and application must be there.
    """
    rules = {c: _within(c, 1, 5) for c in RATINGS} | {c: _within(c, 1, null=False) for c in ("round_number", "interviewer_count")} | {c: _short(c, most) for c, most in TEXTS.items()}
    rules |= {"tags": F.coalesce(F.size(F.col("tags")) <= 20, F.lit(True))} | {c: F.col(c).isNotNull() for c in ("application_id", "round_type", "interview_date")}
    return {c: r for c, r in rules.items() if c in columns}


def application_rules(columns: list[str]) -> dict[str, Column]:
    """Company and title of 1 to 255 characters and a description of 1 to 50,000, blanks at the ends not counted."""
    rules = {c: _short(c, most, 1, False, True) for c, most in (("company_name", 255), ("job_title", 255), ("jd_text", 50_000))}
    return {c: r for c, r in rules.items() if c in columns}


def status_rules(columns: list[str]) -> dict[str, Column]:
    """One of the history's statuses; notes of at most 1000 characters."""
    rules = {"new_status": F.col("new_status").isin(*HISTORY_STATUSES), "notes": _short("notes", 1000)}
    return {c: r for c, r in rules.items() if c in columns}


def validate_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``violations``: the codes of the rules a row breaks (a rule that is null is broken)."""
    marks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*marks)))


# Joins


def jobs_with_vault(applications: DataFrame, vaults: DataFrame) -> DataFrame:
    return applications.join(vaults, "user_id")


def jobs_without_vault(applications: DataFrame, vaults: DataFrame) -> DataFrame:
    return applications.join(vaults.select("user_id"), "user_id", "left_anti")


def reviews_with_job(reviews: DataFrame, applications: DataFrame) -> DataFrame:
    """Review with company and title of its application, ``Unknown`` where there is none."""
    jobs = applications.select(F.col("id").alias("application_id"), "company_name", "job_title")
    rows = reviews.join(jobs, "application_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("company_name", "job_title")})


def owned_rows(children: DataFrame, applications: DataFrame, user_id) -> DataFrame:
    """Child rows whose parent belongs to the user."""
    return children.join(applications.filter(F.col("user_id") == user_id).select(F.col("id").alias("application_id")), "application_id", "left_semi")


def jobs_without_questions(applications: DataFrame, questions: DataFrame) -> DataFrame:
    return applications.join(questions.select(F.col("application_id").alias("id")), "id", "left_anti")


def cascade_delete(users: DataFrame, applications: DataFrame, children: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted users and what hangs on them. ``deleted``: user_id."""
    kept_apps = applications.join(deleted, "user_id", "left_anti")
    out = {"users": users.join(deleted, "user_id", "left_anti"), "applications": kept_apps}
    gone = applications.join(deleted, "user_id", "left_semi").select(F.col("id").alias("application_id"))
    for name, rows in children.items():
        if "application_id" in rows.columns:
            rows = rows.join(gone, "application_id", "left_anti")
        if "user_id" in rows.columns:
            rows = rows.join(deleted, "user_id", "left_anti")
        out[name] = rows
    return out


def resolve_identities(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """All identities with a user id: a known mapping wins, a new one gets an id from its key."""
    fresh = incoming.select("app_id", "openid").dropDuplicates().join(known, ["app_id", "openid"], "left_anti")
    fresh = fresh.withColumn("user_id", F.substring(F.md5(F.concat_ws("/", "app_id", "openid")), 1, 16))
    return known.select("app_id", "openid", F.col("user_id").cast("string"), F.lit(False).alias("created")).unionByName(fresh.withColumn("created", F.lit(True)))


def digest(text: str | Column) -> Column:
    """Name of a text by its content; null stays null. Versions carry it, so that texts are compared without being joined."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def stale_analysis(applications: DataFrame, vaults: DataFrame) -> DataFrame:
    """``stale``: there is an analysis, and its vault version is missing, 0 or not the current one, or its description isn't the job's.

    The description at the time of the analysis comes as ``source_jd_digest``.
    """
    rows = applications.withColumn("_jd", ~F.col("source_jd_digest").eqNullSafe(digest("jd_text"))).join(vaults.select("user_id", F.col("version").alias("vault_version")), "user_id", "left")
    source = F.nullif(F.col("source_vault_version"), F.lit(0))
    return rows.withColumn("stale", F.col("match_score").isNotNull() & (source.isNull() | ~source.eqNullSafe(F.col("vault_version")) | F.col("_jd"))).drop("_jd")


def _vault_reason(version: Column) -> list[tuple[Column, str]]:
    """What a changed vault has against a version made from ``version``."""
    return [(~F.coalesce("confirmed", F.lit(False)), "vault not confirmed"), (~version.eqNullSafe(F.col("version")), "vault changed")]


def _first(reasons: list[tuple[Column, str]]) -> Column:
    out = F.when(*reasons[0])
    for cond, text in reasons[1:]:
        out = out.when(cond, text)
    return out


def export_gate(applications: DataFrame, vaults: DataFrame, versions: DataFrame) -> DataFrame:
    """Whether each job's résumé may be exported, and the first reason against it.

    ``applications``: id, user_id, resume_text (the current one), jd_text; ``versions``: job_id, version, reviewed,
    source_version, content_digest, source_jd_digest. Refused are a résumé that isn't there, a vault that isn't confirmed,
    a last version that is absent or not reviewed, and a text, vault or description that has changed since that version.
    """
    last = latest_version(versions.select("job_id", "version", "reviewed", "source_version", "content_digest", "source_jd_digest")).drop("version")
    rows = applications.select("id", "user_id", (F.coalesce("resume_text", F.lit("")) == "").alias("_none"), digest("resume_text").alias("_text"), digest("jd_text").alias("_jd"))
    rows = rows.join(vaults.select("user_id", "version", "confirmed"), "user_id", "left").join(last, F.col("id") == F.col("job_id"), "left")
    unconfirmed, changed = _vault_reason(F.col("source_version"))
    reason = _first([
        (F.col("_none"), "no résumé"), unconfirmed, (F.col("job_id").isNull(), "no version"), (~F.coalesce("reviewed", F.lit(False)), "not reviewed"),
        (~F.col("content_digest").eqNullSafe(F.col("_text")), "résumé changed"), changed, (~F.col("source_jd_digest").eqNullSafe(F.col("_jd")), "description changed"),
    ])
    return rows.select("id", "user_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def version_gate(drafts: DataFrame, applications: DataFrame, vaults: DataFrame) -> DataFrame:
    """Drafts (job_id, id, content, reviewed, source_version, source_jd_text) with the reason against saving them; only reviewed ones can be refused.

    Contents become digests first: of the texts nothing is joined.
    """
    rows = drafts.select("job_id", "id", "reviewed", "source_version", digest("content").alias("content_digest"), digest("source_jd_text").alias("source_jd_digest"))
    jobs = applications.select(F.col("id").alias("job_id"), "user_id", digest("jd_text").alias("_jd"))
    rows = rows.join(jobs, "job_id").join(vaults.select("user_id", "version", "confirmed"), "user_id", "left")
    reason = _first([*_vault_reason(F.col("source_version")), (~F.col("source_jd_digest").eqNullSafe(F.col("_jd")), "description changed")])
    return rows.select("job_id", "id", "reviewed", "source_version", "content_digest", "source_jd_digest", F.when(F.coalesce("reviewed", F.lit(False)), reason).alias("reason"))


# Histories


def status_timeline(events: DataFrame) -> DataFrame:
    """Each change with the status before it."""
    order = W.partitionBy("job_id").orderBy("changed_at", "id")
    return events.withColumn("old_status", F.lag("new_status").over(order))


def recent_reviews(reviews: DataFrame, k: int = 5) -> DataFrame:
    """The latest ``k`` reviews of each user."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("interview_date"), "id"))
    return reviews.withColumn("place", place).filter(F.col("place") <= k)


def number_versions(contents: DataFrame) -> DataFrame:
    """Versions of each job numbered in order of creation."""
    return contents.withColumn("version", F.row_number().over(W.partitionBy("job_id").orderBy("created_at", "id")))


def latest_version(versions: DataFrame) -> DataFrame:
    """The last version of each job."""
    own = [c for c in versions.columns if c != "job_id"]
    rows = versions.groupBy("job_id").agg(F.max_by(F.struct(*own), "version").alias("x"))
    return rows.select("job_id", *[F.col(f"x.{c}").alias(c) for c in own])


def first_milestones(events: DataFrame) -> DataFrame:
    """First time of each milestone of a job; later changes don't move it."""
    return events.groupBy("job_id").agg(*[F.min(F.when(F.col("new_status").isin(*s), F.col("changed_at"))).alias(name) for name, s in MILESTONES.items()])


def next_step(users: DataFrame, vaults: DataFrame, applications: DataFrame) -> DataFrame:
    """Per user the job to go on with (newest in preparation, else newest) and the stage 0 to 3 of the work."""
    key = F.struct((F.col("status") == "preparing").alias("p"), F.col("updated_at").alias("u"), (-F.col("id")).alias("i"))
    job = applications.groupBy("user_id").agg(F.max_by("id", key).alias("job_id"))
    rows = users.select("user_id").join(vaults.select("user_id", "confirmed"), "user_id", "left").join(job, "user_id", "left")
    stage = F.when(F.col("confirmed").isNull(), 0).when(~F.col("confirmed"), 1).when(F.col("job_id").isNull(), 2).otherwise(3)
    return rows.select("user_id", "job_id", stage.alias("stage"))


def review_timeline(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews chosen by each request (request_id, pos, id) as one ordered list; fewer than two is an error row.

    A date that isn't there is ``Unknown``, absent texts are empty.
    """
    date = F.coalesce(F.date_format("interview_date", "yyyy-MM-dd"), F.lit("Unknown")).alias("date")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("what_went_well", "what_to_improve")]
    item = F.struct("pos", "company_name", "round_number", "round_type", date, "overall_rating", "technical_rating", "communication_rating", *texts)
    rows = requests.join(reviews, "id").groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.withColumn("error", F.when(F.size("items") < 2, F.lit("needs two reviews")))


# Writes


def upsert_vault(vaults: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vaults after the last incoming content of each user: version + 1, or version 1 if new.

    This is the rule alone; ``vault_change`` applies it to the touched part of a stored table.
    """
    own = [c for c in ("raw_content", "structured_data") if c in incoming.columns]
    last = incoming.groupBy("user_id").agg(F.max_by(F.struct(*own), F.struct("seq", "raw_content")).alias("new"))
    rows = vaults.join(last, "user_id", "full_outer")
    version = F.when(F.col("new").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    kept = [F.when(F.col("new").isNull(), F.col(c) if c in vaults.columns else F.lit(None)).otherwise(F.col(f"new.{c}")).alias(c) for c in own]
    return rows.select("user_id", *kept, version.alias("version"))


def last_incoming(incoming: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("seq", "raw_content")) -> DataFrame:
    """One row a key: the last by ``order``."""
    own = [c for c in incoming.columns if c != key]
    rows = incoming.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("x"))
    return rows.select(key, *[F.col(f"x.{c}").alias(c) for c in own])


def vault_change(old: DataFrame, new: DataFrame) -> dict[str, Column]:
    """For ``KeyedTable.upsert``: new content, version + 1 (1 for a new user); the confirmation goes with the content it was given for."""
    return {"raw_content": new["raw_content"], "structured_data": new["structured_data"], "version": (F.coalesce(old["version"], F.lit(0)) + 1).cast("int"), "confirmed": F.lit(False)}


def write_user_summary(table: KeyedTable, summary: DataFrame, batch: int) -> list[int]:
    """Create or replace one row a user; the buckets of users who aren't in ``summary`` stay as they are."""
    return table.upsert(summary, batch)
