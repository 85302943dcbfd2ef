"""Views of the job-search tables over the driver's tables, once for Spark and once in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.sources.typed import SCHEMAS, read_typed

#: Postings of a user.
OWN = 5
STATUSES = ("preparing", "applied", "interviewing", "offered", "rejected")


class Views:
    """Each attribute reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def typed(self, name: str) -> DataFrame:
        """A table by its declared schema."""
        return read_typed(self.spark, f"{self.dir}/{name}.parquet", SCHEMAS[name])

    @property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))

    @property
    def applications(self) -> DataFrame:
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        status = (
            F.when(F.col("o_orderstatus") == "O", "interviewing").when(F.col("o_orderstatus") == "F", "offered")
            .when(key % 3 == 0, "rejected").when(key % 3 == 1, "applied").otherwise("preparing")
        )
        priority = F.col("o_orderpriority")
        orders = self.table("orders").select(
            key.alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
            F.when(priority == "5-LOW", F.lit(None)).when(priority == "4-NOT SPECIFIED", F.lit("")).otherwise(priority).alias("channel"),
            F.concat(F.lit("Engineer "), (key % 7).cast("string")).alias("job_title"),
            F.when(key % 11 != 0, (key % 101).cast("int")).alias("match_score"),
            day.alias("created_at"), day.alias("applied_at"), (day + F.make_dt_interval((key % 30).cast("int"))).alias("updated_at"),
            F.when(key % 7 != 0, day + F.make_dt_interval((key % 40 - 3).cast("int"))).alias("first_response_at"),
            F.when(key % 5 != 0, day + F.make_dt_interval((key % 60 - 2).cast("int"))).alias("final_result_at"),
            (key % 4).cast("int").alias("source_vault_version"), self.jd_of(key).alias("jd_text"), F.sha2(F.when(key % 13 != 0, self.jd_of(key)).otherwise("an older description"), 256).alias("source_jd_digest"),
            F.when(key % 17 == 0, "").when(key % 17 != 1, self.content_of(key)).alias("resume_text"),
        )
        return orders

    @staticmethod
    def jd_of(key: Column) -> Column:
        return F.concat(F.lit("Engineer wanted for team "), (key % 29).cast("string"), F.lit(". Five years of practice."))

    @staticmethod
    def content_of(key: Column) -> Column:
        return F.concat(F.lit("# Résumé "), key.cast("string"))

    @property
    def applications_with_company(self) -> DataFrame:
        companies = self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("company_size"))
        return self.applications.join(companies, "user_id")

    @property
    def reviews(self) -> DataFrame:
        owners = self.table("orders").select(F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("user_id"))
        rating = lambda x: F.nullif(F.floor(F.col(x)).cast("int") % 6, F.lit(0))
        rows = self.table("lineitem").select(
            F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("round_number"), F.col("l_returnflag").alias("round_type"),
            F.col("l_shipdate").cast("timestamp").alias("interview_date"), rating("l_quantity").alias("overall_rating"), rating("l_extendedprice").alias("technical_rating"), rating("l_partkey").alias("communication_rating"),
            F.array("l_returnflag", "l_linestatus").alias("tags"), F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("went well: "), "l_linestatus")).alias("what_went_well"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("improve "), "l_returnflag")).alias("what_to_improve"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyyMMdd")).alias("id"),
        )
        return rows.join(owners, "application_id")

    @property
    def vaults(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").filter(key % 10 != 0).select(
            key.alias("user_id"), (key % 4).cast("int").alias("version"), F.concat(F.lit("résumé of "), F.col("c_name")).alias("raw_content"), (key % 3 != 0).alias("confirmed")
        )

    @staticmethod
    def status_of(events: DataFrame) -> DataFrame:
        """Status events, batch or stream, from the driver's events."""
        kind = F.col("event_type")
        status = (
            F.when(kind == "signup", "applied").when(kind == "view", "resume_screening").when(kind == "click", "interview_scheduled").when(kind == "purchase", "offered").otherwise("rejected")
        )
        return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("changed_at"), status.alias("new_status"))

    @property
    def status_events(self) -> DataFrame:
        return self.status_of(self.table("events"))

    @staticmethod
    def requests_of(events: DataFrame) -> DataFrame:
        """Requests, batch or stream, from the driver's events."""
        kind = F.col("event_type")
        return events.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("path"), F.col("value").alias("seconds"), F.when(kind == "error", 500).otherwise(200).alias("code"))

    @property
    def request_log(self) -> DataFrame:
        return self.requests_of(self.table("events"))

    @property
    def resumes(self) -> DataFrame:
        """One résumé a document; each goes with one posting, and belongs to that posting's user."""
        rows = self.table("documents").select("doc_id", F.floor(F.col("doc_id") % self.postings / OWN).alias("user_id"), (F.col("doc_id") % self.postings).alias("posting"), "text")
        return self.spread(rows)

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows of a table with less splits than twice the cores are dealt to all cores: small files have few row groups, and texts are dear to work on. Larger tables stay as they are read."""
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows

    @property
    def jds(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("job_id"), F.floor(F.col("item_id") / OWN).alias("user_id"), "text")

    @cached_property
    def postings(self) -> int:
        """Number of postings: documents are dealt to all of them."""
        return max(1, self.table("benchmark").count())


#: The same views in SQL.
SQL = """
WITH users AS (SELECT c_custkey AS user_id, c_name AS name FROM customer),
applications AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'O' THEN 'interviewing' WHEN o_orderstatus = 'F' THEN 'offered' WHEN o_orderkey % 3 = 0 THEN 'rejected'
              WHEN o_orderkey % 3 = 1 THEN 'applied' ELSE 'preparing' END AS status,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS channel,
         'Engineer ' || (o_orderkey % 7) AS job_title, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 101)::INTEGER END AS match_score,
         o_orderdate AS created_at, o_orderdate AS applied_at, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 30) AS updated_at,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 40 - 3) END AS first_response_at,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60 - 2) END AS final_result_at,
         (o_orderkey % 4)::INTEGER AS source_vault_version, 'Engineer wanted for team ' || (o_orderkey % 29) || '. Five years of practice.' AS jd_text,
         CASE WHEN o_orderkey % 13 <> 0 THEN 'Engineer wanted for team ' || (o_orderkey % 29) || '. Five years of practice.' ELSE 'an older description' END AS source_jd_text,
         CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 17 <> 1 THEN '# Résumé ' || o_orderkey END AS resume_text, c_name AS company_name, c_mktsegment AS company_size
  FROM orders JOIN customer ON c_custkey = o_custkey),
reviews AS (
  SELECT l_orderkey AS application_id, o_custkey AS user_id, l_linenumber AS round_number, l_returnflag AS round_type, l_shipdate AS interview_date,
         nullif(floor(l_quantity)::INTEGER % 6, 0) AS overall_rating, nullif(floor(l_extendedprice)::INTEGER % 6, 0) AS technical_rating, nullif(floor(l_partkey)::INTEGER % 6, 0) AS communication_rating,
         [l_returnflag, l_linestatus] AS tags, CASE WHEN l_linenumber % 3 <> 0 THEN 'went well: ' || l_linestatus END AS what_went_well, CASE WHEN l_linenumber % 2 = 0 THEN 'improve ' || l_returnflag END AS what_to_improve, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
vaults AS (
  SELECT c_custkey AS user_id, (c_custkey % 4)::INTEGER AS version, 'résumé of ' || c_name AS raw_content, c_custkey % 3 <> 0 AS confirmed
  FROM customer WHERE c_custkey % 10 <> 0),
status_events AS (
  SELECT event_id AS id, user_id AS job_id, ts AS changed_at,
         CASE event_type WHEN 'signup' THEN 'applied' WHEN 'view' THEN 'resume_screening' WHEN 'click' THEN 'interview_scheduled' WHEN 'purchase' THEN 'offered' ELSE 'rejected' END AS new_status
  FROM events),
request_log AS (SELECT user_id AS client, ts, event_type AS path, value AS seconds, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code FROM events),
resumes AS (SELECT doc_id, doc_id % n // 5 AS user_id, doc_id % n AS posting, text FROM documents, (SELECT greatest(count(*), 1) AS n FROM benchmark)),
jds AS (SELECT item_id AS job_id, item_id // 5 AS user_id, text FROM benchmark)
"""
