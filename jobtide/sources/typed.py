"""Tables with a declared schema, from files and from databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the driver's tables that the library's views stand on.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}


def struct(spark: SparkSession, schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


def typed(rows: DataFrame, schema: StructType | str, strict: bool = False) -> DataFrame:
    """The declared columns in their order and types, and ``bad_columns``.

    A column that isn't there is null; one of another type is cast value by value, a value that can't be cast is null.
    ``bad_columns`` names, row by row, the columns that had a value and lost it, and those that aren't there at all;
    further columns are left out. With ``strict`` an absent column is an error before anything is read.
    """
    have = {c.lower(): c for c in rows.columns}
    fields = struct(rows.sparkSession, schema).fields
    absent = [f.name for f in fields if f.name.lower() not in have]
    if strict and absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    kinds, out, bad = dict(rows.dtypes), [], []
    for f in fields:
        if f.name in absent:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            bad.append(F.lit(f.name))
            continue
        own = have[f.name.lower()]
        if kinds[own] == f.dataType.simpleString():
            out.append(F.col(own).alias(f.name))
            continue
        # A plain cast where ANSI rules know none (e.g. a map to a number) has no value at all.
        value = F.col(own).try_cast(f.dataType) if _castable(rows, own, f.dataType.simpleString()) else F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
        bad.append(F.when(F.col(own).isNotNull() & value.isNull(), F.lit(f.name)))
    names = F.array_compact(F.array(*bad)) if bad else F.expr("cast(array() as array<string>)")
    return rows.select(*out, names.alias("bad_columns"))


def _castable(rows: DataFrame, column: str, kind: str) -> bool:
    try:
        rows.select(F.col(column).try_cast(kind)).schema  # noqa: B018 - analysed only
    except Exception as fault:  # the analyser's refusal; anything else is raised again
        if "DATATYPE_MISMATCH" not in str(fault):
            raise
        return False
    return True


def read_typed(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", strict: bool = False, **options: str) -> DataFrame:
    """Files as ``typed`` rows. Parquet and ORC bring types of their own; CSV and JSON are read as text first, so that a bad value is null and named."""
    reader = spark.read.format(form).options(**options)
    if form in ("csv", "json"):
        names = [f"`{f.name}` string" for f in struct(spark, schema).fields]
        if form == "json":
            reader = reader.schema(", ".join(names))
        else:
            reader = reader.option("header", options.get("header", "true"))
    return typed(reader.load(path), schema, strict)


def read_database(spark: SparkSession, url: str, table: str, schema: StructType | str, key: str, parts: int, driver: str | None = None, **options: str) -> DataFrame:
    """A database table as ``typed`` rows, read by ``parts`` tasks at a time, each a range of the numeric ``key``.

    The database itself finds least and greatest key (one row comes back). Rows whose key is null come with the first range.
    An empty table is read by one task.
    """
    source = {"url": url} | ({"driver": driver} if driver else {}) | options
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = spark.read.format("jdbc").options(**source).option("query", f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}").load().first()
    reader = spark.read.format("jdbc").options(**source).option("dbtable", table)
    if ends[0] is not None and parts > 1:
        reader = reader.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(int(ends[1]) + 1), numPartitions=str(parts))
    return typed(reader.load(), schema)
