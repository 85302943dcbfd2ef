"""Stored tables with a key: rows are changed in the buckets they fall in, and nowhere else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, BATCH = "bucket", "batch"


class KeyedTable:
    """Parquet files dealt to ``buckets`` folders by a hash of the key, one row a key.

    An upsert reads and writes only the buckets that its rows fall in (partition pruning; dynamic partition overwrite);
    the files of the others stay as they are. It is safe to repeat: each row bears the number of the batch that changed
    it last, and a batch doesn't change a row twice. It is safe to interrupt: the merged buckets are written beside the
    table first, and only a finished write is moved into it; what an interrupted run left is moved by the next one. Until
    then a reader may find a bucket as it was, as it will be or, if the move itself was cut, not at all. One writer at a time. The number of buckets is chosen when the table is made (a bucket is what an upsert rewrites at
    least) and has to stay the same.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        kind = spark.createDataFrame([], schema).schema
        self.columns = kind.names
        self.schema = spark.createDataFrame([], kind).withColumns({BATCH: F.lit(0).cast("long"), BUCKET: F.lit(0)}).schema
        self.pending = f"{self.path}_pending"

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _remove(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _move(self, batch: int) -> None:
        """Put the finished buckets of a batch in the place of the old ones."""
        done = f"{self.pending}/{BATCH}={batch}"
        rows = self.spark.read.schema(self.schema).option("basePath", done).parquet(done)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        self._remove(done)

    def recover(self) -> None:
        """Finish what an interrupted upsert left: whole batches are moved, unfinished ones are dropped (their source is read again)."""
        if not self._exists(self.pending):
            return
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.pending)
        found = sorted(int(f.getPath().getName().split("=")[1]) for f in where.getFileSystem(conf).listStatus(where))
        for batch in found:
            if self._exists(f"{self.pending}/{BATCH}={batch}/_SUCCESS"):
                self._move(batch)
            else:
                self._remove(f"{self.pending}/{BATCH}={batch}")

    def read(self) -> DataFrame:
        """The rows as of the last finished upsert."""
        return self._stored().select(*self.columns)

    def upsert(self, incoming: DataFrame, batch: int, change: Callable[[DataFrame, DataFrame], dict[str, Column]] | None = None) -> list[int]:
        """Change or add the rows of ``incoming`` (one a key; see ``last_incoming``) and return the touched buckets.

        ``change`` gives columns from the stored and the incoming row (as frames of equal key, the stored one null where
        there is none); without it the incoming row replaces the stored one. Columns that it doesn't name stay as stored.
        ``batch`` numbers rise; a batch that comes again changes nothing.
        """
        self.recover()
        rows = self._dealt(incoming)
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        old = self._stored().filter(F.col(BUCKET).isin(touched)).alias("old")
        new = rows.alias("new")
        joined = old.join(new, (F.col(f"old.{BUCKET}") == F.col(f"new.{BUCKET}")) & (F.col(f"old.{self.key}") == F.col(f"new.{self.key}")), "full_outer")
        values = {c: F.col(f"new.{c}") for c in incoming.columns if c in self.columns} if change is None else change(_Side("old", self.columns), _Side("new", incoming.columns))
        fresh = F.col(f"new.{BUCKET}").isNotNull() & (F.coalesce(f"old.{BATCH}", F.lit(-1)) < batch)
        kept = {c: F.when(fresh, values[c]).otherwise(F.col(f"old.{c}")) if c in values else F.col(f"old.{c}") for c in self.columns}
        kept[self.key] = F.coalesce(f"old.{self.key}", f"new.{self.key}")
        merged = joined.select(
            *[kept[c].cast(self.schema[c].dataType).alias(c) for c in self.columns],
            F.when(fresh, F.lit(batch)).otherwise(F.col(f"old.{BATCH}")).cast("long").alias(BATCH), F.coalesce(f"old.{BUCKET}", f"new.{BUCKET}").alias(BUCKET),
        )
        # Each bucket is written by so many tasks that all tasks have work, and by no more.
        tasks = max(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        part = F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(tasks // len(touched)))
        merged.repartition(tasks, BUCKET, part).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.pending}/{BATCH}={batch}")
        self._move(batch)
        return touched


class _Side:
    """Columns of one side of the join; those it hasn't are null."""

    def __init__(self, name: str, columns: list[str]) -> None:
        self.name, self.columns = name, columns

    def __getitem__(self, column: str) -> Column:
        return F.col(f"{self.name}.{column}") if column in self.columns else F.lit(None)
