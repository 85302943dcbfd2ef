"""Corpus pipeline: language ID, quality, near duplicates, source mixing, BPE.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame`` over all rows its predecessor kept; all but the last return the
columns of ``documents``. The stages work on copies of the columns under names of their own, so further columns of any
name pass through unharmed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import bpe, jaccard, langid, mixing, quality
from jobtide.session import shared_folder

#: A text goes if no language takes this share of it.
LEAST_SHARE = 0.5


def _renamed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The columns as c0, c1, ... (the text as ``text``), and these names."""
    names = tuple("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns))
    return docs.toDF(*names), names


def _back(rows: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with a known language that makes up at least half of them.

    Null and empty texts and those without a letter go; without any row with a language all go; repeated rows are judged
    each for itself; an empty table stays empty.
    """
    model = langid.learn(docs)
    rows, names = _renamed(docs)
    found = langid.identify(rows, model, keep=names)
    return _back(found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE)), docs, names)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the quality classifier, learned from the labels at hand, doesn't reject.

    Null texts count as empty; without labels of both classes all have one score and all stay (or, with label 0 alone, all
    go); repeated rows are judged each for itself; an empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names = _renamed(docs)
    return _back(quality.score(rows, model, keep=names).filter(F.col("predicted") == 1), docs, names)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of smallest id (then smallest text hash) of each group of near duplicates; texts without words all stay.

    Of repeated rows with words one stays, null ids included; an empty table stays empty.
    """
    key = F.struct(docs["doc_id"].alias("d"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    groups = jaccard.near_duplicates(docs.select(key.alias("ident"), docs["text"]), words=5, num=80, den=100, ident="ident")
    kept = groups.filter(F.col("ident") == F.col("component_id")).select("ident", "n_shingles").dropDuplicates(["ident"])
    rows, names = _renamed(docs)
    rows = rows.withColumn("ident", F.struct(F.col(names[docs.columns.index("doc_id")]).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
    rows = rows.join(kept, "ident")
    with_words = rows.filter(F.col("n_shingles") > 0).dropDuplicates(["ident"])  # exact repeats of a row
    return _back(with_words.unionByName(rows.filter(F.col("n_shingles") == 0)), docs, names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix draws them (a draw of a part takes the whole text), shard by shard in shuffled order.

    Texts without words are not drawn; a null source is a source; repeated rows are drawn each for itself; an empty table
    stays empty.
    """
    rows, names = _renamed(docs)
    ident, source = (names[docs.columns.index(c)] for c in ("doc_id", "source"))
    drawn = mixing.mix(rows, source=source, ident=ident, carry=names)
    shard = F.explode(F.array_compact(F.array("first_shard", "second_shard"))).alias("_shard")
    drawn = drawn.select(*names, "shuffle_key", shard)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = drawn.repartition(parts, "_shard", F.substring("shuffle_key", 3, 4)).sortWithinPartitions("_shard", "shuffle_key")
    return _back(drawn, docs, names)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text; a null text has none, repeated rows stay."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), outputs=True).drop("decoded")


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed), ("bpe", encoded)]
#: Learned models and hashed joins have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once to the shared folder, so no stage is computed again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
