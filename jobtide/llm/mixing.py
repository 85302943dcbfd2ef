"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source gets a target in words (weights, capped at ``cap`` times the source, the excess reshared). The texts of a
source fall into ``BLOCKS`` blocks by a hash of id and text. The blocks are put in a hashed order and drawn without
replacement until the quota of the source is met exactly in words: whole blocks, then whole parts of the block at the
edge, whole texts of the part at the edge, and a part of the last text. A target above the source's size takes every block
once and draws the rest again.

Draws are then dealt to the output shards by a tree: in each node the draws are ordered by a hash and the first half
goes left, which splits the node's quotas among the sources as a multivariate hypergeometric draw does. Blocks of a
shard are disjoint; inside a shard the texts are ordered by their hash.

Windows see sums only: one row a source, at most ``2 * BLOCKS`` rows a source in the tree, ``PARTS`` parts of the one block
of a source at the edge. Texts meet in a window only inside the one part at the edge, a ``BLOCKS * PARTS``-th (a millionth)
of their source, so a source with a third of all rows is no group of its own.

Defined results: null or blank texts have size 0 and are taken 0 times; null is a source of its own, last in order; a
source without words has target 0; repeated rows are drawn each for itself; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE, CAP, SHARDS = 1.5, 2, 16
BLOCKS, PARTS = 256, 4096  # two hexadecimal digits, and three more
BROADCAST_ROWS = 65_536  # a larger block table is joined by shuffle


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(blocks: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source: source_size, weight, target. One row a source; closed form of the repeated resharing."""
    per = blocks.groupBy("skey").agg(F.sum("words").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(W.orderBy("skey")) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("level", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order, later = W.orderBy("level", "skey"), W.orderBy(F.desc("level"), F.desc("skey"))
    before = F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(later.rowsBetween(W.unboundedPreceding, 0))
    total = F.lit(share) * F.sum("source_size").over(W.partitionBy())
    per = per.withColumn("lam", (total - before) / rest)
    lam = F.max(F.when(F.col("level") >= F.col("lam"), F.col("lam"))).over(W.partitionBy())
    # A level above the common one is not capped.
    return per.select("skey", "source_size", "weight", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(lam, F.lit(0.0)) * F.col("weight")).alias("target"))


def _tree(draws: DataFrame, shards: int) -> DataFrame:
    """Deal the draws of every node half and half, level by level, down to the shards."""
    depth = shards.bit_length() - 1
    draws = draws.withColumn("shard", F.lit(0))
    for level in range(depth):
        key = F.md5(F.concat_ws("/", F.lit(f"tree{level}"), "skey", "block", F.col("draw").cast("string")))
        node = W.partitionBy("shard")
        draws = draws.withColumn("_r", F.row_number().over(node.orderBy(key, "skey", "block", "draw"))).withColumn("_n", F.count("*").over(node))
        draws = draws.withColumn("shard", F.col("shard") * 2 + F.when(F.col("_r") * 2 <= F.col("_n") + 1, 0).otherwise(1)).drop("_r", "_n")
    return draws


def mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, first_shard, second_shard, shuffle_key, ``carry``.

    ``taken`` counts words, repeats included; the shards are those of the first and second draw (null: not drawn).
    """
    ids = F.coalesce(F.col(ident).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(ident).alias("doc_id"),
        F.concat(F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col(source), F.lit(""))).alias("skey"),
        n_words(F.col(text)).alias("size"),
        F.md5(F.concat_ws("/", F.lit("mix"), ids, F.md5(F.coalesce(F.col(text), F.lit(""))))).alias("shuffle_key"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    ).withColumn("block", F.substring("shuffle_key", 1, 2))
    blocks = checkpointed(rows.groupBy("skey", "block").agg(F.sum("size").alias("words")))  # at most BLOCKS rows a source
    goal = targets(blocks)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    goal = goal.withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", quota - F.col("rounds") * F.col("source_size"))
    order = W.partitionBy("skey").orderBy(F.md5(F.concat_ws("/", F.lit("block"), "skey", "block")), "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)).cast("long"))
    blocks = checkpointed(blocks.join(goal, "skey").withColumn("again", F.col("before") < F.col("rest")))
    small = blocks.count() <= BROADCAST_ROWS
    draws = blocks.select(
        "skey", "block", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda d: d <= F.col("rounds") + F.when(F.col("again"), 1).otherwise(0))).alias("draw")
    )
    dealt = _tree(draws, shards).groupBy("skey", "block").agg(
        F.max(F.when(F.col("draw") == 1, F.col("shard"))).alias("first_shard"), F.max(F.when(F.col("draw") == 2, F.col("shard"))).alias("second_shard")
    )
    blocks = blocks.join(dealt, ["skey", "block"], "left")
    edge = F.col("again") & (F.col("before") + F.col("words") > F.col("rest"))
    blocks = blocks.withColumn("edge", edge)
    few = lambda x, yes: F.broadcast(x) if yes else x
    joined = rows.join(few(blocks, small), ["skey", "block"])  # texts stay where they are
    # The blocks at the edge, one a source at most: their parts, then the texts of the part at the edge.
    part = F.substring("shuffle_key", 3, 3)
    ends = blocks.filter("edge").select("skey", "block", F.col("before").alias("block_before"), F.col("rest").alias("goal"))
    parts = rows.join(few(ends, small), ["skey", "block"]).groupBy("skey", part.alias("part"), "block_before", "goal").agg(F.sum("size").alias("part_words"))
    up_to = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.col("block_before") + F.coalesce(F.sum("part_words").over(up_to), F.lit(0)))
    parts = checkpointed(parts.select("skey", "part", "part_before", (F.col("part_before") < F.col("goal")).alias("part_again"), ((F.col("part_before") < F.col("goal")) & (F.col("part_before") + F.col("part_words") > F.col("goal"))).alias("part_edge")))
    in_ends = joined.filter("edge").withColumn("part", part).join(few(parts, parts.count() <= BROADCAST_ROWS), ["skey", "part"])
    inside = W.partitionBy("skey", "part").orderBy("shuffle_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = in_ends.filter("part_edge").withColumn("ahead", F.col("part_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))).drop("ahead")
    whole = in_ends.filter(~F.col("part_edge")).withColumn("more", F.when(F.col("part_again"), F.col("size")).otherwise(F.lit(0)))
    at_edge = cut.unionByName(whole).drop("part", "part_before", "part_again", "part_edge")
    others = joined.filter(~F.col("edge")).withColumn("more", F.when(F.col("again"), F.col("size")).otherwise(F.lit(0)))
    out = others.unionByName(at_edge).withColumn("taken", (F.col("rounds") * F.col("size") + F.col("more")).cast("long"))
    drawn = F.when(F.col("more") > 0, F.col("rounds") + 1).otherwise(F.col("rounds"))
    drawn = F.when(F.col("size") > 0, drawn).otherwise(F.lit(0))
    return out.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(drawn >= 1, F.col("first_shard")).alias("first_shard"),
        F.when(drawn >= 2, F.col("second_shard")).alias("second_shard"),
        "shuffle_key", *[F.col(f"carry_{c}").alias(c) for c in carry],
    )


def oracle() -> str:
    """The same draw in SQL over ``documents``."""
    levels, prev = [], "draws"
    for level in range(SHARDS.bit_length() - 1):
        levels.append(f"""
t{level} AS (
  SELECT skey, block, draw, shard * 2 + CASE WHEN r * 2 <= n + 1 THEN 0 ELSE 1 END AS shard
  FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5('tree{level}/' || skey || '/' || block || '/' || draw), skey, block, draw) AS r,
               count(*) OVER (PARTITION BY shard) AS n FROM {prev}))""")
        prev = f"t{level}"
    return f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS shuffle_key
  FROM documents),
per AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY skey),
lev AS (SELECT *, 2.0::DOUBLE * source_size / weight AS level FROM per),
cand AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY level DESC, skey DESC ROWS UNBOUNDED PRECEDING) AS lam FROM lev),
goal AS (
  SELECT skey, source_size,
         least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN level >= lam THEN lam END) OVER (), 0) * weight)::DOUBLE AS target FROM cand),
quota AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS rounds FROM goal),
blocks AS (
  SELECT skey, block, words, coalesce(sum(words) OVER (PARTITION BY skey ORDER BY md5('block/' || skey || '/' || block), block
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT skey, shuffle_key[1:2] AS block, sum(size)::BIGINT AS words FROM sized GROUP BY 1, 2)),
bq AS (
  SELECT b.*, q.source_size, q.target, q.rounds, floor(q.target + 0.5)::BIGINT - q.rounds * q.source_size AS rest
  FROM blocks b JOIN quota q USING (skey)),
draws AS (
  SELECT skey, block, draw, 0 AS shard FROM bq, (VALUES (1), (2)) v(draw)
  WHERE draw <= rounds + CASE WHEN before < rest THEN 1 ELSE 0 END),{','.join(levels)},
dealt AS (
  SELECT skey, block, max(CASE WHEN draw = 1 THEN shard END) AS s1, max(CASE WHEN draw = 2 THEN shard END) AS s2
  FROM {prev} GROUP BY 1, 2),
docs AS (
  SELECT s.doc_id, s.size, s.shuffle_key, b.*, d.s1, d.s2,
         b.before + coalesce(sum(s.size) OVER (PARTITION BY s.skey, b.block ORDER BY s.shuffle_key, s.doc_id, s.size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN bq b ON b.skey = s.skey AND b.block = s.shuffle_key[1:2]
  LEFT JOIN dealt d ON d.skey = b.skey AND d.block = b.block),
took AS (SELECT *, greatest(0, least(size, rest - ahead))::BIGINT AS more FROM docs)
SELECT doc_id, size, source_size, target, (rounds * size + more)::BIGINT AS taken,
       CASE WHEN size > 0 AND rounds + CASE WHEN more > 0 THEN 1 ELSE 0 END >= 1 THEN s1 END::INTEGER AS first_shard,
       CASE WHEN size > 0 AND rounds + CASE WHEN more > 0 THEN 1 ELSE 0 END >= 2 THEN s2 END::INTEGER AS second_shard,
       shuffle_key
FROM took"""
