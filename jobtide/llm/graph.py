"""Connected components of an edge table, by alternating star contractions in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.session import checkpointed


def _two(rows: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column]) -> DataFrame:
    """Two rows (u, v) for each row, from one reading of it: a union would hold all of its plan twice."""
    pair = lambda uv: F.struct(uv[0].alias("u"), uv[1].alias("v"))
    return rows.select(F.inline(F.array(pair(first), pair(second))))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v alone, which is no u itself: then each v is the least node of what it reaches."""
    ends = _two(edges, (F.col("u"), F.lit(1)), (F.col("v"), F.lit(0)))  # v: 1 at the upper end, 0 at the lower
    upper = F.sum("v")
    return ends.groupBy("u").agg(((upper > 1) | ((upper > 0) & (F.count("*") > upper))).alias("no_star")).filter("no_star").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 50) -> DataFrame:
    """Rows (node, label): the least node reachable, for every node with an edge. Edges between equal ids are ignored.

    Every round a large-star and a small-star contraction, until the edges are stars around the least nodes; edges that
    are stars already need none. Only minima are aggregated, never neighbour lists, so a node with very many edges is no
    single large row. Lineage is cut after each contraction, so that the driver's plans stay small.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = checkpointed(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most):
        if _are_stars(edges):
            break
        large = checkpointed(_with_least(_two(edges, (u, v), (v, u))).filter(v > u).select(v.alias("u"), m.alias("v")))  # as many rows as edges
        edges = checkpointed(_two(_with_least(large), (v, m), (u, m)).filter(u != v).distinct())
    else:
        raise RuntimeError(f"no stars after {most} rounds")
    return edges.select(u.alias("node"), v.alias("label")).unionByName(edges.select(v.alias("node"), v.alias("label")).distinct())
