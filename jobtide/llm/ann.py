"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform each); a
rotation's code of a vector is the signed axis nearest to the turned vector. A bucket of one of the ``TABLES`` tables is
the codes of one or more rotations together. A query probes, in every table, the buckets whose axes are nearest to it.

How many rotations make a bucket and how many buckets are probed is measured, not fixed: the true neighbours of a sample
of ``SAMPLE`` queries among all rows are found by comparison, and their buckets' places in the queries' probing order tell
the recall of every choice. Of the choices that find ``TARGET`` of them, the one that compares the least part of the rows is
taken: near neighbours are found with few probes of small buckets, vectors without near ones need many probes of large
ones. So recall holds at every size; what data without structure costs is comparisons.

Rows stand once in each table. ``AXES_IN_GROUP`` neighbouring buckets are a group; groups are counted, and only those with
more rows or more queries than a task should hold are split. A pair is scored in the first table where it meets, on the
original vectors in double precision, and the best of every group are merged. Queries that found fewer rows than asked
for are searched again with all axes probed, which is exact.

Equal vectors are hashed once: each keeps its ``k`` + 1 smallest ids, which is all that a list of ``k`` can show.
Where norms differ, one coordinate is added so that the largest inner product is the smallest angle.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, neither do rows without id; rows with the query's own id are not its candidates; repeated rows count once; ties
go to the smaller id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.session import checkpointed

TABLES = 8
SAMPLE, TARGET = 128, 0.95
MOST_FOLD, MOST_PROBES = 3, 32  # rotations to a bucket; probes of buckets of more than one rotation
AXES_IN_GROUP = 16
GROUP_ROWS, GROUP_QUERIES = 32_768, 8_192  # distinct vectors and queries that a task holds of a group
SEED = 20_240


def _signs(rotations: int, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (rotations, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows (their length is a power of two)."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def padded(dim: int) -> int:
    return 1 << max(0, (dim - 1).bit_length())


def buckets(x: np.ndarray, tables: int, fold: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` nearest buckets of each row in each table, nearest first: rows x tables x probes."""
    width = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = _signs(tables * fold, width)
    out = np.empty((len(x), tables, probes), np.int32)
    for t in range(tables):
        code, near = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for s in signs[t * fold : (t + 1) * fold]:
            turned = x
            for flip in s:
                turned = hadamard(turned * flip)
            both = np.concatenate([turned, -turned], 1)
            axis = np.argsort(-both, 1, kind="stable")[:, : min(probes, 2 * width)]
            code = (code[:, :, None] * (2 * width) + axis[:, None, :]).reshape(len(x), -1)
            near = (near[:, :, None] + np.take_along_axis(both, axis, 1)[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-near, 1, kind="stable")[:, :probes]
            code, near = np.take_along_axis(code, best, 1), np.take_along_axis(near, best, 1)
        out[:, t] = code
    return out


def _directions(v: np.ndarray, longest: float, lift: bool, query: bool) -> np.ndarray:
    """Unit vectors whose angles order the inner products."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    if not lift:
        return v / norm
    if query:
        return np.hstack([v / norm, np.zeros_like(norm)])
    v = v / longest
    return np.hstack([v, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def valid(vectors: DataFrame, vec: str, ident: str) -> DataFrame:
    """Ids and vectors that take part."""
    rows = vectors.select(vectors[ident].cast("long").alias("vec_id"), vectors[vec].cast("array<double>").alias("v"))
    limit = F.lit(float("inf"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _first(ask: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of largest value of each asker, ties to the smaller ``tie``: askers, carried, values."""
    order = np.lexsort((tie, -value, ask))
    ask, value, carried = ask[order], value[order], carried[order]
    place = np.arange(len(ask)) - np.searchsorted(ask, ask)
    return ask[place < k], carried[place < k], value[place < k]


def _crowds(coded: DataFrame, most: int) -> dict[tuple[int, int], int]:
    """Pieces of the groups (table, part) that have more rows than a task should hold; there are few such groups."""
    rows = coded.groupBy("table", "part").count().filter(F.col("count") > most)
    return {(r["table"], r["part"]): -(-r["count"] // most) for r in rows.collect()}


def neighbours(index: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct vectors of some vectors among all rows (not the row that is the vector's own alone): places of the askers, and vectors."""
    spec = index.sparkSession.sparkContext.broadcast((ids, asked))  # SAMPLE vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = spec.value
        best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            v, names = _matrix(batch.column(0)), batch.column(1)
            if not len(v):
                continue
            value = q @ v.T
            alone = {x[0]: j for j, x in enumerate(names.to_pylist()) if len(x) == 1}
            for i, name in enumerate(own.tolist()):
                if name in alone:
                    value[i, alone[name]] = -np.inf
            top = np.argsort(-value, 1, kind="stable")[:, :k]
            who = np.repeat(np.arange(len(q)), top.shape[1])
            new = (who, v[top.ravel()], np.take_along_axis(value, top, 1).ravel())
            if best is not None:
                new = tuple(np.concatenate([a, b]) for a, b in zip(best, new, strict=True))
                order = np.lexsort((-new[2], new[0]))
                place = np.arange(len(order)) - np.searchsorted(new[0][order], new[0][order])
                new = tuple(x[order[place < k]] for x in new)
            best = new
        if best is not None:
            some = best[2] > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(best[0][some]), pa.array([r.tobytes() for r in best[1][some]], pa.binary()), pa.array(best[2][some])], ["who", "v", "value"])

    rows = index.select("v", "ids").mapInArrow(run, "who bigint, v binary, value double")
    got = rows.withColumn("r", F.row_number().over(W.partitionBy("who").orderBy(F.desc("value"), "v"))).filter(F.col("r") <= k).toArrow()  # SAMPLE * k rows
    v = np.frombuffer(b"".join(got.column("v").to_pylist()), float).reshape(got.num_rows, -1)
    return got.column("who").to_numpy(), v


def measured(index: DataFrame, queries: DataFrame, k: int, longest: float, lift: bool, tables: int) -> tuple[int, int]:
    """Rotations to a bucket and probes a table that find ``TARGET`` of the sample's neighbours with the fewest comparisons."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow().combine_chunks()
    if not some.num_rows:
        return 1, 1
    ids, asked = some.column("vec_id").to_numpy(), _matrix(some.column("v").combine_chunks())
    who, near = neighbours(index, ids, asked, k)
    width = padded(asked.shape[1] + int(lift))
    every, choice = 2 * width, (1, 2 * width)
    if not len(near):
        return choice
    share = 1.0
    for fold in range(1, MOST_FOLD + 1):
        if every**fold >= 1 << 31:
            break
        most = every if fold == 1 else min(MOST_PROBES, every**fold)
        probing = buckets(_directions(asked, longest, lift, True), tables, fold, most)
        own = buckets(_directions(near, longest, lift, False), tables, fold)
        hit = probing[who] == own
        place = np.where(hit.any(2), hit.argmax(2), most).min(1)  # in the table that finds it first
        found = np.cumsum(np.bincount(place, minlength=most + 1))[:most] / len(place)
        enough = np.flatnonzero(found >= TARGET)
        if len(enough) and (enough[0] + 1) / every**fold < share:
            share, choice = (enough[0] + 1) / every**fold, (fold, int(enough[0]) + 1)
    return choice


def _search(index: DataFrame, queries: DataFrame, k: int, n: int, dim: int, longest: float, lift: bool, tables: int, fold: int, many: int) -> DataFrame:

    def codes(v: np.ndarray, query: bool) -> np.ndarray:
        return buckets(_directions(v, longest, lift, query), tables, fold, many if query else 1)

    def parted(query: bool):
        """Only table and part of every copy, for the count of the groups."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(0))
                if len(v):
                    parts = codes(v, query) // AXES_IN_GROUP
                    for t in range(tables):
                        one = np.sort(parts[:, t], axis=1)
                        new = np.ones(one.shape, bool)
                        new[:, 1:] = one[:, 1:] != one[:, :-1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(new.sum()), t, np.int32)), pa.array(one[new])], ["table", "part"])

        return run

    crowds = lambda rows, total, query, most: _crowds(rows.select("v").mapInArrow(parted(query), "table int, part int"), most) if total > most else {}
    big = queries.sparkSession.sparkContext.broadcast((crowds(index, n, False, GROUP_ROWS), crowds(queries, queries.count(), True, GROUP_QUERIES)))  # a few entries: only crowded groups

    def pieces(table: int, parts: np.ndarray, of_queries: bool) -> np.ndarray:
        return np.array([big.value[of_queries].get((table, p), 1) for p in parts.tolist()], np.int64)

    def copies(at: np.ndarray, table: int, parts: np.ndarray, own: np.ndarray, query: bool) -> tuple[np.ndarray, list[pa.Array]]:
        """Each row once for every piece of the other side; its own piece by its hash."""
        other = pieces(table, parts, not query)
        turn = np.arange(other.sum()) - np.repeat(np.cumsum(other) - other, other)
        piece = np.repeat(own % pieces(table, parts, query), other)
        salts = (turn, piece) if query else (piece, turn)
        return np.repeat(at, other), [pa.array(x.astype(np.int32)) for x in (np.full(len(turn), table), np.repeat(parts, other), *salts)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(0))
            if not len(v):
                continue
            code = codes(v, False)[:, :, 0]
            raw, all_codes = pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in code.astype("<i4")], pa.binary())
            for t in range(tables):
                at, where = copies(np.arange(len(v)), t, code[:, t] // AXES_IN_GROUP, np.asarray(batch.column(2)), False)
                yield pa.RecordBatch.from_arrays([*where, raw.take(pa.array(at)), all_codes.take(pa.array(at)), batch.column(1).take(pa.array(at))], ["table", "part", "salt", "qsalt", "v", "codes", "ids"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids = _matrix(batch.column(0)), np.asarray(batch.column(1))
            if not len(v):
                continue
            found = codes(v, True)
            raw, all_codes = pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in found.astype("<i4")], pa.binary())
            for t in range(tables):
                pairs = np.unique(np.stack([np.repeat(np.arange(len(v)), many), (found[:, t] // AXES_IN_GROUP).ravel()], 1), axis=0)
                at, where = copies(pairs[:, 0], t, pairs[:, 1], ids[pairs[:, 0]] // 20, True)
                yield pa.RecordBatch.from_arrays([*where, raw.take(pa.array(at)), all_codes.take(pa.array(at)), pa.array(ids[at])], ["table", "part", "salt", "qsalt", "v", "codes", "query_id"])

    def ranked(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(x):
            return empty
        t = int(key[0])
        unpack = lambda c, kind: np.frombuffer(b"".join(c), kind).reshape(len(c), -1)
        xv, xc = unpack(x["v"], float), unpack(x["codes"], "<i4")
        qv, qid = unpack(q["v"], float), q["query_id"].to_numpy()
        probe = unpack(q["codes"], "<i4").reshape(len(q), tables, many)
        there = []  # per table up to this one: the buckets of the rows here, each row's place among them, and which query probes which
        for table in range(t + 1):
            own, place = np.unique(xc[:, table], return_inverse=True)
            at = np.minimum(np.searchsorted(own, probe[:, table]), len(own) - 1)
            hit = np.zeros((len(q), len(own)), bool)
            who, which = np.nonzero(own[at] == probe[:, table])
            hit[who, at[who, which]] = True
            there.append((own, place, hit))
        ids, sizes = np.concatenate(x["ids"].to_list()), x["ids"].map(len).to_numpy()
        starts = np.cumsum(sizes) - sizes
        found = []
        for bucket in range(len(there[t][0])):  # only what meets in a bucket is multiplied
            rows = np.flatnonzero(there[t][1] == bucket)
            asking = np.flatnonzero(there[t][2][:, bucket])
            for part in (asking[k : k + 256] for k in range(0, len(asking), 256)):
                value = qv[part] @ xv[rows].T
                for _, place, hit in there[:t]:
                    value[hit[part][:, place[rows]]] = -np.inf  # scored in an earlier table
                last = np.partition(value, max(0, len(rows) - k - 1), axis=1)[:, max(0, len(rows) - k - 1)]
                at = np.nonzero((value >= last[:, None]) & (value > -np.inf))
                found.append((part[at[0]], rows[at[1]], value[at]))
        if not found:
            return empty
        ask, row, value = (np.concatenate(c) for c in zip(*found, strict=True))
        ask, row, value = _first(ask, value, ids[starts[row]], k + 1, row)
        times = sizes[row]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        near, ask, value = ids[np.repeat(starts[row], times) + inner], np.repeat(ask, times), np.repeat(value, times)
        other = near != qid[ask]
        ask, near, value = _first(ask[other], value[other], near[other], k, near[other])
        return pd.DataFrame({"query_id": qid[ask], "vec_id": near, "score": value})

    keys = ["table", "part", "salt", "qsalt"]
    head = "table int, part int, salt int, qsalt int, v binary, codes binary"
    right = index.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(1 << 20)).alias("h")).mapInArrow(hashed, f"{head}, ids array<bigint>")
    left = queries.select("v", "vec_id").mapInArrow(probed, f"{head}, query_id bigint")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(ranked, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec: str = "embedding", ident: str = "vec_id", tables: int = TABLES, fold: int | None = None, probes: int | None = None) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    ``fold`` and ``probes`` (rotations to a bucket, probes a table) are measured unless both are given.
    """
    rows = valid(vectors, vec, ident).groupBy("vec_id", "v").agg(F.lit(1).alias("_one")).drop("_one")
    near = W.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = checkpointed(index)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = index.agg(F.count("*").alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high"), F.max(F.size("v")).alias("dim")).first()
    n, low, high, dim = stats["n"], stats["low"] or 1.0, stats["high"] or 1.0, stats["dim"] or 1
    lift = high - low > 1e-3 * high
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    if fold is None or probes is None:
        fold, probes = measured(index, queries, k, high, lift, tables)
    found = checkpointed(_search(index, queries, k, n, dim, high, lift, tables, fold, probes))
    # A query with fewer rows than asked for: all axes probed, all rows compared.
    there = found.groupBy("query_id").agg(F.count("*").alias("got"))
    short = queries.join(there, queries["vec_id"] == there["query_id"], "left").filter(F.coalesce("got", F.lit(0)) < F.lit(k)).select("vec_id", "v")
    if short.isEmpty():
        return found
    again = _search(index, short, k, n, dim, high, lift, 1, 1, 2 * padded(dim + int(lift)))
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def brute_force(ids: np.ndarray, vectors: np.ndarray, every: int = 20, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Exact lists for tests."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        value = vectors @ vectors[i]
        order = np.lexsort((ids, -value))
        out[int(ids[i])] = [(int(ids[j]), float(value[j])) for j in order if ids[j] != ids[i]][:k]
    return out
