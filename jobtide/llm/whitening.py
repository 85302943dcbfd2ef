"""Whitening of embeddings by an incremental eigendecomposition.

Entries become integers x = floor(1024 * c) + 100000; sums are exact. Each partition holds the spectrum (eigenvalues and
vectors) of what it has read: centred rows are folded, ``BLOCK`` at a time, into at most d rows with the same scatter
(an orthogonal triangularisation), and each of these changes the spectrum by a rank-one update. An update solves the
secular equation between the old eigenvalues, after deflation: a direction that the new row has no part in stays, and
of directions with equal eigenvalues all but one are rotated out. Spectra of partitions are combined by successive
rank-one updates too, ``FAN`` at a time in a tree of Spark jobs. At last all rows are projected on the eigenvectors and the
small matrix of their products is diagonalised (Rayleigh-Ritz over the whole space), which leaves the rounding errors of
one product, however many updates came before.

Of the data, the driver sees sums of each dimension, one spectrum and one d x d matrix. Five passes read the vectors.

Defined results: vectors that are null, empty or hold null or non-finite entries, or entries beyond 2**42 (whose x has no
exact products), are dropped, and so are those of another length than most have (ties: the longer). Components whose
eigenvalue is 1e-11 of the first or less are no directions of the data and are left out: fewer than 8 dimensions give
fewer components, equal vectors or a single one give no rows. Null and repeated ids are rows of their own. A deviation
beyond 64 bits is null. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 42)
COMPONENTS = 8
BLOCK = 1 << 14  # rows folded before their updates, at most (an Arrow batch holds fewer)
FAN = 16  # spectra combined by one task
LEAST = 1e-11
_EPS = np.finfo(float).eps
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# Rank-one updates


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i**2 / (d_i - t), and their differences d_i - t_j; ``d`` rises strictly, no z_i is 0.

    Root j lies between d_j and d_(j+1). Each is sought as a distance from the nearer of both, by Newton steps that
    bisection keeps safe, on all roots at once, so that small distances keep their digits.
    """
    k, z2 = len(d), z * z
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = right - d
    middle = d + gap / 2
    # The sign at the middle tells the nearer pole.
    at_middle = 1 + (z2[:, None] / (d[:, None] - middle[None, :])).sum(0)
    near = np.where((at_middle >= 0) | (np.arange(k) == k - 1), np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d[:, None] - d[near][None, :]  # exact differences to each origin
    low = np.where(near == np.arange(k), 0.0, -gap / 2)
    high = np.where(near == np.arange(k), np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    t = (low + high) / 2
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = delta - t[None, :]
            terms = z2[:, None] / apart
            f = 1 + terms.sum(0)
            slope = (terms / apart).sum(0)
        up = f < 0  # rising between poles: the root lies to the right
        low, high = np.where(up, t, low), np.where(up, high, t)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = t - f / slope
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            done = (np.abs(f) <= _EPS * (1 + np.abs(terms).sum(0))) | (np.abs(new - t) <= 2 * _EPS * np.abs(new))
        t = np.where(done, t, new)
        if done.all():
            break
    return d[near] + t, delta - t[None, :]


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of V diag(values) V' + row row'; values rise, columns of ``vectors`` are orthonormal."""
    z = vectors.T @ row
    size = float(z @ z)
    if size == 0:
        return values, vectors
    tiny = 8 * _EPS * max(float(values[-1]), size)
    values, vectors = values.copy(), vectors.copy()
    # Equal eigenvalues: a rotation moves the part of the row from one direction to the next.
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tiny)
    for a, b in zip(live[:-1], live[1:], strict=True):
        r = float(np.hypot(z[a], z[b]))
        if (values[b] - values[a]) * abs(z[a] * z[b]) <= tiny * r * r:
            c, s = z[b] / r, z[a] / r
            vectors[:, [a, b]] = vectors[:, [a, b]] @ np.array([[c, s], [-s, c]])
            z[a], z[b] = 0.0, r
            values[a], values[b] = c * c * values[a] + s * s * values[b], s * s * values[a] + c * c * values[b]
    live = live[np.abs(z[live]) * np.sqrt(size) > tiny]
    if not len(live):
        return values, vectors
    order = live[np.argsort(values[live], kind="stable")]
    d = values[order]
    if len(order) > 1:
        least = np.spacing(max(float(values[-1]), size))
        for k in range(1, len(d)):  # rounding may have left equal neighbours
            d[k] = max(d[k], d[k - 1] + least)
    roots, apart = secular(d, z[order])
    # The row that has these roots exactly (its size from products of differences), so that vectors are orthogonal.
    with np.errstate(divide="ignore"):
        k = len(d)
        poles = d[:, None] - d[None, :]
        np.fill_diagonal(poles, 1.0)
        ratio = np.abs(apart) / np.abs(poles)
        own = np.exp(0.5 * np.log(np.maximum(ratio, np.finfo(float).tiny)).sum(1)) * np.sign(z[order])
    inner = own[:, None] / apart
    inner /= np.sqrt((inner * inner).sum(0))
    values[order] = roots
    vectors[:, order] = vectors[:, order] @ inner
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def absorb(values: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank-one updates by each row."""
    for row in rows:
        values, vectors = rank_one(values, vectors, row)
    return values, vectors


# Passes over the vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integers x of a list column of doubles of ``width``, as int64."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _tree(parts: DataFrame, fold: Callable[[list[np.ndarray]], np.ndarray], pieces: int) -> np.ndarray | None:
    """Fold the arrays of all partitions (columns part, data), ``FAN`` neighbours a task and round, down to one."""

    def some(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN], "data": [fold([np.frombuffer(x) for x in frame["data"]]).tobytes()]})

    while pieces > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("_g")).applyInPandas(some, "part bigint, data binary")
        pieces = -(-pieces // FAN)
    got = parts.collect()  # one row
    return np.frombuffer(got[0]["data"]) if got else None


def _partials(vectors: DataFrame, width: int, start: Callable[[], object], step: Callable, finish: Callable[[object], np.ndarray]) -> DataFrame:
    """One array of each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_ = start(), False
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                any_ = True
                state = step(state, _matrix(batch.column(0).slice(k, BLOCK), width))
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([finish(state).tobytes()], pa.binary())], ["part", "data"])

    return vectors.mapInArrow(run, "part bigint, data binary")


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and v (doubles) of the rows that take part, and their length (0 without rows)."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda e: F.coalesce(F.abs(e) <= LARGEST, F.lit(False)) & ~F.isnan(e))
    rows = embeddings.select("vec_id", v.alias("v")).filter(F.size("v") > 0).filter(good)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("v") == width), width


def spectrum(rows: DataFrame, mean: np.ndarray, parts: int) -> np.ndarray:
    """Eigenvectors (columns, values rising) of the scatter of all rows, by rank-one updates in partitions and between them."""
    width = len(mean)

    def step(state: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        folded = np.linalg.qr(x - mean, "r")
        return absorb(*state, folded)

    def packed(state: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        values, vectors = state
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T  # rows whose scatter is the spectrum

    fresh = lambda: (np.zeros(width), np.eye(width))

    def fold(spectra: list[np.ndarray]) -> np.ndarray:
        first = spectra[0].reshape(width, width)
        sizes = np.sqrt((first * first).sum(1))
        if sizes[0] > 0:  # a full spectrum is taken up as it is
            state = (sizes**2, (first / sizes[:, None]).T)
            spectra = spectra[1:]
        else:
            state = fresh()
        for s in spectra:
            state = absorb(*state, s.reshape(width, width))
        return packed(state)

    last = _tree(_partials(rows, width, fresh, step, packed), fold, parts).reshape(width, width)
    return absorb(*fresh(), last)[1]


def _products(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, parts: int) -> np.ndarray:
    """Sums of products of all rows' centred projections, with the sums of the projections as a last row."""
    width, k = basis.shape

    def step(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = (x - mean) @ basis
        return state + np.vstack([p.T @ p, p.sum(0)])

    return _tree(_partials(rows, width, lambda: np.zeros((k + 1, k)), step, lambda s: s), lambda all_: np.sum(all_, 0), parts).reshape(k + 1, k)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; a row for each vector and component."""
    spark = embeddings.sparkSession
    rows, width = usable(embeddings)
    if not width:
        return spark.createDataFrame([], RESULT)
    vectors = rows.select("v")
    parts = vectors.rdd.getNumPartitions()
    x = F.floor(F.element_at("v", F.col("k")) * SCALE).cast("long") + SHIFT
    by_place = vectors.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(width)))).groupBy("k").agg(F.count("*").alias("n"), F.sum(x).alias("s")).orderBy("k").collect()
    n, sums = by_place[0]["n"], np.array([r["s"] for r in by_place], np.int64)
    mean = sums / n
    basis = spectrum(vectors, mean, parts)
    small = _products(vectors, mean, basis, parts)
    center = small[-1] / n
    inner = small[:-1] / n - np.outer(center, center)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * LEAST).sum()) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], RESULT)
    axes = axes[:, :kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)
    scaled = axes / np.sqrt(values[:kept])
    check = _products(vectors, mean, scaled, parts)
    error = float(np.abs(check[:-1] / n - np.outer(check[-1], check[-1]) / n**2 - np.eye(kept)).max())
    explained = values[:kept] / values.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                some = batch.slice(k, BLOCK)
                x, m = _matrix(some.column(1), width), some.num_rows
                with np.errstate(over="ignore"):
                    off = n * x - sums  # modulo 2**64, as are the squares: right where the result fits
                    deviation = (off * off).sum(1)
                fits = ((n * (x - mean)) ** 2).sum(1) < 2.0**63 * (1 - 1e-9)
                w = (x - mean) @ scaled
                each = lambda a: np.repeat(a, kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).cast(pa.int64()).take(pa.array(each(np.arange(m)))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)),
                        pa.array(each(deviation), mask=each(~fits)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                    ],
                    [f.split(" ")[0] for f in RESULT.split(", ")],
                )

    return rows.select("vec_id", "v").mapInArrow(run, RESULT)
