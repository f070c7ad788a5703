"""Whitening of vectors by their leading principal components, found by contour integration.

The covariance of the different vectors is summed over the cluster; its size is that of a
vector squared. Eigenvalues are searched in intervals: how many lie above a bound is read off
the signs of a triangular factorization of the shifted covariance (inertia). For each interval
that has wanted ones, a contour around it is put in the complex plane and (zI - V)^-1 applied to
a block of vectors at the points of a Gauss rule (one Spark task for each interval). The sum
projects the block onto the interval's eigenvectors, a Rayleigh-Ritz step extracts them, and
inertia says that none was missed. Projection of all rows and the check of the result are
further passes over the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Points of the Gauss rule on the upper half of a contour; rounds at most.
POINTS, ROUNDS = 12, 40
#: The longest vectors: a task holds some complex matrices of this size squared.
LONGEST = 1024


def whole_numbers(vector: str, scale: float) -> Column:
    """floor(scale * x) of each entry, as long; null where the vector is null or holds null or non-finite entries."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))))


def above(v: np.ndarray, bound: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``bound``: positive pivots of V - bound I = L D L' (Bunch-Kaufman, 1 x 1 and 2 x 2 blocks)."""
    a = v - bound * np.eye(len(v))
    n, k, count = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        step, p = 1, k
        if k < n - 1:
            low = np.abs(a[k + 1 :, k])
            r = k + 1 + int(low.argmax())
            most = low[r - k - 1]
            if most > 0 and abs(a[k, k]) < alpha * most:
                row = np.abs(a[r, k:]).copy()
                row[r - k] = 0
                sigma = row.max()
                if abs(a[k, k]) * sigma >= alpha * most**2:
                    pass
                elif abs(a[r, r]) >= alpha * sigma:
                    p = r
                else:
                    step, p = 2, r
        q = k + step - 1
        if p != q:
            a[[q, p]] = a[[p, q]]
            a[:, [q, p]] = a[:, [p, q]]
        block = a[k : k + step, k : k + step]
        if step == 1:
            count += int(block[0, 0] > 0)
        else:
            det, trace = np.linalg.det(block), np.trace(block)
            count += 1 if det < 0 else 2 * int(trace > 0)
        rest = slice(k + step, n)
        if k + step < n and np.abs(block).max() > 0:
            low = a[rest, k : k + step]
            a[rest, rest] -= low @ np.linalg.solve(block, low.T)
        k += step
    return count


def bounds(v: np.ndarray, wanted: int, slices: int = 1) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count) that together hold the ``wanted`` largest eigenvalues (more where they lie too close), none of them near an end.

    Bounds are bisected by inertia and then moved into the widest gap nearby, so that no end cuts a cluster.
    """
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin
    floor = top * len(v) * np.finfo(float).eps * 4
    wanted = min(wanted, above(v, floor))
    if not wanted:
        return []

    def below(n: int) -> float:
        """A bound with n eigenvalues above it, about the middle of the gap; ties move it down to the next gap."""
        while n < len(v):
            low, high = 0.0, top  # more than n above the one, fewer above the other
            while high - low > 1e-10 * top:
                mid = (low + high) / 2
                m = above(v, mid)
                if m == n:
                    under, over = mid, mid
                    for _ in range(4):  # the ends of the gap, roughly
                        a, b = (low + under) / 2, (over + high) / 2
                        low, under = (low, a) if above(v, a) == n else (a, under)
                        over, high = (b, high) if above(v, b) == n else (over, b)
                    return max((under + over) / 2, floor)
                low, high = (mid, high) if m > n else (low, mid)
            n += 1
        return floor

    cuts, done, out = [top], 0, []
    share = -(-wanted // slices)
    while done < wanted:
        low = below(min(done + share, wanted))
        n = above(v, low)
        out.append((low, cuts[-1], n - done))
        cuts.append(low)
        done = n
    return out


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high), falling, and their unit eigenvectors as columns.

    ``count`` is what inertia found there; the block is half as large again. An error is raised
    if, after all rounds, the number found differs or a residual exceeds rounding.
    """
    d = len(v)
    width = min(d, max(count + 2, -(-3 * count // 2)))
    block = np.random.default_rng(seed).standard_normal((d, width))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = -np.pi / 2 * (nodes - 1)  # upper half of an ellipse; the lower half is its mirror image
    middle, radius, flat = (low + high) / 2, (high - low) / 2, 0.5
    size = np.abs(v).sum(axis=1).max()
    best = None
    for _ in range(ROUNDS):
        total = np.zeros((d, width))
        for angle, weight in zip(angles, weights):
            z = middle + radius * (np.cos(angle) + 1j * flat * np.sin(angle))
            slope = radius * (flat * np.cos(angle) + 1j * np.sin(angle))
            total += weight / 2 * (slope * np.linalg.solve(z * np.eye(d) - v, block.astype(complex))).real
        basis, values, _ = np.linalg.svd(total, full_matrices=False)
        basis = basis[:, values > values[0] * np.finfo(float).eps * d]
        e, u = np.linalg.eigh(basis.T @ v @ basis)
        own = (e > low) & (e < high)
        vectors = basis @ u
        x = vectors[:, own][:, ::-1]
        x /= np.linalg.norm(x, axis=0)
        rest = np.linalg.norm(v @ x - x * e[own][::-1], axis=0).max(initial=0.0) if own.sum() == count else np.inf
        if best is None or rest < best[0]:
            best = rest, e[own][::-1], x
        elif np.isfinite(best[0]) and best[0] <= 64 * d * np.finfo(float).eps * size:
            break  # no round improves it any more
        block = vectors
        if block.shape[1] < width:
            block = np.hstack([block, np.random.default_rng(seed + 1).standard_normal((d, width - block.shape[1]))])
    if best is None or not best[0] <= 64 * d * np.finfo(float).eps * size:
        raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, not all were found: residual {best and best[0]}")
    return best[1], best[2]


def _moments(rows: DataFrame, d: int, centre: np.ndarray | None, axes: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of the centred rows (projected on ``axes`` first), divided by nothing: partial sums leave each task, entries are added by Spark."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                y = np.array(pdf["x"].iloc[at : at + 4096].tolist(), float) - centre
                y = y if axes is None else y @ axes
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    n = d if axes is None else axes.shape[1]
    out = np.zeros((n, n))
    for r in rows.mapInPandas(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def components(spark, v: np.ndarray, wanted: int, slices: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding, falling, and their vectors as columns; each interval's contour is a task."""
    parts = bounds(v, wanted, slices)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    shared = spark.sparkContext.broadcast(v)  # at most LONGEST squared

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                e, x = contour(shared.value, r.low, r.high, r.count_)
                yield pd.DataFrame({"e": e, "x": list(x.T)})

    asked = spark.createDataFrame(pd.DataFrame(parts, columns=["low", "high", "count_"]), "low double, high double, count_ long").repartition(len(parts), "low")
    rows = sorted(asked.mapInPandas(work, "e double, x array<double>").collect(), key=lambda r: -r.e)
    shared.unpersist()
    if len(rows) != sum(p[2] for p in parts):
        raise ArithmeticError("eigenvalues are missing")
    rows = rows[:wanted]
    return np.array([r.e for r in rows]), np.array([r.x for r in rows]).T


def whiten(vectors: DataFrame, key: str, vector: str, wanted: int = 4, scale: float = 256.0) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Entries become x = floor(scale * entry). The fit list has each different x once: n vectors
    with sums S. Components are eigenvectors of its covariance (divisor n), from 1 by falling
    eigenvalue; each has its largest entry positive (the first of equals). ``deviation`` is the
    sum over dimensions of (n x - S)^2, null where it exceeds a long. Rows whose vector is null or
    holds null or non-finite entries are left out; so are vectors whose length isn't the most
    frequent one (of equals, the longest). Repeated rows and null ids have rows of their own.
    Components of no variance are left out, so equal vectors alone, or an empty table, give no
    rows. Other columns are not looked at.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("x")).where("x is not null and size(x) > 0")
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit, drop = written(rows.select("x").distinct())
    try:
        length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if length is None:
            return spark.createDataFrame([], schema)
        d = length.d
        if d > LONGEST:
            raise ValueError(f"vectors of {d} entries; at most {LONGEST}")
        fit = fit.where(F.size("x") == d)
        sums = {r.i: r.s for r in fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
        n, total = length["count"], [int(sums[i]) for i in range(d)]
        centre = np.array([float(s) / n for s in total])
        v = _moments(fit, d, centre) / n
        e, u = components(spark, v, wanted)
        u = u * np.array([1.0 if c[np.argmax(np.abs(c))] > 0 else -1.0 for c in u.T] or [1.0])[: u.shape[1]]
        axes = u / np.sqrt(e)
        error = float(np.abs(_moments(fit, d, centre, axes) / n - np.eye(len(e))).max(initial=0.0)) if len(e) else 0.0
        share = e / np.trace(v) if len(e) else e
    finally:
        drop()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, narrow = len(e), max(map(abs, total)) < 2**62
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
                small = ((n * x.astype(float) - np.array(total, float)) ** 2).sum(axis=1) < 2.0**62
                near = ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1) if narrow else np.zeros(len(x), np.int64)
                exact = [int(y) if ok and narrow else sum((n * int(a) - s) ** 2 for a, s in zip(r, total)) for y, ok, r in zip(near, small, x)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                    pa.array([y if y < 2**63 else None for y in exact for _ in range(k)], pa.int64()), pa.array(((x - centre) @ axes).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(work, schema) if len(e) else spark.createDataFrame([], schema)
