"""One distributed factorization serves projection, spectra, fits and covariances.

Rows ``[Q | H | y]`` of a window are reduced to a small triangular R (TSQR): a QR in
each task, then a QR of the stacked factors of each window. R's blocks hold the factor
of the projected H, the removed parts and the projected y.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounded import few


def _stack(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if r.shape[0] == r.shape[1] else r


def factor(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, n_rows, r``: the triangular factor of each key's rows, flattened by rows (null or non-finite rows are left out).

    At most one factor of each key leaves a task. The second step stacks as many
    small factors as there were tasks; it is done in two steps, dealt by a hash of the
    factors, so a task that runs again gives the same groups.
    """
    width = len(columns)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False):
                x = part[columns].to_numpy(float)
                x = x[np.isfinite(x).all(axis=1)]
                r, n = held.get(k, (None, 0))
                if len(x):
                    held[k] = _stack(r, x), n + len(x)
        yield pd.DataFrame([(k, n, r.ravel()) for k, (r, n) in held.items()], columns=[key, "n_rows", "r"])

    kind = f"{key} {dict(rows.dtypes)[key]}, n_rows long, r array<double>"

    parts = rows.select(key, *columns).mapInPandas(reduce, kind)
    half = parts.groupBy(key, F.pmod(F.xxhash64("n_rows", "r"), F.lit(16))).applyInPandas(lambda pdf: _merged(pdf, key, width), kind)
    return half.groupBy(key).applyInPandas(lambda pdf: _merged(pdf, key, width), kind)


def recombined(factors: DataFrame, key: str, settings: DataFrame, columns: Callable[[pd.Series], np.ndarray]) -> DataFrame:
    """``config_id, n_rows, r`` for every setting: a factor's columns times the matrix ``columns(setting)``.

    A setting that scales, adds or drops columns needs no rows again: the factor of ``X M`` is
    that of ``R M``. ``settings(config_id, ...)`` are rows; ``key`` names the one factor's key.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                m = columns(row)
                r = np.linalg.qr(np.asarray(row.r, float).reshape(-1, m.shape[0]) @ m, mode="r")
                rows.append((row.config_id, row.n_rows, np.vstack([r, np.zeros((m.shape[1] - r.shape[0], m.shape[1]))]).ravel()))
            yield pd.DataFrame(rows, columns=["config_id", "n_rows", "r"])

    return factors.drop(key).join(few(settings)).mapInPandas(run, "config_id long, n_rows long, r array<double>")


def _merged(pdf: pd.DataFrame, key: str, width: int) -> pd.DataFrame:
    """One factor of those of a key."""
    r = None
    for flat in pdf.r:
        r = _stack(r, np.asarray(flat, float).reshape(-1, width))
    if r.shape[0] < width:
        r = np.vstack([r, np.zeros((width - r.shape[0], width))])
    return pd.DataFrame({key: [pdf[key].iloc[0]], "n_rows": [int(pdf.n_rows.sum())], "r": [r.ravel()]})


def window_factors(rows: DataFrame, hour: str, columns: list[str], windows: DataFrame, length: int) -> DataFrame:
    """``window_id, n_rows, r`` of windows ``(window_id, start)`` of ``length`` hours that may overlap; each row is read once.

    The starts and ends of all windows cut time into disjoint blocks (twice as many as windows,
    which are a setting and few); rows are reduced to a factor of each block, and a window's
    factor is merged from those of its blocks. Windows without rows have no factor.
    """
    starts = windows.select("start").distinct().limit(100_001).collect()
    if len(starts) > 100_000:
        raise ValueError("more than 100,000 different windows")
    bounds = sorted({b for (s,) in starts for b in (s, s + length)})
    if not bounds:
        return rows.sparkSession.createDataFrame([], "window_id long, n_rows long, r array<double>")
    cuts = rows.sparkSession.createDataFrame([(bounds,)], "_bounds array<long>")
    place = lambda t: (F.size(F.filter("_bounds", lambda b: b <= t)) - 1).cast("long")
    own = rows.where((F.col(hour) >= bounds[0]) & (F.col(hour) < bounds[-1])).join(F.broadcast(cuts)).withColumn("_block", place(F.col(hour)))
    parts = factor(own, "_block", columns)
    covers = windows.join(F.broadcast(cuts)).select("window_id", F.explode(F.sequence(place(F.col("start")), place(F.col("start") + length) - 1)).alias("_block"))
    width = len(columns)
    return covers.join(parts, "_block").select("window_id", "n_rows", "r").groupBy("window_id").applyInPandas(lambda pdf: _merged(pdf, "window_id", width), "window_id long, n_rows long, r array<double>")


def whitened(rows: DataFrame, keys: list[str], place: str, columns: list[str], covariance: DataFrame) -> DataFrame:
    """``keys, place, columns``: the rows of each block (``keys``) with unit covariance, where theirs is ``covariance(i, j, v)`` at their places.

    A block is what noise ties together, such as an hour's sensors or a sensor's hours in a
    window; its observed rows take their own part of the matrix. Columns are multiplied by the
    inverse of the lower triangular factor, so factors of the result are those of the weighted
    problem. The matrix is a few numbers and goes to every task; it must be symmetric and
    positive definite at the places of every block, and hold all of them, else the job fails.
    Rows with a null or non-finite column are left out first; two rows at one place are an error.
    Blocks are sorted in their partitions and pass by in batches of many; rows that are already
    dealt by some of ``keys`` are not shuffled again.
    """
    table = covariance.select("i", "j", "v").limit(4_000_001).toPandas()
    if len(table) > 4_000_000:
        raise ValueError("a covariance of more than 4,000,000 entries")
    whole = table.pivot(index="i", columns="j", values="v").fillna(0.0)
    if list(whole.index) != list(whole.columns) or not np.allclose(whole, whole.T, rtol=1e-10, atol=0):
        raise ValueError("the covariance is not symmetric")
    shared = rows.sparkSession.sparkContext.broadcast((whole.index.to_numpy(), whole.to_numpy(float)))

    def white(part: pa.Table) -> pa.RecordBatch:
        places, full = shared.value
        own, nth = part[place].to_numpy(), part["_nth"].to_numpy()
        at = np.searchsorted(places, own)
        again = (at[1:] == at[:-1]) & (nth[1:] > 1)
        if again.any() or (at >= len(places)).any() or (places[np.minimum(at, len(places) - 1)] != own).any():
            raise ValueError("a block has a place twice, or one that the covariance lacks")
        x = np.column_stack([part[c].to_numpy() for c in columns])
        starts = np.flatnonzero(nth == 1)
        sizes = np.diff(starts, append=len(nth))
        for m in np.unique(sizes):  # blocks at the same places have one matrix, and are solved at once
            rows = starts[sizes == m][:, None] + np.arange(m)
            sets, which = np.unique(at[rows], axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            for held, blocks in zip(sets, np.split(rows[order], np.cumsum(np.bincount(which.ravel()))[:-1])):
                try:
                    low = np.linalg.cholesky(full[np.ix_(held, held)])
                except np.linalg.LinAlgError:
                    raise ValueError("the covariance is not positive definite") from None
                x[blocks] = np.linalg.solve(low, x[blocks].transpose(1, 0, 2).reshape(m, -1)).reshape(m, len(blocks), -1).transpose(1, 0, 2)
        kept = [part[c] for c in part.column_names if c not in (*columns, "_nth")]
        return pa.Table.from_arrays([*kept, *map(pa.array, x.T)], names=[*keys, place, *columns]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, parts, held = len(shared.value[0]), [], 0  # of the last block, which may go on in the next batch
        for batch in batches:
            starts = np.flatnonzero(batch.column("_nth").to_numpy() == 1)
            if len(starts):
                if held or starts[-1]:
                    yield white(pa.Table.from_batches([*parts, batch.slice(0, starts[-1])]))
                parts, held, batch = [], 0, batch.slice(starts[-1])
            parts, held = [*parts, batch], held + batch.num_rows
            if held > most:
                raise ValueError("a block has a place twice, or one that the covariance lacks")
        if held:
            yield white(pa.Table.from_batches(parts))

    own = rows.where(finite(columns)).select(*keys, place, *[F.col(c).cast("double").alias(c) for c in columns])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(place))
    return own.withColumn("_nth", nth).mapInArrow(run, own.schema)


def tolerance(x: np.ndarray, n_rows: int) -> float:
    """Singular values up to this are rounding: ``n_rows`` rows were reduced to the small ``x``, so their number counts and not that of ``x``."""
    sigma = np.linalg.svd(x, compute_uv=False)
    return max(n_rows, x.shape[1]) * np.finfo(float).eps * sigma.max(initial=0.0)


def independent(x: np.ndarray, n_rows: int) -> list[int]:
    """Columns that don't depend on those before them (prefix rank, one tolerance for all prefixes)."""
    tol, keep = tolerance(x, n_rows), []
    for j in range(x.shape[1]):
        if (np.linalg.svd(x[:, [*keep, j]], compute_uv=False) > tol).sum() > len(keep):
            keep.append(j)
    return keep


def split(r, n_q: int, n_h: int, n_rows: int) -> dict[str, np.ndarray]:
    """Blocks of a factor of ``[Q | H | y]`` of ``n_rows`` rows; dependent background columns are dropped first."""
    r = np.asarray(r, float).reshape(-1, n_q + n_h + 1)
    keep = independent(r[:, :n_q], n_rows)
    r = np.linalg.qr(r[:, [*keep, *range(n_q, n_q + n_h + 1)]], mode="r")
    q = len(keep)
    return {"kept": np.array(keep, int), "qq": r[:q, :q], "qh": r[:q, q : q + n_h], "qy": r[:q, -1], "hh": r[q : q + n_h, q : q + n_h], "hy": r[q : q + n_h, -1], "yy": r[q + n_h :, -1]}


def background_report(rows: DataFrame, key: str, q: list[str], targets: list[str], cap: int = 8, stress: tuple[str, ...] = ()) -> DataFrame:
    """``key, rank, dependent list, within_cap, orthogonality, idempotence`` of each background, measured on the projected rows.

    A column that depends on those before it is named as dependent (prefix rank). Columns
    named as stress don't count towards the cap. One pass over the projected rows sums the
    products of background and what is left of each target: orthogonality is the largest of
    them by a unit direction, idempotence the norm of what projecting again would remove,
    both relative to the target.
    """
    n, m, stressed = len(q), len(targets), [c in stress for c in q]
    factors = rows.select(key, *q, *targets).transform(lambda df: factor(df, key, [*q, *targets]))
    kept = project(rows, key, q, targets)
    ok = finite(q + targets)
    left = kept.where(ok).groupBy(key).agg(
        F.array(*[F.sum(F.col(c) * F.col(f"{t}_t")) for t in targets for c in q]).alias("_s"), F.array(*[F.sqrt(F.sum(F.col(t) * F.col(t))) for t in targets]).alias("_n")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, n_rows, flat, sums, norms in zip(pdf[key], pdf.n_rows, pdf.r, pdf._s, pdf._n):
                s = split(flat, n, m - 1, n_rows)
                keep = s["kept"].tolist()
                z = np.linalg.solve(s["qq"].T, np.asarray(sums, float).reshape(m, n).T[keep]) if keep else np.zeros((0, m))
                size = np.maximum(np.asarray(norms, float), 1e-300)
                counted = sum(not stressed[j] for j in keep)
                out.append((k, len(keep), [q[j] for j in range(n) if j not in keep], counted <= cap, float((np.abs(z) / size).max(initial=0.0)), float((np.sqrt((z**2).sum(axis=0)) / size).max(initial=0.0))))
            yield pd.DataFrame(out, columns=[key, "rank", "dependent", "within_cap", "orthogonality", "idempotence"])

    kind = f"{key} {dict(factors.dtypes)[key]}, rank int, dependent array<string>, within_cap boolean, orthogonality double, idempotence double"
    return factors.join(left, key).mapInPandas(run, kind)


def finite(columns: list[str]) -> Column:
    """Rows that a factor takes: none of the columns null, NaN or infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return ok


def projector(factors: DataFrame, key: str, q: list[str], targets: list[str]) -> DataFrame:
    """``key, target, b array``: coefficients of each target on the background columns."""
    n = len(q)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n_rows, flat in zip(pdf[key], pdf.n_rows, pdf.r):
                s = split(flat, n, len(targets) - 1, n_rows)
                right = np.column_stack([s["qh"], s["qy"]])
                b = np.zeros((n, len(targets)))
                b[s["kept"]] = np.linalg.solve(s["qq"], right) if len(s["kept"]) else right
                rows += [(k, t, b[:, j]) for j, t in enumerate(targets)]
            yield pd.DataFrame(rows, columns=[key, "target", "b"])

    return factors.mapInPandas(run, f"{key} {dict(factors.dtypes)[key]}, target string, b array<double>")


def project(rows: DataFrame, key: str, q: list[str], targets: list[str], factors: DataFrame | None = None) -> DataFrame:
    """Rows with ``<target>_t`` (background removed) and ``<target>_r`` (what was removed).

    The coefficients are a few numbers a window and are joined by it. ``factors`` of the same
    rows ``[q | targets]`` save the pass that makes them.
    """
    b = projector(factor(rows, key, [*q, *targets]) if factors is None else factors, key, q, targets).groupBy(key).pivot("target", targets).agg(F.first("b"))
    b = b.select(key, *[F.col(t).alias(f"_{t}") for t in targets])
    out = rows.join(b, key)
    removed = {f"{t}_r": sum((F.col(c) * F.col(f"_{t}")[i] for i, c in enumerate(q)), F.lit(0.0)) for t in targets}
    out = out.withColumns(removed)
    return out.withColumns({f"{t}_t": F.col(t) - F.col(f"{t}_r") for t in targets}).drop(*[f"_{t}" for t in targets])


def projected_gram(factors: DataFrame, key: str, n_q: int, n_h: int) -> DataFrame:
    """``key, i, j, g`` for i <= j of the columns with the background removed, from the factors alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = np.triu_indices(n_h)
        for pdf in batches:
            for k, n_rows, flat in zip(pdf[key], pdf.n_rows, pdf.r):
                hh = split(flat, n_q, n_h, n_rows)["hh"]
                yield pd.DataFrame({key: k, "i": i, "j": j, "g": (hh.T @ hh)[i, j]})

    return factors.mapInPandas(run, f"{key} {dict(factors.dtypes)[key]}, i int, j int, g double")


def demeaned(rows: DataFrame, key: str, *targets: str) -> DataFrame:
    """The constant background: each window's mean removed."""
    own = Window.partitionBy(key)
    return rows.withColumns({f"{t}_t": F.col(t) - F.avg(t).over(own) for t in targets})


def diagnostics(factors: DataFrame, key: str, n_q: int, n_h: int, tau_sigma: float | None = None) -> DataFrame:
    """Spectrum, ranks, smallest singular value (0 if rank deficient), condition and visibility, from R."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n, flat in zip(pdf[key], pdf.n_rows, pdf.r):
                hh = split(flat, n_q, n_h, n)["hh"]
                sigma = np.zeros(n_h)
                found = np.linalg.svd(hh, compute_uv=False)
                sigma[: len(found)] = found
                tau = max(n, n_h) * np.finfo(float).eps * sigma[0]
                rank, eff = int((sigma > tau).sum()), int((sigma > (tau if tau_sigma is None else tau_sigma)).sum())
                full = rank == n_h
                rows.append((k, n, sigma, rank, eff, sigma[-1] if full else 0.0, sigma[0] / sigma[-1] if full and sigma[-1] > 0 else None, np.sqrt((hh**2).sum(axis=0))))
            yield pd.DataFrame(rows, columns=[key, "n_rows", "spectrum", "rank", "effective_rank", "sigma_j", "condition", "visibility"])

    return factors.mapInPandas(run, f"{key} {dict(factors.dtypes)[key]}, n_rows long, spectrum array<double>, rank int, effective_rank int, sigma_j double, condition double, visibility array<double>")


def gram(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, i, j, g`` for i <= j: one pass of sums over wide rows, combined before the shuffle."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.groupBy(key).agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs])
    return sums.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("g")) for i, j in pairs])).alias("x")).select(key, "x.*")


def coherence(gram_: DataFrame, key: str, weak: float = 0.0, ambiguous: float = 0.99) -> DataFrame:
    """``key, i, j, coherence, ray_distance, ambiguous`` of pairs i < j; null if either column is weak or zero."""
    norms = gram_.where("i = j").select(key, "i", F.sqrt("g").alias("v"))
    out = gram_.where("i < j").join(norms.withColumnRenamed("v", "vi"), [key, "i"]).join(norms.select(key, F.col("i").alias("j"), F.col("v").alias("vj")), [key, "j"])
    seen = (F.col("vi") > weak) & (F.col("vj") > weak)
    rho = F.when(seen, F.least(F.lit(1.0), F.abs("g") / (F.col("vi") * F.col("vj"))))
    return out.withColumn("coherence", rho).withColumn("ray_distance", F.sqrt(1 - F.col("coherence") ** 2)).withColumn("ambiguous", F.coalesce(F.col("coherence") > ambiguous, F.lit(False))).select(key, "i", "j", "coherence", "ray_distance", "ambiguous")


def weak_columns(gram_: DataFrame, key: str, limit: float, sources: DataFrame) -> DataFrame:
    """``key, source, weak list, all_weak``; ``sources(i, source, name)``."""
    own = gram_.where("i = j").select(key, "i", (F.sqrt("g") <= limit).alias("weak")).join(few(sources), "i")
    return own.groupBy(key, "source").agg(F.array_sort(F.collect_list(F.when(F.col("weak"), F.col("name")))).alias("weak"), F.bool_and("weak").alias("all_weak"))


def absorption(rows: DataFrame, key: str, columns: list[str], floor: float = 2.220446049250313e-16) -> DataFrame:
    """``key, name, absorbed, visible``: norms of the removed and the projected part over the whole; null where the whole vanishes."""
    sums = rows.groupBy(key).agg(*[F.sqrt(F.sum(F.col(c + s) ** 2)).alias(c + s + "_n") for c in columns for s in ("", "_r", "_t")])
    ratio = lambda c, s: F.when(F.col(c + "_n") > floor, F.col(c + s + "_n") / F.col(c + "_n"))
    return sums.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), ratio(c, "_r").alias("absorbed"), ratio(c, "_t").alias("visible")) for c in columns])).alias("x")).select(key, "x.*")


def fixed_zero_map(columns: DataFrame, zeros: DataFrame) -> DataFrame:
    """``col_idx, reduced_idx``: numbers after the fixed-zero columns are taken out, -1 for those; an unknown or repeated zero is an error."""
    if zeros.count() != zeros.distinct().count() or not zeros.join(columns, "col_idx", "left_anti").isEmpty():
        raise ValueError("fixed-zero columns are unknown or repeated")
    kept = columns.join(zeros, "col_idx", "left_anti").withColumn("reduced_idx", F.row_number().over(Window.orderBy("col_idx")).cast("long") - 1)
    return columns.join(kept, "col_idx", "left").withColumn("reduced_idx", F.coalesce("reduced_idx", F.lit(-1).cast("long")))


def strongest_across(pairs: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """What strongest() gives, of pairs of different sources alone; ``columns(col_idx, source_idx)``."""
    named = lambda side: columns.select(F.col("col_idx").alias(side), F.col("source_idx").alias(f"_s{side}"))
    return strongest(pairs.join(named("i"), "i").join(named("j"), "j").where("_si <> _sj"), key)


def strongest(pairs: DataFrame, key: str) -> DataFrame:
    """The pair of highest coherence and the one of smallest ray distance, first on ties."""
    known = pairs.where("coherence is not null")
    return known.groupBy(key).agg(
        F.max("coherence").alias("coherence"), F.max_by(F.struct("i", "j"), F.struct("coherence", -F.col("i"), -F.col("j"))).alias("most"), F.min_by(F.struct("i", "j"), F.struct("ray_distance", "i", "j")).alias("nearest")
    ).select(key, "coherence", F.col("most.i").alias("i"), F.col("most.j").alias("j"), F.col("nearest.i").alias("near_i"), F.col("nearest.j").alias("near_j"))


def background(panel: DataFrame, degree: int = 1, harmonics: int = 1, offsets: bool = False, days: bool = False) -> DataFrame:
    """Long background ``t_idx, sensor_idx, name, q`` of ``panel(t_idx, sensor_idx, ts)``: constant, powers of standardized elapsed hours, daily sines and cosines of the local clock, reference-coded sensors and days."""
    stats = panel.agg(F.avg("t_idx").alias("_m"), F.stddev_pop("t_idx").alias("_s"))
    z = (F.col("t_idx") - F.col("_m")) / F.when(F.col("_s") > 2.220446049250313e-16, F.col("_s")).otherwise(1.0)
    hour = F.hour("ts") + F.minute("ts") / 60.0
    columns: list[tuple[Column, Column]] = [(F.lit("constant"), F.lit(1.0))] + [(F.lit(f"time_{d}"), F.pow(z, F.lit(float(d)))) for d in range(1, degree + 1)]
    for k in range(1, harmonics + 1):
        angle = 2 * F.pi() * k * hour / 24.0
        columns += [(F.lit(f"sin_{k}"), F.sin(angle)), (F.lit(f"cos_{k}"), F.cos(angle))]
    own = panel.join(F.broadcast(stats))
    out = own.select("t_idx", "sensor_idx", F.explode(F.array(*[F.struct(n.alias("name"), q.alias("q")) for n, q in columns])).alias("x")).select("t_idx", "sensor_idx", "x.*")
    for on, of, prefix in ((offsets, F.col("sensor_idx"), "sensor_"), (days, F.to_date("ts"), "day_")):
        if on:
            levels = panel.select(of.alias("level")).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("level"))).where("rank > 1")
            out = out.unionByName(panel.join(few(levels), of == F.col("level")).select("t_idx", "sensor_idx", F.concat(F.lit(prefix), F.col("rank").cast("string")).alias("name"), F.lit(1.0).alias("q")))
    return out


def trends(panel: DataFrame, sites: DataFrame) -> DataFrame:
    """Background columns ``x_trend`` and ``y_trend``: coordinates of ``sites(sensor_idx, sx, sy)``, standardized over the rows (a spread below the floor counts as 1)."""
    own = panel.select("t_idx", "sensor_idx").join(sites, "sensor_idx")
    stats = own.agg(*[f(c).alias(f"_{n}{c}") for c in ("sx", "sy") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 2.220446049250313e-16, F.col(f"_s{c}")).otherwise(1.0)
    rows = F.array(F.struct(F.lit("x_trend").alias("name"), z("sx").alias("q")), F.struct(F.lit("y_trend").alias("name"), z("sy").alias("q")))
    return own.join(F.broadcast(stats)).select("t_idx", "sensor_idx", F.explode(rows).alias("x")).select("t_idx", "sensor_idx", "x.*")


def with_user_columns(background_: DataFrame, user: DataFrame) -> DataFrame:
    """A user's background columns beside the built ones; names must be new and values finite."""
    if not user.select("name").distinct().join(background_.select("name").distinct(), "name", "left_semi").isEmpty() or not user.where("q is null or isnan(q)").isEmpty():
        raise ValueError("user columns repeat a name or are not finite")
    return background_.unionByName(user.select(background_.columns))


def variants(primary: DataFrame, first_response: DataFrame) -> DataFrame:
    """Backgrounds with ``variant``: none has no rows; primary; redundant (a copy of its first column); stress (a unit copy of a response column)."""
    norm = first_response.agg(F.sqrt(F.sum(F.col("h") ** 2)).alias("_n"))
    stress = first_response.join(F.broadcast(norm)).select("t_idx", "sensor_idx", F.lit("stress").alias("name"), (F.col("h") / F.col("_n")).alias("q"))
    tag = lambda df, v: df.withColumn("variant", F.lit(v))
    copy = primary.where("name = 'constant'").withColumn("name", F.lit("constant_copy"))
    return tag(primary, "primary").unionByName(tag(primary.unionByName(copy), "redundant")).unionByName(tag(primary.unionByName(stress), "stress"))
