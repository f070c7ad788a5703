"""Nonnegative fits, their uncertainty, and summaries of residuals and ensembles.

A fit works on the small factor of each key (see :mod:`factor`), so thousands of
windows, scenarios and members are rows of one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounded import few
from .factor import split


def nonnegative(a: np.ndarray, y: np.ndarray, lam: float = 0.0, prior: np.ndarray | None = None, most: int = 10_000, kkt: float = 1e-6, rel: float = 1e-12) -> tuple[np.ndarray, dict]:
    """min over c >= 0 of |a c - y|^2 + lam |c - prior|^2 by accelerated projected gradients with restarts, then solved exactly on its active set."""
    n = a.shape[1]
    prior = np.zeros(n) if prior is None else prior
    g, b = a.T @ a + lam * np.eye(n), a.T @ y + lam * prior
    top = np.linalg.eigvalsh(g)[-1] if n else 0.0
    c = z = np.zeros(n)
    t, before, done, rounds = 1.0, np.inf, False, 0
    cost = lambda v: float(v @ g @ v - 2 * b @ v)
    for rounds in range(1, most + 1):  # noqa: B007
        if top <= 0:
            done = True
            break
        new = np.maximum(0.0, z - (g @ z - b) / top)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - c)
        if cost(new) > before:
            z, t_new = new, 1.0
        now, grad = cost(new), g @ new - b
        slack = np.abs(np.where(new > 0, grad, np.minimum(grad, 0))).max(initial=0.0)
        done = slack <= kkt * max(1.0, np.abs(b).max(initial=0.0)) and abs(before - now) <= rel * max(1.0, abs(now))
        c, t, before = new, t_new, now
        if done:
            break
    on = c > 1e-8
    if on.any():
        c = polished(a, y, lam, prior, c, on, cost)
    return c, {"converged": done, "iterations": rounds}


def nonnegative_many(a: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Columns c >= 0 that minimise |a c - y|^2 for each column of ``y``: exchanges of active sets, one least-squares solve for all columns with the same set.

    A column whose exchanges don't settle (they can circle where columns of ``a`` depend on each other) is fitted by nonnegative().
    """
    n, k = a.shape[1], y.shape[1]
    on, c, grad = np.zeros((n, k), bool), np.zeros((n, k)), -a.T @ y
    tol = 1e-10 * max(1.0, np.abs(grad).max(initial=0.0))
    fewest, spare, open_ = np.full(k, n + 1), np.full(k, 3), np.ones(k, bool)
    for _ in range(rounds):
        bad = ((c < -1e-12) & on | (grad < -tol) & ~on) & open_
        many = bad.sum(axis=0)
        open_ = many > 0
        if not open_.any():
            break
        better = open_ & (many < fewest)
        fewest[better], spare[better] = many[better], 3
        tired = open_ & ~better & (spare <= 0)
        spare[open_ & ~better] -= 1
        for j in np.flatnonzero(tired):  # one exchange at a time ends surely
            last = np.flatnonzero(bad[:, j])[-1]
            bad[:, j] = False
            bad[last, j] = True
        on ^= bad
        sets, which = np.unique(on[:, open_], axis=1, return_inverse=True)
        for s in range(sets.shape[1]):
            at = np.flatnonzero(open_)[which.ravel() == s]
            own = np.flatnonzero(sets[:, s])
            c[:, at] = 0.0
            if len(own):
                c[np.ix_(own, at)] = np.linalg.lstsq(a[:, own], y[:, at])[0]
            grad[:, at] = a.T @ (a @ c[:, at] - y[:, at])
    for j in np.flatnonzero(open_):
        c[:, j] = nonnegative(a, y[:, j])[0]
    return np.maximum(c, 0.0)


def polished(a: np.ndarray, y: np.ndarray, lam: float, prior: np.ndarray, c: np.ndarray, on: np.ndarray, cost) -> np.ndarray:
    """The exact solution on an active set, from the columns themselves (their products would square the condition number); ``c`` if it isn't better."""
    rows = np.vstack([a[:, on], np.sqrt(lam) * np.eye(int(on.sum()))]) if lam else a[:, on]
    x, _, rank, _ = np.linalg.lstsq(rows, np.concatenate([y, np.sqrt(lam) * prior[on]]) if lam else y)
    exact = np.zeros(len(c))
    exact[on] = x
    return exact if rank == on.sum() and (exact >= 0).all() and cost(exact) <= cost(c) + 1e-12 * abs(cost(c)) else c


def fit(factors: DataFrame, key: str, n_q: int, names: list[str], lam: float = 0.0, prior: list[float] | None = None, zeros: list[int] | None = None, raw: bool = False, noise: float | None = None) -> DataFrame:
    """``key, name, c, std, std_naive, residual_norm, converged, warning``: one fit for each factor.

    ``zeros`` are columns held at exactly 0. ``raw`` fits without removing the
    background. ``std`` comes from the active set's covariance and the rows that
    background and columns leave; ``std_naive`` from the rows less the active columns,
    or from a given ``noise``, without the penalty.
    """
    n_h, off = len(names), set(zeros or [])
    free = [j for j in range(n_h) if j not in off]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n, flat in zip(pdf[key], pdf.n_rows, pdf.r):
                if raw:
                    own = np.asarray(flat, float).reshape(-1, n_q + n_h + 1)
                    a, y = own[:, [n_q + j for j in free]], own[:, -1]
                    used = 0
                else:
                    s = split(flat, n_q, n_h, n)
                    a, y, used = np.vstack([s["hh"], np.zeros((len(s["yy"]), n_h))])[:, free], np.concatenate([s["hy"], s["yy"]]), len(s["kept"])
                p = None if prior is None else np.asarray(prior, float)[free]
                c, how = nonnegative(a, y, lam, p)
                res = float(np.sqrt(((a @ c - y) ** 2).sum()))
                sigma = np.linalg.svd(a, compute_uv=False)
                rank = int((sigma > max(n, n_h) * np.finfo(float).eps * sigma.max(initial=0)).sum())
                on = c > 1e-8
                std, naive = np.zeros(len(c)), np.zeros(len(c))
                if on.any():
                    plain = (noise**2 if noise is not None else res**2 / max(n - int(on.sum()), 1)) * np.linalg.pinv(a[:, on].T @ a[:, on])
                    naive[on] = np.sqrt(np.maximum(0, np.diag(plain)))
                    cov = res**2 / max(n - used - rank, 1) * np.linalg.pinv(a[:, on].T @ a[:, on] + lam * np.eye(int(on.sum())))
                    std[on] = np.sqrt(np.maximum(0, np.diag(cov)))
                warn = "rank_deficient" if rank < len(free) else "ill_conditioned" if sigma[-1:].min(initial=1) > 0 and sigma[0] / sigma[-1] > 1e8 else "not_converged" if not how["converged"] else None
                whole, err, plain_err = np.zeros(n_h), np.zeros(n_h), np.zeros(n_h)
                whole[free], err[free], plain_err[free] = c, std, naive
                rows += [(k, name, whole[j], err[j], plain_err[j], res, bool(how["converged"]), warn) for j, name in enumerate(names)]
            yield pd.DataFrame(rows, columns=[key, "name", "c", "std", "std_naive", "residual_norm", "converged", "warning"])

    return factors.mapInPandas(run, f"{key} {dict(factors.dtypes)[key]}, name string, c double, std double, std_naive double, residual_norm double, converged boolean, warning string")


def residual_summary(residuals: DataFrame, *keys: str) -> DataFrame:
    """Root mean square and count of ``residuals(keys, r)``."""
    return residuals.groupBy(*keys).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"), F.count("*").alias("n"))


def autocorrelation(residuals: DataFrame, key: str) -> DataFrame:
    """Lag-1 autocorrelation in row order (time-major across sensors) of each window; 0 if undefined."""
    nxt = F.lead("r").over(Window.partitionBy(key).orderBy("t_idx", "sensor_idx"))
    return residuals.withColumn("_n", nxt).groupBy(key).agg(F.coalesce(F.sum(F.col("r") * F.col("_n")) / F.nullif(F.sum(F.col("r") * F.col("r")), F.lit(0.0)), F.lit(0.0)).alias("lag1"))


def objective(rows: DataFrame, key: str, coefficients: DataFrame, lam: float, prior: float) -> DataFrame:
    """``key, data, penalty, total`` of ``rows(key, row_id, name, h, y)`` and ``coefficients(key, name, c)``.

    Coefficients are few and go to the rows, of which a key and name may have very many.
    """
    fitted = rows.join(few(coefficients), [key, "name"]).groupBy(key, "row_id").agg((F.sum(F.col("h") * F.col("c")) - F.first("y")).alias("r"))
    data = fitted.groupBy(key).agg(F.sum(F.col("r") * F.col("r")).alias("data"))
    penalty = coefficients.groupBy(key).agg((lam * F.sum((F.col("c") - prior) ** 2)).alias("penalty"))
    return data.join(penalty, key).withColumn("total", F.col("data") + F.col("penalty"))


def ensemble_intervals(members: DataFrame, *keys: str, value: str = "c") -> DataFrame:
    """Quantiles 0.05, 0.5, 0.95 (linear) over the members of each key."""
    q = F.expr(f"percentile({value}, array(0.05, 0.5, 0.95))")
    return members.groupBy(*keys).agg(q.alias("_q"), F.count("*").alias("n")).select(*keys, *[F.col("_q")[i].alias(x) for i, x in enumerate(("q05", "q50", "q95"))], "n")


def scenario_rows(members: DataFrame) -> DataFrame:
    """Inventory scenarios side by side; an error if kinds are mixed or columns differ among scenarios."""
    kinds = members.agg(F.count_distinct("ensemble_kind").alias("k")).first().k
    shapes = members.groupBy("scenario").agg(F.sort_array(F.collect_set("name")).alias("names")).select("names").distinct().count()
    if kinds > 1 or shapes > 1:
        raise ValueError("ensemble kinds or columns are mixed")
    return members.groupBy("scenario").pivot("name").agg(F.first("c"))


def recovery(estimate: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Relative error of coefficients, of totals, and the L2 error of shares; ``(keys, name, c)`` against ``(name, c)``."""
    both = estimate.join(truth.withColumnRenamed("c", "c0"), "name")
    own = Window.partitionBy(*keys)
    both = both.withColumns({"s": F.col("c") / F.nullif(F.sum("c").over(own), F.lit(0.0)), "s0": F.col("c0") / F.nullif(F.sum("c0").over(own), F.lit(0.0))})
    norm = lambda x: F.sqrt(F.sum(x * x))
    return both.groupBy(*keys).agg(
        (norm(F.col("c") - F.col("c0")) / F.greatest(norm(F.col("c0")), F.lit(1e-12))).alias("coefficient_error"),
        (F.abs(F.sum("c") - F.sum("c0")) / F.greatest(F.abs(F.sum("c0")), F.lit(1e-12))).alias("total_error"), norm(F.coalesce("s", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0))).alias("share_error"),
    )
