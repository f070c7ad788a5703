"""Residual adequacy by a refitted parametric bootstrap, and summaries of its p-values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounded import few
from .factor import split
from .fit import nonnegative, nonnegative_many


@dataclass(frozen=True)
class Noise:
    """A declared model of the noise: its deviation, where it comes from, and whether it was calibrated outside of the fit.

    A covariance is declared by whitening the rows with it (see factor.whitened()); the
    deviation is then 1. Only a calibrated model with a source that wasn't estimated from the
    fit's own residuals allows a verdict.
    """

    deviation: float = 1.0
    calibrated: bool = False
    source: str = ""
    estimated: bool = False

    def allows(self) -> bool:
        if not self.deviation > 0:
            raise ValueError("the deviation must be positive")
        return self.calibrated and bool(self.source.strip()) and not self.estimated


def _sums(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((a @ nonnegative_many(a, y) - y) ** 2).sum(axis=0)


def replicates(factors: DataFrame, key: str, n_q: int, n_h: int, noise: float | Noise | None, n: int = 1000, chunk: int = 100, seed: int = 0) -> DataFrame:
    """``key, t0, replicate, t``: the weighted residual sum of squares of the fit and of refits to simulated data.

    Replicates are dealt out in chunks, each a task group of its own that fits all of them at
    once; a factor is a few numbers and travels with each chunk. ``noise`` is the declared
    model (a number is the deviation of a calibrated one); without one that allows it there is
    no verdict and no row. The part of simulated noise that no column sees is drawn as one
    chi-square.
    """
    kind = f"{key} long, t0 double, replicate long, t double"
    if noise is None or isinstance(noise, Noise) and not noise.allows():
        return factors.sparkSession.createDataFrame([], kind)
    sigma = noise.deviation if isinstance(noise, Noise) else noise
    chunks = factors.sparkSession.range(-(-n // chunk)).withColumnRenamed("id", "chunk")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        s = split(row.r, n_q, n_h, int(row.n_rows))
        a, y, rest = s["hh"], s["hy"], float((s["yy"] ** 2).sum())
        c, _ = nonnegative(a, y)
        t0 = (((a @ c - y) ** 2).sum() + rest) / sigma**2
        free = max(0, int(row.n_rows) - len(s["kept"]) - a.shape[0])
        rng = np.random.default_rng([seed, int(row.chunk), abs(hash(int(row[key]))) % 2**31])
        count = min(chunk, n - int(row.chunk) * chunk)
        sim = (a @ c)[:, None] + sigma * rng.standard_normal((a.shape[0], count))
        t = _sums(a, sim) / sigma**2 + (rng.chisquare(free, count) if free else 0.0)
        return pd.DataFrame({key: int(row[key]), "t0": t0, "replicate": np.arange(count) + int(row.chunk) * chunk, "t": t})

    return factors.join(few(chunks)).groupBy(key, "chunk").applyInPandas(run, kind)


def trials(factors: DataFrame, key: str, n_q: int, n_h: int, sigma: float, n_trials: int = 100, n: int = 1000, alpha: float = 0.05, chunk: int = 5, seed: int = 0) -> DataFrame:
    """``key, trial, t0, p, inadequate``: the adequacy test repeated on ``n_trials`` data sets of each key's mean.

    ``factors`` are of ``[Q | H | mean]``. A trial draws noise of deviation ``sigma`` around the
    mean and is fitted; its ``n`` replicates are drawn around its own fit and refitted. Trials
    are dealt in chunks, and all replicates of a chunk are refitted at once. In the space of
    the factor the mean has the parts seen by the columns (which get noise of their own) and
    one number for the rest, whose noise is a noncentral chi-square.
    """
    chunks = factors.sparkSession.range(-(-n_trials // chunk)).withColumnRenamed("id", "chunk")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        s = split(row.r, n_q, n_h, int(row.n_rows))
        a, y, rest = s["hh"], s["hy"], float((s["yy"] ** 2).sum())
        m, free = a.shape[0], max(0, int(row.n_rows) - len(s["kept"]) - a.shape[0])
        rng = np.random.default_rng([seed, int(row.chunk), abs(hash(int(row[key]))) % 2**31])
        first = int(row.chunk) * chunk
        count = min(chunk, n_trials - first)
        data = y[:, None] + sigma * rng.standard_normal((m, count))
        c = nonnegative_many(a, data)
        beyond = rng.noncentral_chisquare(free, rest / sigma**2, count) if free else np.zeros(count)
        t0 = ((a @ c - data) ** 2).sum(axis=0) / sigma**2 + beyond
        sim = np.repeat(a @ c, n, axis=1) + sigma * rng.standard_normal((m, count * n))
        t = (_sums(a, sim) / sigma**2 + (rng.chisquare(free, count * n) if free else 0.0)).reshape(count, n)
        p = (1 + (t >= t0[:, None]).sum(axis=1)) / (n + 1)
        return pd.DataFrame({key: int(row[key]), "trial": np.arange(count) + first, "t0": t0, "p": p, "inadequate": t0 > np.quantile(t, 1 - alpha, axis=1)})

    return factors.join(few(chunks)).groupBy(key, "chunk").applyInPandas(run, f"{key} long, trial long, t0 double, p double, inadequate boolean")


def verdicts(replicates_: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """``key, t0, p_value, inadequate``: p = (1 + replicates at least as large) / (B + 1); inadequate above the 1 - alpha quantile."""
    return replicates_.groupBy(key).agg(
        F.first("t0").alias("t0"), ((1 + F.count_if(F.col("t") >= F.col("t0"))) / (F.count("*") + 1)).alias("p_value"), (F.first("t0") > F.expr(f"percentile(t, {1 - alpha})")).alias("inadequate")
    )


def rejection(trials: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``amplitude, rate, mean_p, q25, q75, null_ok, grows`` of ``trials(amplitude, p)``; the null's rate lies within two deviations, power does not fall."""
    own = trials.groupBy("amplitude").agg(F.avg((F.col("p") <= alpha).cast("double")).alias("rate"), F.avg("p").alias("mean_p"), F.expr("percentile(p, array(0.25, 0.75))").alias("q"), F.count("*").alias("n"))
    before = F.lag("rate").over(Window.orderBy("amplitude"))
    close = F.abs(F.col("rate") - alpha) <= 2 * F.sqrt(alpha * (1 - alpha) / F.col("n"))
    return own.select("amplitude", "rate", "mean_p", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"), F.when(F.col("amplitude") == 0, close).alias("null_ok"), F.coalesce(F.col("rate") >= before, F.lit(True)).alias("grows"))


def ks_uniform(trials: DataFrame, *keys: str) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance of ``p`` from the uniform law, by key."""
    own = Window.partitionBy(*keys)
    i, n = F.row_number().over(own.orderBy("p")), F.count("*").over(own)
    return trials.withColumn("_d", F.greatest(i / n - F.col("p"), F.col("p") - (i - 1) / n)).groupBy(*keys).agg(F.max("_d").alias("ks"))
