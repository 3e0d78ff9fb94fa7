"""Many Tweedie regressions at once (M-5, M-6): log link, ridge, by Newton's method.

All fits of a grid of (power, fold) go through their rounds together. A round is
one scan: each task adds up the normal equations of every fit over its rows, Spark
sums them, and the driver solves one small system a fit, so that a search costs as
many scans as its slowest fit has rounds. A fit leaves out the rows of its fold and
standardises features by the others'; its objective is that of Spark's own
regression: mean weighted squares and half the penalty times squared coefficients.
The first rounds, and any after a step that grew, are reweighted least squares,
which come near the optimum safely; the others take the exact second derivatives
of the deviance, which end in few steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.session import cut_lineage

#: No row is left out by this fold.
NO_FOLD = -1
#: Start of a mean for rows of target zero, and the least mean.
ZERO_START, LEAST_MEAN = 0.1, 1e-16
#: Rounds of reweighted least squares before Newton's steps.
FIRST_ROUNDS = 3


@dataclass
class Fits:
    """Fits of (power, fold): coefficients on standardised features, the intercept last."""
    jobs: list[tuple[float, int]]
    mean: dict[int, np.ndarray]
    scale: dict[int, np.ndarray]
    beta: dict[tuple[float, int], np.ndarray]
    rounds: int

    def design(self, x: np.ndarray, fold: int) -> np.ndarray:
        return np.column_stack([(x - self.mean[fold]) * self.scale[fold], np.ones(len(x))])

    def raw(self, job: tuple[float, int]) -> tuple[np.ndarray, float]:
        """Coefficients on the features as they are, and the intercept."""
        b, k = self.beta[job], job[1]
        on = b[:-1] * self.scale[k]
        return on, float(b[-1] - on @ self.mean[k])


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, per_batch, width: int) -> dict[int, np.ndarray]:
    """Sums over all rows of what ``per_batch(x, y, fold)`` gives: {number: vector of ``width``}."""
    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for j, v in per_batch(*_read(batch)):
                    total[j] = total.get(j, 0) + v
        n = len(total)
        job, at = np.repeat(np.array(list(total), np.int32), width), np.tile(np.arange(width, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array(job), pa.array(at), pa.array(np.concatenate(list(total.values())) if n else np.zeros(0))],
                                         ["job", "i", "v"])

    found = rows.mapInArrow(sums, "job int, i int, v double").groupBy("job", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in found.collect():  # jobs times features squared
        out.setdefault(r.job, np.zeros(width))[r.i] = r.v
    return out


def as_rows(df: DataFrame, features: list[str], target: str, fold_col: str | None) -> DataFrame:
    """x, y, fold, checkpointed, in a partition a core at least."""
    fold = F.lit(NO_FOLD) if fold_col is None else F.col(fold_col)
    rows = (df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"),
                                 F.col(target).cast("double").alias("y"), fold.cast("int").alias("fold")))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores))


def _scales(rows: DataFrame, d: int, folds: list[int]) -> tuple[dict, dict]:
    """Mean and 1 / standard deviation (0 if constant) of each feature over the rows outside each fold."""
    stats = rows.groupBy("fold").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("m"),
                                     F.array(*[F.coalesce(F.var_samp(F.col("x")[i]), F.lit(0.0)) for i in range(d)]).alias("v")).collect()
    mean, scale = {}, {}
    for k in folds:
        n, m, ss = 0, np.zeros(d), np.zeros(d)
        for r in stats:
            if r.fold != k or k == NO_FOLD:
                delta = np.array(r.m) - m
                ss = ss + np.array(r.v) * (r.n - 1) + delta ** 2 * n * r.n / (n + r.n)
                m = m + delta * r.n / (n + r.n)
                n += r.n
        std = np.sqrt(ss / max(n - 1, 1))
        mean[k], scale[k] = m, np.divide(1.0, std, out=np.zeros(d), where=std > 0)
    return mean, scale


def fit_grid(rows: DataFrame, powers: list[float], folds: list[int], reg: float = 1e-4, max_iter: int = 50, tol: float = 1e-9) -> Fits:
    """One fit for every power and fold left out, of rows from ``as_rows``."""
    d = len(rows.select("x").first().x)
    jobs = [(float(p), int(k)) for k in folds for p in powers]
    fits = Fits(jobs, *_scales(rows, d, folds), {}, 0)
    width = (d + 1) ** 2 + d + 2
    penalty = reg * np.diag([1.0] * d + [0.0])
    todo = list(range(len(jobs)))
    steps: dict[int, float] = {}
    newton: dict[int, bool] = {}
    while todo and fits.rounds < max_iter:
        def equations(x, y, fold, now=tuple(todo), newton=dict(newton)):
            for k in {jobs[j][1] for j in now}:
                some = (fold != k) if k != NO_FOLD else np.ones(len(y), bool)
                z, t = fits.design(x[some], k), y[some]
                for j in now:
                    if jobs[j][1] == k and len(t):
                        p = jobs[j][0]
                        mu = np.exp(z @ fits.beta[jobs[j]]) if jobs[j] in fits.beta else np.where(t == 0, ZERO_START, t)
                        mu = np.maximum(mu, LEAST_MEAN)
                        w = mu ** (2 - p)
                        slope = (t - mu) * mu ** (1 - p)
                        curve = (2 - p) * w + (p - 1) * t * mu ** (1 - p) if newton.get(j) else w
                        # before the first step there is no linear predictor of coefficients, but the logarithm of the start
                        right = slope if jobs[j] in fits.beta else w * np.log(mu) + slope
                        yield j, np.concatenate([(z.T @ (z * curve[:, None])).ravel(), z.T @ right, [w.sum()]])

        found = _summed(rows, equations, width)
        fits.rounds += 1
        left = []
        for j in todo:
            v = found[j]
            a, b = v[:(d + 1) ** 2].reshape(d + 1, d + 1) / v[-1], v[(d + 1) ** 2:-1] / v[-1]
            old = fits.beta.get(jobs[j], np.zeros(d + 1))
            step = np.linalg.lstsq(a + penalty, b - penalty @ old, rcond=None)[0]  # a constant feature has neither weight nor slope
            size = float(np.abs(step).max())
            newton[j] = fits.rounds >= FIRST_ROUNDS and size <= steps.get(j, np.inf)
            steps[j] = size
            fits.beta[jobs[j]] = old + step
            if size > tol * max(1.0, float(np.abs(old + step).max())):
                left.append(j)
        todo = left
    return fits


def deviances(rows: DataFrame, fits: Fits) -> list[tuple[float, int, float]]:
    """(power, fold, mean Tweedie deviance) of every fit on the rows of its fold; one scan."""
    def unit(x, y, fold):
        for k in {k for _, k in fits.jobs}:
            some = (fold == k) if k != NO_FOLD else np.ones(len(y), bool)
            z, t = fits.design(x[some], k), y[some]
            for j, (p, own) in enumerate(fits.jobs):
                if own == k:
                    m = np.exp(z @ fits.beta[p, k])
                    dev = 2 * (np.maximum(t, 0) ** (2 - p) / ((1 - p) * (2 - p)) - t * m ** (1 - p) / (1 - p) + m ** (2 - p) / (2 - p))
                    yield j, np.array([dev.sum(), len(t)])

    found = _summed(rows, unit, 2)
    return [(p, k, float(found[j][0] / found[j][1])) for j, (p, k) in enumerate(fits.jobs) if j in found and found[j][1]]
