"""Correlations of many columns by matrix products (A-21).

A task keeps the pairwise-complete sums of its rows as products of the matrix of
values (0 for missing) and the matrix of which are there, and gives them as one
row a column; Spark adds them up. The plan has the same size for any number of
columns, and rows are read once. Values are taken from their column's mean, so
that large offsets cost no digits. A task holds six matrices of columns squared.

Columns with the same missing rows in a batch share the products with them. Wide
columns that are derived from a few can be made inside the tasks, since the way of
hundreds of columns from Spark's rows to Arrow costs more than their products.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]
#: A sum of squares that is less than this part of what its terms were is rounding: the column is constant there.
CONSTANT = 1e-14


def pair_sums(df: DataFrame, cols: list[str], derive: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) for every pair of positions a < b: count, sums, squares and products of the
    rows that have both, each value less its column's mean. NaN is missing.

    ``derive`` makes the columns ``cols`` of a batch of ``df``, a row of doubles each; without it they are in ``df``.
    """
    values = df if derive else df.selectExpr(*[f"cast(`{c}` as double) as c{i}" for i, c in enumerate(cols)])
    k = len(cols)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return derive(batch) if derive else np.vstack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])

    def column_sums(batches):
        total, count = np.zeros(k), np.zeros(k)
        for batch in batches:
            v = matrix(batch)
            there = ~np.isnan(v)
            total, count = total + np.where(there, v, 0.0).sum(axis=1), count + there.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total), pa.array(count)], ["i", "s", "n"])

    found = values.mapInArrow(column_sums, "i int, s double, n double").groupBy("i").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias("m"))
    means = np.zeros((k, 1))
    for r in found.collect():  # a row a column
        means[r.i] = r.m

    def distinct_masks(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows of a Boolean matrix, as numbers, and which of them each row is."""
        _, first, of = np.unique(np.packbits(there, axis=1), axis=0, return_index=True, return_inverse=True)
        return there[first].astype(float), of.reshape(-1)

    def sums(batches):
        both, a, aa, ab = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            v = matrix(batch) - means
            there = ~np.isnan(v)
            v = np.where(there, v, 0.0)
            m, of = distinct_masks(there)
            both += (m @ m.T)[of][:, of]
            a += (v @ m.T)[:, of]
            aa += ((v * v) @ m.T)[:, of]
            ab += v @ v.T
        rows = range(k - 1)
        parts = [[x[i, i + 1:] for i in rows] for x in (both, a, a.T, aa, aa.T, ab)]
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(p, kind) for p in parts)], ["a", *SUMS])

    found = values.mapInArrow(sums, "a int, " + ", ".join(f"{s} array<double>" for s in SUMS))
    found = found.select("a", F.posexplode(F.arrays_zip(*SUMS)).alias("at", "s")).select("a", (F.col("a") + F.col("at") + 1).alias("b"), "s.*")
    return found.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])


def corr_long(df: DataFrame, cols: list[str], derive: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(col_a, col_b, corr) for every pair of columns in their order, pairwise-complete; ``derive`` as in ``pair_sums``.

    Null without a row that has both, NaN if one of the columns is constant there or there is one row only.
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    s = pair_sums(df, cols, derive)
    spread = lambda x, xx: F.when(F.col("n") * F.col(xx) - F.col(x) * F.col(x) > CONSTANT * F.col("n") * F.col(xx),
                                  F.col("n") * F.col(xx) - F.col(x) * F.col(x)).otherwise(0.0)
    both = F.sqrt(spread("sa", "saa")) * F.sqrt(spread("sb", "sbb"))
    r = F.when(F.col("n") == 0, None).when(both == 0, F.lit(float("nan"))).otherwise((F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / both)
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), r.alias("corr"))
