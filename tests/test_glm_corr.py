"""Batched regressions against separate ones, blocked correlations against numpy."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from regionscore.operators import glm
from regionscore.operators import model as MD
from regionscore.operators.correlation import corr_long, pair_sums


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(0, 1, (700, 9)), columns=[f"c{i}" for i in range(9)])
    data["c1"] = data.c0 * 2 + 1e9  # a large offset
    data["c2"] = 5.0  # constant
    data["c3"] = np.nan  # nothing
    data.loc[data.index % 3 == 0, "c4"] = np.nan
    data.loc[data.index % 3 != 0, "c5"] = np.nan  # no row with c4
    data.loc[5:, "c6"] = np.nan
    data.loc[1:, "c7"] = np.nan
    data["a.b"] = data.c8 ** 2
    data.loc[7, "a.b"] = np.nan
    rows = [[None if math.isnan(x) and j % 2 else x for j, x in enumerate(r)] for r in data.to_numpy().tolist()]  # nulls and NaN
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data.columns)).repartition(5)
    got = {(r.col_a, r.col_b): r["corr"] for r in corr_long(df, list(data.columns)).collect()}
    assert len(got) == 45
    expect = data.corr(min_periods=1)
    for (a, b), r in got.items():
        n = (data[a].notna() & data[b].notna()).sum()
        if n == 0:
            assert r is None
        elif n == 1 or "c2" in (a, b):
            assert math.isnan(r)
        else:
            assert r == pytest.approx(expect.loc[a, b], abs=1e-6), (a, b)
    assert corr_long(df, ["c0"]).count() == 0
    assert all(r["corr"] is None for r in corr_long(df.limit(0), ["c0", "c1"]).collect())


def test_wide_columns_equal_their_expressions(spark):
    """The columns that tasks derive for corr_wide are those of its SQL, with nulls, negative and zero numbers."""
    import duckdb
    from regionscore.plans import catalog_profile as cp
    rows = [(o, p, n, q) for o in (0, 60, 77, -13, None) for p in (-200, 0, 9 ** 12, None) for n in (1, -7, None) for q in (50, -3, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    numbers = pa.Table.from_batches([batch])  # noqa: F841
    expect = duckdb.sql(f"SELECT {cp._WIDE_SQL} FROM numbers").fetchall()
    got = cp.wide_values()(batch).T
    assert [[None if math.isnan(x) else x for x in r] for r in got] == [list(r) for r in expect]
    assert cp.wide_values()(batch.slice(0, 0)).shape == (200, 0)
    with pytest.raises(OverflowError):
        cp.wide_values()(pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (1, 1, 1, 2 ** 62)], batch.schema.names))


def test_corr_wide_sends_its_base_columns_only(spark, monkeypatch):
    """Hundreds of columns do not pass from Spark to Arrow: the tasks that multiply read four."""
    import __spark_entry__ as E
    from pyspark.sql.classic.dataframe import DataFrame
    sent, map_in_arrow = [], DataFrame.mapInArrow

    def noted(self, *args, **kwargs):
        sent.append(len(self.columns))
        return map_in_arrow(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", noted)
    E.queries()["corr_wide"](spark, "/root/testdata/sf0.001")
    assert sent == [4, 4]


def test_derived_columns_equal_given_ones(spark):
    """Columns with common and with own missing rows, derived or given, have the same sums."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 6)) + [0, 5, 1e6, 0, 0, 0]
    x[::3, :2] = np.nan
    x[1::4, 2] = np.nan
    x[:, 5] = np.nan
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)).repartition(3)

    def same(batch):
        return np.vstack([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    key = ["a", "b"]
    given = pair_sums(df, names).toPandas().sort_values(key).reset_index(drop=True)
    derived = pair_sums(df, names, same).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(given, derived, atol=1e-9)
    z = np.where(np.isnan(x), 0, x - np.nan_to_num(np.nanmean(x[:, :5], axis=0).tolist() + [0]))
    there = (~np.isnan(x)).astype(float)
    for r in given.itertuples():
        assert r.n == there[:, r.a] @ there[:, r.b]
        assert [r.sa, r.sb, r.saa, r.sbb, r.sab] == pytest.approx(
            [z[:, r.a] @ there[:, r.b], z[:, r.b] @ there[:, r.a], z[:, r.a] ** 2 @ there[:, r.b], z[:, r.b] ** 2 @ there[:, r.a], z[:, r.a] @ z[:, r.b]], abs=1e-6)


def test_grid_equals_separate_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1, 50, 0.01], (900, 3)) + [0, 1000, 0]
    mu = np.exp(0.4 * x[:, 0] + 0.01 * (x[:, 1] - 1000) - 20 * x[:, 2])
    y = np.where(rng.random(900) < 0.4, 0, rng.gamma(2, mu / 2))
    df = spark.createDataFrame([(*map(float, a), 3.0, float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                               "a double, b double, c double, same double, y double, fold int").repartition(4)
    features, powers = ["a", "b", "c", "same"], [1.2, 1.7]
    rows = glm.as_rows(df, features, "y", "fold")
    fits = glm.fit_grid(rows, powers, [0, 1, 2])
    assert fits.rounds < 25
    found = {(p, k): d for p, k, d in glm.deviances(rows, fits)}
    for p in powers:
        for k in range(3):
            train = df.where(F.col("fold") != k)
            m = Pipeline(stages=[*MD._prep_stages(features), MD._tweedie("y", p, 1e-4).setTol(1e-10)]).fit(train)
            assert fits.beta[p, k][:4] == pytest.approx(m.stages[-1].coefficients.toArray(), abs=1e-6)
            assert fits.beta[p, k][4] == pytest.approx(m.stages[-1].intercept, abs=1e-6)
            from regionscore.operators.metrics import tweedie_deviance
            dev = tweedie_deviance(m.transform(df.where(F.col("fold") == k)), "y", "pred", p).first()[0]
            assert found[p, k] == pytest.approx(dev, rel=1e-6)
    on, intercept = fits.raw((1.7, 1))
    z = fits.design(np.column_stack([x[:5], np.full(5, 3.0)]), 1)
    assert np.column_stack([x[:5], np.full(5, 3.0)]) @ on + intercept == pytest.approx(z @ fits.beta[1.7, 1])
    whole = glm.fit_grid(glm.as_rows(df, features, "y", None), [1.5], [glm.NO_FOLD])
    assert len(whole.beta) == 1 and MD.best_power(MD.tweedie_cv(df, features, "y", "fold", [1.2, 1.5, 1.8])) in (1.2, 1.5, 1.8)
