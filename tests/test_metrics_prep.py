import numpy as np
import pytest
from pyspark.sql import functions as F

from regionscore.operators import metrics as M
from regionscore.operators import prep as PR
from regionscore.operators.split import kfold, stratified_split


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    y = [int(v) for v in rng.integers(0, 2, 400)]
    s = [float(round(v, 1)) for v in rng.random(400)]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(_auc_brute(y, s))
    assert M.average_precision(df, "y", "s").first()["ap"] == pytest.approx(_ap_brute(y, s))


def test_deviance_and_errors(spark):
    df = spark.createDataFrame([(0.0, 0.5), (2.0, 1.5), (5.0, 4.0)], "y double, mu double")
    p = 1.5
    exp = np.mean([2 * (max(y, 0) ** (2 - p) / ((1 - p) * (2 - p)) - y * m ** (1 - p) / (1 - p) + m ** (2 - p) / (2 - p))
                   for y, m in [(0.0, 0.5), (2.0, 1.5), (5.0, 4.0)]])
    assert M.tweedie_deviance(df, "y", "mu", p).first()[0] == pytest.approx(exp)
    e = M.regression_log_errors(df, "y", "mu").first()
    assert e["median_ae"] == pytest.approx(0.5)


def test_prep_floors_thresholds_and_medians(spark):
    df = spark.createDataFrame([
        (1, 5.0, 0.0, -3.0, None), (2, 5.0001, 0.009, 10.0, 1.0), (3, None, 0.01, None, 3.0), (4, 7.0, 0.05, 20.0, None)],
        "k int, gas double, price double, land double, hurricane double")
    spec = PR.PrepSpec(floors={"gas": 5.0}, zero_fill=["hurricane"], invalid_below={"price": 0.01, "land": 0.0},
                       flag_then_median=["land"], median_fill=["price"], non_features=["k"], log1p=["land"])
    m = PR.Preprocessor(spec).fit(df)
    out = {r["k"]: r for r in m.impute(df).collect()}
    assert [out[k]["gas_above_floor"] for k in (1, 2, 3, 4)] == [0, 1, 0, 1]
    assert out[1]["land_missing"] == 1 and out[1]["land"] == 15.0  # negative -> null -> median of 10, 20
    assert out[1]["price"] == pytest.approx(0.03) and out[2]["price"] == pytest.approx(0.03)  # < 0.01 invalid
    assert out[1]["hurricane"] == 0.0
    assert out[3]["gas"] == 5.0001  # remaining feature with nulls -> median of 5.0, 5.0001, 7.0
    checks = PR.expectations(m.impute(df), key="k", no_nulls=["land", "gas", "price"]).collect()
    assert all(r["ok"] for r in checks)


def test_split_and_kfold_exact_and_stratified(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = stratified_split(df, "id", F.col("y") > 0, 0.2, 42)
    c = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(1, "test")] == 50 and c[(0, "test")] == 150
    f = kfold(df, "id", F.col("y") > 0, 5, 42)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sorted(sizes) == [200] * 5
