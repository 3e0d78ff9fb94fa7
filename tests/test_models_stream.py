import math
import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from regionscore.operators import explain as XP
from regionscore.operators import model as MD
from regionscore.plans import catalog_rank as CR
from regionscore.streaming import intake as ST


def test_linear_attributions_sum_to_link_minus_base(spark):
    t = CR._model_table(spark, SF_SMALL).cache()
    m = MD.fit_hurdle(t, CR.FEATURES, "y", power=1.5)
    a2 = XP.attribution_long(m.stage2, t, "c_custkey", CR.FEATURES, "stage2")
    sums = {r["c_custkey"]: r["s"] + r["b"] for r in a2.groupBy("c_custkey").agg(
        F.sum("phi").alias("s"), F.first("base").alias("b")).collect()}
    pred = {r["c_custkey"]: r["pred"] for r in m.stage2.transform(t).select("c_custkey", "pred").collect()}
    for k in list(pred)[:50]:
        assert sums[k] == pytest.approx(math.log(pred[k]), rel=1e-6, abs=1e-6)
    a1 = XP.attribution_long(m.stage1, t, "c_custkey", CR.FEATURES, "stage1")
    s1 = {r["c_custkey"]: r["s"] + r["b"] for r in a1.groupBy("c_custkey").agg(
        F.sum("phi").alias("s"), F.first("base").alias("b")).collect()}
    p = {r["c_custkey"]: r["p"] for r in m.stage1.transform(t.withColumn("_w", F.lit(1.0)))
         .select("c_custkey", vector_to_array("probability")[1].alias("p")).collect()}
    for k in list(p)[:50]:
        assert s1[k] == pytest.approx(math.log(p[k] / (1 - p[k])), rel=1e-6, abs=1e-6)
    scored = m.score(t)
    assert scored.where(F.col("attractiveness") < 0).count() == 0


def test_stream_intake_resumes_without_duplicates(spark, tmp_path):
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    first = ST.intake_events(spark, SF_SMALL, sink, ckpt).count()
    second = ST.intake_events(spark, SF_SMALL, sink, ckpt).count()
    n = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).count()
    assert first == n and second == n


def test_stream_equals_batch(spark):
    s = {r["event_type"]: r["n"] for r in ST.signal_events(spark, SF_SMALL).collect()}
    b = {r["event_type"]: r["count"] for r in
         spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).groupBy("event_type").count().collect()}
    assert s == b


def test_boosted_model_stops_on_the_holdout(spark):
    t = CR._model_table(spark, SF_SMALL)
    frame = MD.boosted_frame(t, CR.FEATURES, "y", "c_custkey", frac=0.3)
    model = MD.fit_boosted(frame, rounds=25, step=1.0)
    losses = model.evaluateEachIteration(frame.where("is_valid"))
    assert 0 < len(losses) < 25 and min(losses) == losses[-1]
    parts = {(r.label, r.is_valid): r["count"] for r in frame.groupBy("label", "is_valid").count().collect()}
    assert all(parts[x, True] == math.ceil(0.3 * (parts[x, True] + parts[x, False])) for x in (0.0, 1.0))
