"""Attribution, importance, ranking and result views (M-18…M-23, W-1…W-4, F-9, X-15).

Attributions of the linear stages are exact and closed-form on the link
scale: φ_j = β_j · (z_j − z̄_j) with z the standardised features (z̄ = 0 after
centring), so Σ_j φ_j = link(prediction) − base.  They are computed per row
with array expressions (no Python), exploded to a long table
(key, stage, feature, value, phi).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionscore.functions.scalar import status_class


def _linear_parts(model: PipelineModel):
    last = model.stages[-1]
    coef = [float(x) for x in last.coefficients.toArray()]
    return coef, float(last.intercept)


def attribution_long(model: PipelineModel, df: DataFrame, key: str, features: list[str], stage: str) -> DataFrame:
    """(key, stage, feature, value, phi, base) for one linear stage."""
    coef, intercept = _linear_parts(model)
    prepped = model.stages[0].transform(df)
    prepped = model.stages[1].transform(prepped)
    z = vector_to_array("features")
    beta = F.array(*[F.lit(c) for c in coef])
    names = F.array(*[F.lit(f) for f in features])
    raw = F.array(*[F.col(f).cast("double") for f in features])
    zipped = F.arrays_zip(names.alias("feature"), raw.alias("value"), z.alias("z"), beta.alias("beta"))
    ex = prepped.select(key, F.explode(zipped).alias("_e"))
    return ex.select(key, F.lit(stage).alias("stage"), F.col("_e.feature").alias("feature"),
                     F.col("_e.value").alias("value"), (F.col("_e.beta") * F.col("_e.z")).alias("phi"),
                     F.lit(intercept).alias("base"))


def importance(long: DataFrame) -> DataFrame:
    """(stage, feature, mean_abs_phi, mean_phi, rank) — rank 1 = most important within the stage."""
    imp = long.groupBy("stage", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"))
    w = Window.partitionBy("stage").orderBy(F.desc("mean_abs_phi"), "feature")
    return imp.withColumn("rank", F.row_number().over(w))


def rank_shift(imp: DataFrame, stage_a: str, stage_b: str, threshold: int = 3) -> DataFrame:
    """(feature, rank_a, rank_b, shift = rank_a − rank_b, direction): positive shift = rises in stage b."""
    a = imp.where(F.col("stage") == stage_a).select("feature", F.col("rank").alias("rank_a"))
    b = imp.where(F.col("stage") == stage_b).select("feature", F.col("rank").alias("rank_b"))
    j = a.join(b, "feature", "full_outer").withColumn("shift", F.col("rank_a") - F.col("rank_b"))
    return j.withColumn("direction", F.when(F.col("shift") > threshold, F.lit("rises"))
                        .when(F.col("shift") < -threshold, F.lit("falls")).otherwise(F.lit("stable")))


def top_n_by_abs(long: DataFrame, keys: list[str], n: int, value: str = "phi",
                 tiebreak: tuple = ("feature",)) -> DataFrame:
    """Per (keys) the n rows with the largest |value| (ties by ``tiebreak``), position in ``pos``.

    Each window partition is one row's features (bounded by #features).
    """
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), *tiebreak)
    return long.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def dependence(long: DataFrame, features: list[str]) -> DataFrame:
    return long.where(F.col("feature").isin(features)).select("feature", "value", "phi", "stage")


def residuals(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.withColumn("residual_log", F.log1p(F.col(pred)) - F.log1p(F.col(y))).withColumn(
        "is_positive", (F.col(y) > 0).cast("int"))


def opportunity(scored: DataFrame, activity: str, p_col: str = "p_presence", scale_col: str = "expected_scale",
                p_line: float = 0.5, scale_line: float | None = None) -> DataFrame:
    """Zero-activity rows with a quadrant on (p, scale) and a status class."""
    z = scored.where(F.col(activity) == 0)
    hi_p = F.col(p_col) >= p_line
    hi_s = F.col(scale_col) >= F.lit(scale_line) if scale_line is not None else F.lit(True)
    quad = (F.when(hi_p & hi_s, F.lit("high_p_high_scale")).when(hi_p, F.lit("high_p_low_scale"))
            .when(hi_s, F.lit("low_p_high_scale")).otherwise(F.lit("low_p_low_scale")))
    return z.withColumn("quadrant", quad).withColumn("status", status_class(activity, p_col, p_line))


def threshold_counts(scored: DataFrame, p_col: str, thresholds=(0.5, 0.75, 0.9)) -> DataFrame:
    return scored.agg(*[F.count_if(F.col(p_col) >= t).alias(f"n_p_ge_{str(t).replace('.', '_')}")
                        for t in thresholds])
