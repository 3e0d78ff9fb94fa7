"""Two-part (hurdle) and Tweedie models on Spark ML (M-1, M-5…M-9, M-17).

Stage 1: presence classifier (``LogisticRegression``) with positives weighted
n_neg / n_pos (class re-weighting).  Stage 2: Tweedie GLM with log link
(``GeneralizedLinearRegression``) fitted on positive rows only.  Score =
P(presence) · max(E[scale], 1e-9).  Both stages train data-parallel (treeAggregate
of gradients), and the fitted coefficients are a vector of #features — the only
thing the driver holds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.operators import glm
from regionscore.operators.quantile import exact_median
from regionscore.operators.split import holdout, kfold
from regionscore.session import cut_lineage

SCALE_FLOOR = 1e-9



def _prep_stages(features: list[str]):
    return [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="error"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]


def fit_tweedie(df: DataFrame, features: list[str], target: str, power: float, reg: float = 1e-4,
                max_iter: int = 50) -> PipelineModel:
    return Pipeline(stages=[*_prep_stages(features), _tweedie(target, power, reg, max_iter)]).fit(df)


def _tweedie(target: str, power: float, reg: float, max_iter: int = 50) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=target,
                                       featuresCol="features", predictionCol="pred", regParam=reg, maxIter=max_iter)


def tweedie_cv(df: DataFrame, features: list[str], target: str, fold_col: str, powers: list[float],
               reg: float = 1e-4) -> DataFrame:
    """Mean out-of-fold deviance per Tweedie power: rows (power, fold, deviance).

    All fits go through their rounds together, one scan a round (``glm``).
    """
    rows = glm.as_rows(df, features, target, fold_col)
    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]  # k values
    found = glm.deviances(rows, glm.fit_grid(rows, powers, folds, reg))
    return df.sparkSession.createDataFrame(found, "power double, fold int, deviance double")


def best_power(cv: DataFrame) -> float:
    return cv.groupBy("power").agg(F.avg("deviance").alias("d")).orderBy("d", "power").first()["power"]


@dataclass
class HurdleModel:
    features: list[str]
    stage1: PipelineModel
    stage2: PipelineModel
    power: float

    def score(self, df: DataFrame) -> DataFrame:
        """Adds p_presence, expected_scale, attractiveness (= P · max(E, 1e-9))."""
        s1 = self.stage1.transform(df).withColumn("p_presence", vector_to_array("probability")[1])
        s1 = s1.drop("_raw", "features", "rawPrediction", "probability", "prediction")
        s2 = self.stage2.transform(s1).withColumnRenamed("pred", "expected_scale").drop("_raw", "features")
        return s2.withColumn("attractiveness",
                             F.col("p_presence") * F.greatest(F.col("expected_scale"), F.lit(SCALE_FLOOR)))

    def save(self, path: str) -> None:
        self.stage1.write().overwrite().save(path + "/stage1")
        self.stage2.write().overwrite().save(path + "/stage2")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps({"features": self.features, "power": self.power}),)], "value string") \
            .coalesce(1).write.mode("overwrite").text(path + "/meta")

    @staticmethod
    def load(path: str) -> "HurdleModel":
        meta = json.loads(SparkSession.getActiveSession().read.text(path + "/meta").first()[0])
        return HurdleModel(meta["features"], PipelineModel.load(path + "/stage1"), PipelineModel.load(path + "/stage2"), meta["power"])


def search_power(df: DataFrame, features: list[str], target: str, key: str, powers: list[float], folds: int = 5,
                 seed: int = 42, reg: float = 1e-4) -> float:
    """The Tweedie power of least cross-validated deviance on the positive rows; strata: above their median or not."""
    positive = df.where(F.col(target) > 0)
    middle = exact_median(positive, [], target, "m").first()["m"]
    parts = kfold(positive, key, F.col(target) > F.lit(middle), folds, seed)
    return best_power(tweedie_cv(parts, features, target, "fold", powers, reg))


def fit_hurdle(df: DataFrame, features: list[str], target: str, power: float = 1.8,
               reg: float = 1e-4) -> HurdleModel:
    """Stage 1 on all rows (presence = target > 0, positives re-weighted), stage 2 on positives.

    The columns used are checkpointed once, so that no iteration of a fit goes back to the sources.
    """
    df = cut_lineage(df.select(*features, target))
    counts = df.agg(F.sum((F.col(target) > 0).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, n = counts["pos"] or 0, counts["n"]
    w = (n - pos) / pos if pos else 1.0
    d = df.withColumn("_present", (F.col(target) > 0).cast("double")).withColumn(
        "_w", F.when(F.col(target) > 0, F.lit(float(w))).otherwise(F.lit(1.0)))
    lr = LogisticRegression(featuresCol="features", labelCol="_present", weightCol="_w", regParam=reg, maxIter=100)
    stage1 = Pipeline(stages=[*_prep_stages(features), lr]).fit(d)
    stage2 = fit_tweedie(df.where(F.col(target) > 0), features, target, power, reg)
    return HurdleModel(features, stage1, stage2, power)


def boosted_frame(df: DataFrame, features: list[str], target: str, key: str, frac: float = 0.1, seed: int = 7) -> DataFrame:
    """features, label (target > 0), weight (positives n_neg / n_pos) and is_valid, an inner holdout by stratum; checkpointed."""
    d = holdout(df.select(*features, target, key), key, F.col(target) > 0, frac, seed)
    counts = d.agg(F.count_if(F.col(target) > 0).alias("pos"), F.count("*").alias("n")).first()
    weight = (counts["n"] - counts["pos"]) / counts["pos"] if counts["pos"] else 1.0
    present = F.col(target) > 0
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(d)
    return cut_lineage(d.select(key, "features", present.cast("double").alias("label"),
                                F.when(present, F.lit(float(weight))).otherwise(1.0).alias("weight"), "is_valid"))


def fit_boosted(frame: DataFrame, rounds: int = 30, depth: int = 3, step: float = 0.2, seed: int = 7) -> GBTClassificationModel:
    """Boosted presence model on a ``boosted_frame``: rounds end when the holdout's loss rises, and the best is kept."""
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="is_valid", validationTol=0.0,
                         maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(frame)
