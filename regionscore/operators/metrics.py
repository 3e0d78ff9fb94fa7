"""Model evaluation as aggregates (M-10…M-16).

Every metric is a DataFrame with one row (or one row per group) so it stays
distributed; ranking metrics (AUC, AP) first collapse rows to one per distinct
score with a partial aggregate, then take chunked prefix sums — no global
window on one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.operators.quantile import exact_quantiles, prefix_sums


def tweedie_deviance(df: DataFrame, y: str, mu: str, p: float) -> DataFrame:
    """Mean Tweedie unit deviance for 1 < p < 2 (sklearn ``mean_tweedie_deviance``)."""
    yy, m = F.col(y).cast("double"), F.col(mu).cast("double")
    dev = 2 * (F.pow(F.greatest(yy, F.lit(0.0)), 2 - p) / ((1 - p) * (2 - p))
               - yy * F.pow(m, 1 - p) / (1 - p) + F.pow(m, 2 - p) / (2 - p))
    return df.agg(F.avg(dev).alias("deviance"))


def log_errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE and RMSE of log1p values."""
    e = F.log1p(F.col(yhat)) - F.log1p(F.col(y))
    return df.agg(F.avg(F.abs(e)).alias("mae_log"), F.sqrt(F.avg(e * e)).alias("rmse_log"))


def regression_log_errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE and RMSE of log1p values, plus the raw median absolute error."""
    med = exact_quantiles(df.withColumn("_ae", F.abs(F.col(yhat) - F.col(y))), [], "_ae", {"median_ae": 0.5})
    return log_errors(df, y, yhat).crossJoin(F.broadcast(med))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    lab = F.col(label).cast("int")
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("_s"))
            .agg(F.sum(lab).cast("double").alias("pos"), F.sum(1 - lab).cast("double").alias("neg")))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC with ties counted half (Mann–Whitney)."""
    c = prefix_sums(_score_counts(df, label, score), [], "_s", ["neg"])
    return c.agg((F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
                  / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Σ (R_n − R_{n−1}) · P_n over thresholds at distinct scores (sklearn definition)."""
    c = _score_counts(df, label, score).withColumn("_neg_s", -F.col("_s"))
    c = prefix_sums(c, [], "_neg_s", ["pos", "neg"])
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return c.agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")).alias("ap"))


def confusion(df: DataFrame, label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    pred = (F.col(prob) >= threshold).cast("int")
    return df.groupBy(F.col(label).cast("int").alias("actual"), pred.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def comparison_table(metrics: dict[str, DataFrame]) -> DataFrame:
    """Union one-row metric frames per model into (metric, <model>...) columns."""
    longs = []
    for model, m in metrics.items():
        cols = m.columns
        longs.append(m.unpivot([], cols, "metric", "value").withColumn("model", F.lit(model)))
    u = reduce(lambda a, b: a.unionByName(b), longs)
    return u.groupBy("metric").pivot("model", list(metrics)).agg(F.first("value"))
