"""Preprocessing, split and metric queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.operators import metrics as M
from regionscore.operators import prep as PR
from regionscore.operators import split as S
from regionscore.plans.catalog import _r, query
from regionscore.sources.tables import Tables


def customer_features(spark, d) -> DataFrame:
    """One row per customer: balances and order aggregates, with nulls by rule.

    Null rules: no 'P' orders -> n_p null (structural zero); no urgent order ->
    avg_urgent null; no 'F' order -> sum_f null; negative balance -> invalid.
    Target ``y``: number of urgent orders still pending (zero-inflated).
    """
    T = Tables(spark, d)
    o = T.orders
    urgent = F.col("o_orderpriority") == "1-URGENT"
    agg = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("sum_f"),
        F.nullif(F.count(F.when(F.col("o_orderstatus") == "P", F.lit(1))), F.lit(0)).alias("n_p"),
        F.avg(F.when(urgent, F.col("o_totalprice"))).alias("avg_urgent"),
        F.count(F.when(urgent & (F.col("o_orderstatus") == "P"), F.lit(1))).alias("y"))
    c = T.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return (c.join(agg, "c_custkey", "left")
            .withColumn("n_orders", F.coalesce("n_orders", F.lit(0)).cast("long"))
            .withColumn("y", F.coalesce("y", F.lit(0)).cast("long")))


CUST_FEAT_SQL = """feat AS (
  SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
         CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders, sum_f, n_p, avg_urgent, CAST(coalesce(y, 0) AS BIGINT) AS y
  FROM customer LEFT JOIN (
    SELECT o_custkey AS c_custkey, count(*) AS n_orders,
           sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS sum_f,
           nullif(count(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0) AS n_p,
           avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS avg_urgent,
           count(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 1 END) AS y
    FROM orders GROUP BY 1) USING (c_custkey))"""

PREP_SPEC = PR.PrepSpec(
    floors={"n_orders": 10.0}, zero_fill=["n_p"], invalid_below={"c_acctbal": 0.0},
    flag_then_median=["c_acctbal"], median_fill=["avg_urgent"], median_fill_rest=True,
    non_features=["c_custkey", "c_nationkey", "c_mktsegment"], target="y",
    log1p=["sum_f", "avg_urgent", "n_orders", "n_p"])

_PREP_SQL = f"""WITH {CUST_FEAT_SQL},
f2 AS (SELECT * REPLACE (CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal) FROM feat),
med AS (SELECT median(c_acctbal) AS m_acct, median(avg_urgent) AS m_urg, median(sum_f) AS m_sumf FROM f2),
imp AS (SELECT c_custkey, c_nationkey, c_mktsegment, y,
  CAST(n_orders > 10 AS INTEGER) AS n_orders_above_floor,
  CAST(c_acctbal IS NULL AS INTEGER) AS c_acctbal_missing,
  coalesce(c_acctbal, m_acct) AS c_acctbal, CAST(coalesce(n_p, 0) AS DOUBLE) AS n_p,
  coalesce(avg_urgent, m_urg) AS avg_urgent, coalesce(sum_f, m_sumf) AS sum_f, n_orders
  FROM f2, med WHERE y IS NOT NULL)"""


def _prep(spark, d):
    f = customer_features(spark, d)
    return PR.Preprocessor(PREP_SPEC).fit(f), f


@query("prep_flags", f"""WITH {CUST_FEAT_SQL}
SELECT c_custkey, CAST(n_orders > 10 AS INTEGER) AS n_orders_above_floor FROM feat""")
def prep_flags(spark, d):
    model, f = _prep(spark, d)
    return model.flags(f).select("c_custkey", "n_orders_above_floor")


@query("prep_impute", f"""{_PREP_SQL}
SELECT c_custkey, c_nationkey, c_mktsegment, y, n_orders_above_floor, c_acctbal_missing,
  round(c_acctbal, 6) AS c_acctbal, round(n_p, 6) AS n_p, round(avg_urgent, 6) AS avg_urgent,
  round(sum_f, 6) AS sum_f, n_orders FROM imp""")
def prep_impute(spark, d):
    model, f = _prep(spark, d)
    out = model.impute(f)
    return out.select("c_custkey", "c_nationkey", "c_mktsegment", "y", "n_orders_above_floor", "c_acctbal_missing",
                      *[_r(c).alias(c) for c in ("c_acctbal", "n_p", "avg_urgent", "sum_f")], "n_orders")


@query("prep_log1p", f"""{_PREP_SQL}
SELECT c_custkey, round(ln(1 + sum_f), 6) AS sum_f, round(ln(1 + avg_urgent), 6) AS avg_urgent,
  round(ln(1 + n_orders), 6) AS n_orders, round(ln(1 + n_p), 6) AS n_p, round(c_acctbal, 6) AS c_acctbal FROM imp""")
def prep_log1p(spark, d):
    model, f = _prep(spark, d)
    out = model.transform(f)
    return out.select("c_custkey", *[_r(c).alias(c) for c in ("sum_f", "avg_urgent", "n_orders", "n_p", "c_acctbal")])


@query("prep_expectations", f"""{_PREP_SQL}
SELECT 'nonnull' AS "check", 'c_acctbal' AS "column", CAST(count(*) - count(c_acctbal) AS BIGINT) AS n_violations,
       count(*) = count(c_acctbal) AS ok FROM imp
UNION ALL SELECT 'nonneg', 'sum_f', CAST(count(*) FILTER (WHERE sum_f < 0) AS BIGINT),
       count(*) FILTER (WHERE sum_f < 0) = 0 FROM imp
UNION ALL SELECT 'unique', 'c_custkey', CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT),
       count(*) = count(DISTINCT c_custkey) FROM imp""")
def prep_expectations(spark, d):
    model, f = _prep(spark, d)
    return PR.expectations(model.impute(f), key="c_custkey", no_nulls=["c_acctbal"], non_negative=["sum_f"])


# ---------------------------------------------------------------------------------------
# Splits (M-2…M-4)

_HASH_ORDER = "md5(CAST(c_custkey AS VARCHAR) || '|' || '42'), c_custkey"


@query("split_stratified", f"""WITH {CUST_FEAT_SQL},
r AS (SELECT c_custkey, y > 0 AS s, row_number() OVER (PARTITION BY y > 0 ORDER BY {_HASH_ORDER}) AS rk,
             count(*) OVER (PARTITION BY y > 0) AS n FROM feat)
SELECT c_custkey, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_stratified(spark, d):
    f = customer_features(spark, d).select("c_custkey", "y")
    return S.stratified_split(f, "c_custkey", F.col("y") > 0, 0.2, 42).select("c_custkey", "split")


@query("holdout", f"""WITH {CUST_FEAT_SQL},
r AS (SELECT c_custkey, row_number() OVER (PARTITION BY y > 0 ORDER BY {_HASH_ORDER}) AS rk, count(*) OVER (PARTITION BY y > 0) AS n FROM feat)
SELECT c_custkey, rk <= ceil(n * 0.1) AS is_valid FROM r""")
def holdout(spark, d):
    """The inner holdout that stops a fit early."""
    f = customer_features(spark, d).select("c_custkey", "y")
    return S.holdout(f, "c_custkey", F.col("y") > 0, 0.1, 42).select("c_custkey", "is_valid")


@query("kfold", f"""WITH {CUST_FEAT_SQL},
r AS (SELECT c_custkey, row_number() OVER (PARTITION BY y > 0 ORDER BY {_HASH_ORDER}) AS rk FROM feat)
SELECT c_custkey, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r""")
def kfold(spark, d):
    f = customer_features(spark, d).select("c_custkey", "y")
    return S.kfold(f, "c_custkey", F.col("y") > 0, 5, 42).select("c_custkey", "fold")


# ---------------------------------------------------------------------------------------
# Metrics (M-10…M-14) on a fixed rule-based prediction

def _pred(spark, d):
    f = customer_features(spark, d)
    return f.select("c_custkey", "y", (F.lit(0.05) * F.col("n_orders") + F.lit(0.01)).alias("mu"))


_PRED_SQL = f"{CUST_FEAT_SQL}, pred AS (SELECT c_custkey, y, CAST(0.05 AS DOUBLE) * n_orders + CAST(0.01 AS DOUBLE) AS mu FROM feat)"


@query("metric_deviance", f"""WITH {_PRED_SQL}
SELECT round(avg(2 * (pow(greatest(y, 0), 2 - 1.3) / ((1 - 1.3) * (2 - 1.3)) - y * pow(mu, 1 - 1.3) / (1 - 1.3)
                      + pow(mu, 2 - 1.3) / (2 - 1.3))), 6) AS deviance FROM pred""")
def metric_deviance(spark, d):
    return M.tweedie_deviance(_pred(spark, d), "y", "mu", 1.3).select(_r("deviance").alias("deviance"))


@query("metric_mae_rmse", f"""WITH {_PRED_SQL}
SELECT round(avg(abs(ln(1 + mu) - ln(1 + y))), 6) AS mae_log,
       round(sqrt(avg(pow(ln(1 + mu) - ln(1 + y), 2))), 6) AS rmse_log,
       round(median(abs(mu - y)), 6) AS median_ae FROM pred""")
def metric_mae_rmse(spark, d):
    out = M.regression_log_errors(_pred(spark, d), "y", "mu")
    return out.select(*[_r(c).alias(c) for c in ("mae_log", "rmse_log", "median_ae")])


def _doc_scores(spark, d):
    T = Tables(spark, d)
    docs = T.documents.select("doc_id", "n_chars")
    return (T.labels.join(docs, "doc_id")
            .select("doc_id", "quality", "toxic", F.round(F.log(F.col("n_chars").cast("double")), 1).alias("score"),
                    (1 / (1 + F.exp(-(F.log(F.col("n_chars").cast("double")) - 7)))).alias("prob")))


_SCORE_SQL = """s AS (SELECT doc_id, quality, toxic, round(ln(n_chars), 1) AS score,
                     1 / (1 + exp(-(ln(n_chars) - 7))) AS prob FROM labels JOIN documents USING (doc_id))"""


@query("metric_auc", f"""WITH {_SCORE_SQL},
c AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY score),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM c)
SELECT round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 8) AS auc FROM w""")
def metric_auc(spark, d):
    return M.roc_auc(_doc_scores(spark, d), "quality", "score").select(_r("auc", 8).alias("auc"))


@query("metric_ap", f"""WITH {_SCORE_SQL},
c AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY score),
w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM c)
SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 8) AS ap FROM w""")
def metric_ap(spark, d):
    return M.average_precision(_doc_scores(spark, d), "quality", "score").select(_r("ap", 8).alias("ap"))


@query("confusion", f"""WITH {_SCORE_SQL}
SELECT toxic AS actual, CAST(prob >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM s GROUP BY ALL""")
def confusion(spark, d):
    return M.confusion(_doc_scores(spark, d), "toxic", "prob")
