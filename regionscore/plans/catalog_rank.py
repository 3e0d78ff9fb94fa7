"""Model, attribution, ranking, kNN and result-view queries.

Ranking / view operators run on fixed rule-based scores so they have DuckDB
oracles; the fitted models (whose floating-point results depend on the
solver) are registered without one and checked by invariants in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from regionscore.operators import explain as XP
from regionscore.operators import metrics as M
from regionscore.operators import model as MD
from regionscore.operators import neighbours as NB
from regionscore.operators import rank as RK
from regionscore.operators import split as S
from regionscore.plans.catalog import _r, query
from regionscore.plans.catalog_model import CUST_FEAT_SQL, PREP_SPEC, customer_features
from regionscore.operators import prep as PR
from regionscore.session import checkpoint_dir, cut_lineage
from regionscore.sources.tables import Tables

REG = 1e-4
POWERS = [1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9]
POSITIVE_POWERS = POWERS[1:]
FEATURES = ["c_acctbal", "c_acctbal_missing", "n_orders", "n_orders_above_floor", "sum_f", "n_p", "avg_urgent"]


def _fixed_scores(spark, d):
    f = customer_features(spark, d)
    p = 1 / (1 + F.exp(-(F.col("n_orders") - 10) / 3.0))
    e = F.coalesce(F.col("avg_urgent"), F.lit(0.0)) / 100000.0
    return f.select("c_custkey", "c_nationkey", "y", p.alias("p_presence"), e.alias("expected_scale"),
                    F.round(p * F.greatest(e, F.lit(MD.SCALE_FLOOR)), 4).alias("attractiveness"))


_FIXED_SQL = f"""{CUST_FEAT_SQL},
sc AS (SELECT c_custkey, c_nationkey, y, 1 / (1 + exp(-(n_orders - 10) / 3.0)) AS p_presence,
              coalesce(avg_urgent, 0.0) / 100000.0 AS expected_scale FROM feat),
fx AS (SELECT *, round(p_presence * greatest(expected_scale, 1e-9), 4) AS attractiveness FROM sc)"""


@query("rank_scores", f"""WITH {_FIXED_SQL}
SELECT CAST(row_number() OVER (ORDER BY attractiveness DESC, c_custkey) AS INTEGER) AS rank, c_custkey, attractiveness FROM fx""")
def rank_scores(spark, d):
    out = RK.global_rank(_fixed_scores(spark, d), "attractiveness", "c_custkey")
    return out.select(F.col("rank").cast("int").alias("rank"), "c_custkey", "attractiveness")


@query("top_scores", f"""WITH {_FIXED_SQL}
SELECT c_custkey, attractiveness FROM fx ORDER BY attractiveness DESC, c_custkey LIMIT 20""")
def top_scores(spark, d):
    return RK.top_k(_fixed_scores(spark, d), "attractiveness", "c_custkey", 20).select("c_custkey", "attractiveness")


@query("opportunity", f"""WITH {_FIXED_SQL}
SELECT c_custkey, round(p_presence, 6) AS p_presence, round(expected_scale, 8) AS expected_scale,
  CASE WHEN p_presence >= 0.5 AND expected_scale >= 1.0 THEN 'high_p_high_scale'
       WHEN p_presence >= 0.5 THEN 'high_p_low_scale'
       WHEN expected_scale >= 1.0 THEN 'low_p_high_scale' ELSE 'low_p_low_scale' END AS quadrant,
  CASE WHEN coalesce(y, 0) > 0 THEN 'active' WHEN p_presence >= 0.5 THEN 'ready' ELSE 'none' END AS status
FROM fx WHERE y = 0""")
def opportunity(spark, d):
    o = XP.opportunity(_fixed_scores(spark, d), "y", scale_line=1.0)
    return o.select("c_custkey", _r("p_presence").alias("p_presence"), _r("expected_scale", 8).alias("expected_scale"),
                    "quadrant", "status")


@query("threshold_counts", f"""WITH {_FIXED_SQL}
SELECT count_if(p_presence >= 0.5) AS n_p_ge_0_5, count_if(p_presence >= 0.75) AS n_p_ge_0_75,
       count_if(p_presence >= 0.9) AS n_p_ge_0_9 FROM fx""")
def threshold_counts(spark, d):
    return XP.threshold_counts(_fixed_scores(spark, d), "p_presence")


def _fixed_long(spark, d):
    li = Tables(spark, d).lineitem
    return li.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("stage"),
                     F.col("l_linestatus").alias("feature"), F.col("l_quantity").alias("value"),
                     (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("phi"))


_LONG_SQL = """lg AS (SELECT l_orderkey AS key, l_returnflag AS stage, l_linestatus AS feature, l_quantity AS value,
                    l_extendedprice * (l_discount - 0.05) AS phi FROM lineitem)"""


@query("importance", f"""WITH {_LONG_SQL}
SELECT stage, feature, round(avg(abs(phi)), 6) AS mean_abs_phi, round(avg(phi), 6) AS mean_phi,
       CAST(row_number() OVER (PARTITION BY stage ORDER BY avg(abs(phi)) DESC, feature) AS INTEGER) AS rank
FROM lg GROUP BY stage, feature""")
def importance(spark, d):
    imp = XP.importance(_fixed_long(spark, d))
    return imp.select("stage", "feature", _r("mean_abs_phi").alias("mean_abs_phi"), _r("mean_phi").alias("mean_phi"),
                      F.col("rank").cast("int").alias("rank"))


@query("rank_shift", f"""WITH {_LONG_SQL},
imp AS (SELECT stage, feature, row_number() OVER (PARTITION BY stage ORDER BY avg(abs(phi)) DESC, feature) AS rank
        FROM lg GROUP BY stage, feature),
a AS (SELECT feature, rank AS rank_a FROM imp WHERE stage = 'A'),
b AS (SELECT feature, rank AS rank_b FROM imp WHERE stage = 'N')
SELECT feature, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b,
       CAST(rank_a - rank_b AS INTEGER) AS shift,
       CASE WHEN rank_a - rank_b > 0 THEN 'rises' WHEN rank_a - rank_b < 0 THEN 'falls' ELSE 'stable' END AS direction
FROM a FULL OUTER JOIN b USING (feature)""")
def rank_shift(spark, d):
    imp = XP.importance(_fixed_long(spark, d))
    out = XP.rank_shift(imp, "A", "N", threshold=0)
    return out.select("feature", F.col("rank_a").cast("int").alias("rank_a"), F.col("rank_b").cast("int").alias("rank_b"),
                      F.col("shift").cast("int").alias("shift"), "direction")


@query("top_n_per_row", f"""WITH {_LONG_SQL}
SELECT key, stage, feature, value, round(phi, 6) AS phi, CAST(pos AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY key, stage ORDER BY abs(phi) DESC, feature, value) AS pos FROM lg) WHERE pos <= 2""")
def top_n_per_row(spark, d):
    out = XP.top_n_by_abs(_fixed_long(spark, d), ["key", "stage"], 2, tiebreak=("feature", "value"))
    return out.select("key", "stage", "feature", "value", _r("phi").alias("phi"), F.col("pos").cast("int").alias("pos"))


@query("knn", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS neighbor_id,
             sqrt(list_reduce(list_transform(generate_series(1, len(v)), lambda i: (v[i] - qv[i]) * (v[i] - qv[i])), lambda a, b: a + b)) AS distance
      FROM e JOIN q ON vec_id <> query_id)
SELECT query_id, neighbor_id, round(distance, 6) AS distance, CAST(nn_rank AS INTEGER) AS nn_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS nn_rank FROM s) WHERE nn_rank <= 5""")
def knn(spark, d):
    out = NB.knn(Tables(spark, d).embeddings, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=5)
    return out.select("query_id", "neighbor_id", _r("distance").alias("distance"), F.col("nn_rank").cast("int").alias("nn_rank"))


# ---------------------------------------------------------------------------------------
# Fitted models (rows-only checks; invariants in tests)

def _model_table(spark, d):
    f = customer_features(spark, d)
    return PR.Preprocessor(PREP_SPEC).fit(f).impute(f)


@query("hurdle_scores")
def hurdle_scores(spark, d):
    t = cut_lineage(_model_table(spark, d))
    m = MD.fit_hurdle(t, FEATURES, "y", MD.search_power(t, FEATURES, "y", "c_custkey", POSITIVE_POWERS, 5))
    s = m.score(t)
    return RK.global_rank(s, "attractiveness", "c_custkey").select(
        "rank", "c_custkey", "y", F.round("p_presence", 4).alias("p_presence"),
        F.round("expected_scale", 4).alias("expected_scale"), F.round("attractiveness", 4).alias("attractiveness"))


@query("tweedie_cv")
def tweedie_cv(spark, d):
    t = S.kfold(cut_lineage(_model_table(spark, d)), "c_custkey", F.col("y") > 0, 5, 42)
    cv = MD.tweedie_cv(t, FEATURES, "y", "fold", POWERS)
    return cv.groupBy("power").agg(F.avg("deviance").alias("cv_deviance"))


@query("attribution_long")
def attribution_long(spark, d):
    t = cut_lineage(_model_table(spark, d))
    m = MD.fit_hurdle(t, FEATURES, "y", power=1.5)
    a1 = XP.attribution_long(m.stage1, t, "c_custkey", FEATURES, "stage1")
    a2 = XP.attribution_long(m.stage2, t, "c_custkey", FEATURES, "stage2")
    return a1.unionByName(a2)


@query("model_checks", """
SELECT 'attribution_stage1' AS name, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'attribution_stage2', 0
UNION ALL SELECT 'gradient_stage1', 0 UNION ALL SELECT 'gradient_stage2', 0
UNION ALL SELECT 'rank_permutation', 0 UNION ALL SELECT 'scored_customers', count(*) FROM customer""")
def model_checks(spark, d):
    """Fitted models held to what must hold for any of them: attributions add up to the link of the prediction, the
    penalised gradients are zero at the optimum, ranks are a permutation, every customer is scored."""
    t = cut_lineage(_model_table(spark, d))
    m = MD.fit_hurdle(t, FEATURES, "y", power=1.5, reg=REG)
    s = m.score(t)
    n = t.count()

    def identity(stage, model, link, scored):
        a = XP.attribution_long(model, t, "c_custkey", FEATURES, stage).groupBy("c_custkey").agg(
            (F.sum("phi") + F.first("base")).alias("sum"))
        return (a.join(scored.select("c_custkey", link.alias("link")), "c_custkey")
                .agg(F.count_if(F.abs(F.col("sum") - F.col("link")) > 1e-6).alias("violations")))

    logit = F.ln(F.col("p_presence") / (1 - F.col("p_presence")))
    checks = [("attribution_stage1", identity("stage1", m.stage1, logit, s)),
              ("attribution_stage2", identity("stage2", m.stage2, F.ln("expected_scale"), s))]
    z = [vector_to_array("features")[i] for i in range(len(FEATURES))]

    def gradient(model, rows, error, weight):
        """Features (and the intercept) whose mean gradient, with the penalty, is not near zero."""
        scaled = model.stages[1].transform(model.stages[0].transform(rows))
        means = scaled.agg(*[(F.sum(weight * error * x) / F.sum(weight)).alias(f"g{i}") for i, x in enumerate([*z, F.lit(1.0)])])
        penalty = [REG * float(c) for c in model.stages[-1].coefficients] + [0.0]
        return means.select(sum((F.abs(F.col(f"g{i}") + p) > 1e-3).cast("long") for i, p in enumerate(penalty)).alias("violations"))

    pos = s.where("y > 0").count()
    weight = F.when(F.col("y") > 0, F.lit((n - pos) / max(pos, 1))).otherwise(F.lit(1.0))
    checks += [("gradient_stage1", gradient(m.stage1, s, F.col("p_presence") - (F.col("y") > 0).cast("double"), weight)),
               ("gradient_stage2", gradient(m.stage2, s.where("y > 0"), (F.col("expected_scale") - F.col("y"))
                                            * F.pow(F.col("expected_scale"), F.lit(-0.5)), F.lit(1.0)))]
    ranks = RK.global_rank(s, "attractiveness", "c_custkey").agg(
        (F.count(F.lit(1)) - F.count_distinct("rank") + F.abs(F.max("rank") - F.count(F.lit(1)))
         + F.abs(F.min("rank") - 1)).cast("long").alias("violations"))
    checks += [("rank_permutation", ranks), ("scored_customers", s.agg(F.count_if(F.col("attractiveness") >= 0).alias("violations")))]
    out = None
    for name, one in checks:
        one = one.select(F.lit(name).alias("name"), F.col("violations").cast("long").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rank_export", f"""WITH {_FIXED_SQL}
SELECT CAST(row_number() OVER (ORDER BY attractiveness DESC, c_custkey) AS BIGINT) AS rank, CAST(c_custkey AS BIGINT) AS c_custkey,
       CAST(attractiveness AS DOUBLE) AS attractiveness FROM fx""")
def rank_export(spark, d):
    """A ranking written as CSV with its ranks, and read again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ranking-{uuid.uuid4().hex}"
    ranked = RK.global_rank(_fixed_scores(spark, d), "attractiveness", "c_custkey")
    RK.export_ranking(ranked.select("rank", "c_custkey", "attractiveness"), path)
    return spark.read.option("header", True).schema("rank long, c_custkey long, attractiveness double").csv(path)


@query("model_importance")
def model_importance(spark, d):
    return XP.importance(attribution_long(spark, d))


# ---------------------------------------------------------------------------------------
# Result-table helpers on fixed inputs (J-8, U-5, T-2, M-16, M-20, M-21)

@query("semi_keys", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  AND o_orderstatus = 'P')""")
def semi_keys(spark, d):
    T = Tables(spark, d)
    keys = T.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")) \
        .select(F.col("o_custkey").alias("c_custkey"))
    return RK.semi_by_keys(T.customer.select("c_custkey", "c_name"), keys, "c_custkey")


@query("dim_values", """
SELECT DISTINCT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, n_name""")
def dim_values(spark, d):
    T = Tables(spark, d)
    j = T.nation.join(T.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return RK.sorted_distinct(j, ["r_name", "n_name"])


@query("bottom_scores", f"""WITH {_FIXED_SQL}
SELECT c_custkey, attractiveness FROM fx ORDER BY attractiveness, c_custkey LIMIT 15""")
def bottom_scores(spark, d):
    return RK.top_k(_fixed_scores(spark, d), "attractiveness", "c_custkey", 15, descending=False) \
        .select("c_custkey", "attractiveness")


@query("residuals", f"""WITH {_FIXED_SQL}
SELECT c_custkey, round(ln(1 + expected_scale) - ln(1 + y), 6) AS residual_log, CAST(y > 0 AS INTEGER) AS is_positive FROM fx""")
def residuals(spark, d):
    r = XP.residuals(_fixed_scores(spark, d), "y", "expected_scale")
    return r.select("c_custkey", _r("residual_log").alias("residual_log"), "is_positive")


@query("dependence", f"""WITH {_LONG_SQL}
SELECT feature, value, round(phi, 6) AS phi, stage FROM lg WHERE feature IN ('F')""")
def dependence(spark, d):
    out = XP.dependence(_fixed_long(spark, d), ["F"])
    return out.select("feature", "value", _r("phi").alias("phi"), "stage")


@query("model_comparison", f"""WITH {_FIXED_SQL},
m AS (SELECT 'mae_log' AS metric, avg(abs(ln(1 + expected_scale) - ln(1 + y))) AS a,
             avg(abs(ln(1 + p_presence) - ln(1 + y))) AS b FROM fx
      UNION ALL SELECT 'rmse_log', sqrt(avg(pow(ln(1 + expected_scale) - ln(1 + y), 2))),
             sqrt(avg(pow(ln(1 + p_presence) - ln(1 + y), 2))) FROM fx)
SELECT metric, round(a, 6) AS scale_rule, round(b, 6) AS presence_rule FROM m""")
def model_comparison(spark, d):
    s = _fixed_scores(spark, d)
    a, b = M.log_errors(s, "y", "expected_scale"), M.log_errors(s, "y", "p_presence")
    t = M.comparison_table({"scale_rule": a, "presence_rule": b})
    return t.select("metric", _r("scale_rule").alias("scale_rule"), _r("presence_rule").alias("presence_rule"))


@query("boosted_checks", """
SELECT 'kept_round_is_best' AS name, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'auc_below_logistic', 0
UNION ALL SELECT 'scored_customers', count(*) FROM customer""")
def boosted_checks(spark, d):
    """The boosted presence model, stopped early: no kept round has less holdout loss than the last kept one, and it
    tells customers with y > 0 apart at least as well as the logistic stage."""
    t = cut_lineage(_model_table(spark, d))
    frame = MD.boosted_frame(t, FEATURES, "y", "c_custkey")
    model = MD.fit_boosted(frame)
    losses = model.evaluateEachIteration(frame.where("is_valid"))
    late = sum(x < losses[-1] for x in losses)
    scored = model.transform(frame).select("c_custkey", "label", vector_to_array("probability")[1].alias("p"))
    plain = MD.fit_hurdle(t, FEATURES, "y", power=1.5).score(t).select((F.col("y") > 0).cast("double").alias("label"), "p_presence")
    auc = [M.roc_auc(x, "label", p).first()[0] for x, p in ((scored, "p"), (plain, "p_presence"))]
    found = [("kept_round_is_best", late), ("auc_below_logistic", int(auc[0] < auc[1])), ("scored_customers", scored.count())]
    return spark.createDataFrame(found, "name string, violations long")
