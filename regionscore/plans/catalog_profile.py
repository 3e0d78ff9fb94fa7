"""Profiling, histogram, share, duplicate and top-k queries with DuckDB oracles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from regionscore.operators import profile as P
from regionscore.plans.catalog import _r, query
from regionscore.sources.tables import Tables

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _feat(spark, d):
    """Lineitem features; a zero discount is read as suppressed (missing)."""
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"), "l_tax")


_FEAT_SQL = """feat AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
                    CASE WHEN l_discount <> 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)"""


@query("profile_missing", f"""WITH {_FEAT_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*), 6) AS pct_missing FROM feat" for c in _NUM)}""")
def profile_missing(spark, d):
    out = P.profile_missing(_feat(spark, d), _NUM)
    return out.select("column", "n_missing", _r("pct_missing").alias("pct_missing"))


@query("profile_skew", f"""WITH {_FEAT_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, round(skewness({c}), 6) AS skew, coalesce(abs(skewness({c})) > 1, false) AS is_skewed FROM feat" for c in _NUM)}""")
def profile_skew(spark, d):
    out = P.profile_skew(_feat(spark, d), _NUM)
    return out.select("column", _r("skew").alias("skew"), "is_skewed")


@query("profile_std", f"""WITH {_FEAT_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, round(stddev_samp({c}), 6) AS std FROM feat" for c in _NUM)}""")
def profile_std(spark, d):
    return P.profile_std(_feat(spark, d), _NUM).select("column", _r("std").alias("std"))


@query("profile_summary", f"""WITH {_FEAT_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(median({c}), 6) AS median, round(max({c}), 6) AS max FROM feat" for c in _NUM)}""")
def profile_summary(spark, d):
    out = P.summary(_feat(spark, d), _NUM)
    return out.select("column", "count", *[_r(c).alias(c) for c in ("mean", "std", "min", "median", "max")])


def _pairs():
    return [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]


@query("corr_matrix", f"""WITH {_FEAT_SQL}
{' UNION ALL '.join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM feat" for a, b in _pairs())}""")
def corr_matrix(spark, d):
    return P.corr_long(_feat(spark, d), _NUM).select("col_a", "col_b", _r("corr").alias("corr"))


#: Columns derived from lineitem: multiples of its numbers modulo a few, null where the order number divides.
_WIDE = 200
_WIDE_SQL = ", ".join(f"CASE WHEN l_orderkey % {i % 13 + 3} <> 0 THEN CAST((CAST(l_quantity AS BIGINT) * {i + 1} + l_partkey + l_linenumber * {i}) % {i + 7} AS DOUBLE) END AS x{i}"
                      for i in range(_WIDE))


def wide_values(wide: int = _WIDE):
    """A function that gives the columns of ``_WIDE_SQL``, a row each, of a batch with order, part, line and quantity; NaN
    is null. It goes to the tasks by value, so that they need no package."""
    def values(batch: pa.RecordBatch) -> np.ndarray:
        order, part, line, quantity = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns)
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
        gone = [~(known & (order % m != 0)) for m in range(3, 16)]
        most = [np.abs(c, dtype=float).max(initial=0) for c in (part, line, quantity)]
        if most[0] + wide * (most[1] + most[2]) >= 2 ** 63:
            raise OverflowError("a column of corr_wide passes 64 bits")
        out = np.empty((wide, len(order)))
        for i in range(wide):
            x = quantity * (i + 1) + part + line * i
            # numpy divides by one number faster than it takes remainders; SQL's remainder has the sign of x
            out[i] = x - x // (i + 7) * (i + 7) if x.min(initial=0) >= 0 else np.fmod(x, i + 7)
            out[i][gone[i % 13]] = np.nan
        return out

    return values


@query("corr_wide", f"""
WITH w AS (SELECT {_WIDE_SQL} FROM lineitem),
c AS (SELECT [{', '.join(f'corr(x{i}, x{j})' for i in range(_WIDE) for j in range(i + 1, _WIDE))}] AS r FROM w),
p AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS pos FROM (SELECT unnest(range({_WIDE})) AS i), (SELECT unnest(range({_WIDE})) AS j) WHERE i < j)
SELECT 'x' || i AS col_a, 'x' || j AS col_b, round(r[pos], 6) + 0.0::DOUBLE AS corr FROM p, c""")
def corr_wide(spark, d):
    """All 19,900 correlations of 200 columns, each with its own missing rows. Tasks derive the columns."""
    base = Tables(spark, d).lineitem.selectExpr("l_orderkey", "l_partkey", "cast(l_linenumber as long)", "cast(l_quantity as long)")
    return P.corr_long(base, [f"x{k}" for k in range(_WIDE)], wide_values()).select("col_a", "col_b", (_r("corr") + 0.0).alias("corr"))


@query("corr_top_pairs", f"""WITH {_FEAT_SQL}, c AS (
{' UNION ALL '.join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM feat" for a, b in _pairs())})
SELECT col_a, col_b, round(corr, 6) AS corr FROM c WHERE corr IS NOT NULL
ORDER BY abs(corr) DESC, col_a, col_b LIMIT 3""")
def corr_top_pairs(spark, d):
    return P.corr_top_pairs(_feat(spark, d), _NUM, 3).select("col_a", "col_b", _r("corr").alias("corr"))


@query("corr_target", f"""WITH {_FEAT_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, round(corr({c}, ln(1 + l_extendedprice)), 6) AS corr FROM feat" for c in _NUM if c != "l_extendedprice")}""")
def corr_target(spark, d):
    cols = [c for c in _NUM if c != "l_extendedprice"]
    return P.corr_target(_feat(spark, d), cols, "l_extendedprice").select("column", _r("corr").alias("corr"))


@query("describe_group", """
SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
  round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(median(l_extendedprice), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(max(l_extendedprice), 6) AS max
FROM lineitem GROUP BY l_returnflag""")
def describe_group(spark, d):
    out = P.describe_group(Tables(spark, d).lineitem, "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", "count",
                      *[_r(c).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])


_EDGES = [0.0, 5.0, 10.0, 25.0, 40.0, 50.0, 60.0]


@query("hist_cut", f"""
WITH bins AS (SELECT * FROM (VALUES {', '.join(f"({i}, '[{_EDGES[i]}, {_EDGES[i + 1]})', CAST({_EDGES[i]} AS DOUBLE), CAST({_EDGES[i + 1]} AS DOUBLE))" for i in range(len(_EDGES) - 1))}) t(bin, label, lo, hi)),
c AS (SELECT b.bin, count(*) AS n FROM lineitem JOIN bins b ON l_quantity >= b.lo AND l_quantity < b.hi GROUP BY 1)
SELECT bins.bin, label, lo, hi, coalesce(n, 0) AS n FROM bins LEFT JOIN c USING (bin)""")
def hist_cut(spark, d):
    return P.hist_cut(Tables(spark, d).lineitem, "l_quantity", _EDGES)


def _hist_width_sql(bins):
    return f"""
WITH mm AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - mn) / ((mx - mn) / {bins})), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM orders, mm GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, round(mn + k * (mx - mn) / {bins}, 6) AS lo, round(mn + (k + 1) * (mx - mn) / {bins}, 6) AS hi,
       coalesce(n, 0) AS n FROM (SELECT unnest(range({bins})) AS k) LEFT JOIN b ON k = bin, mm"""


def _hist_width(spark, d, bins):
    out = P.hist_width(Tables(spark, d).orders, "o_totalprice", bins)
    return out.select("bin", _r("lo").alias("lo"), _r("hi").alias("hi"), "n")


@query("hist_width", _hist_width_sql(30))
def hist_width(spark, d):
    return _hist_width(spark, d, 30)


@query("hist_width_fine", _hist_width_sql(30000))
def hist_width_fine(spark, d):
    """More bins than the values fill: the empty ones are in the result."""
    return _hist_width(spark, d, 30000)


@query("decile_calibration", """
WITH e AS (SELECT list_distinct(quantile_cont(l_discount, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges FROM lineitem),
b AS (SELECT len(list_filter(edges, lambda x: x < l_discount)) AS bin, l_extendedprice, l_discount FROM lineitem, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(l_extendedprice), 6) AS mean_actual,
       round(avg(l_discount), 6) AS mean_pred FROM b GROUP BY bin""")
def decile_calibration(spark, d):
    out = P.decile_calibration(Tables(spark, d).lineitem, "l_extendedprice", "l_discount")
    return out.select("bin", "n", _r("mean_actual").alias("mean_actual"), _r("mean_pred").alias("mean_pred"))


@query("value_share", """
SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 8) AS share
FROM orders GROUP BY 1""")
def value_share(spark, d):
    out = P.value_share(Tables(spark, d).orders, "o_orderpriority")
    return out.select("value", "n", _r("share", 8).alias("share"))


@query("missing_matrix", f"""WITH {_FEAT_SQL}
SELECT l_orderkey, l_linenumber, CAST(l_discount IS NULL AS INTEGER) AS l_discount,
       CAST(l_tax IS NULL AS INTEGER) AS l_tax FROM feat""")
def missing_matrix(spark, d):
    return P.missing_matrix(_feat(spark, d), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("dup_keys", """
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders
WHERE (o_custkey, o_orderpriority, o_orderstatus) IN (
  SELECT (o_custkey, o_orderpriority, o_orderstatus) FROM orders GROUP BY ALL HAVING count(*) > 1)""")
def dup_keys(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return P.duplicate_keys(o, ["o_custkey", "o_orderpriority", "o_orderstatus"])


@query("key_integrity", """
WITH per AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct_keys,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_duplicated_rows,
       max(n) <= 1 AS is_unique FROM per""")
def key_integrity(spark, d):
    return P.key_integrity(Tables(spark, d).events, ["user_id", "event_type"])


@query("top_groups", """
SELECT c_nationkey, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY sum(o_totalprice) DESC, c_nationkey LIMIT 10""")
def top_groups(spark, d):
    T = Tables(spark, d)
    j = T.orders.join(T.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return P.top_groups(j, "c_nationkey", "o_totalprice", 10).select("c_nationkey", _r("total", 4).alias("total"))


@query("top_groups_count", """
SELECT user_id, count(*) AS total FROM events WHERE event_type = 'purchase'
GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 20""")
def top_groups_count(spark, d):
    e = Tables(spark, d).events.where(F.col("event_type") == "purchase")
    return P.top_groups(e, "user_id", None, 20, how="count")
