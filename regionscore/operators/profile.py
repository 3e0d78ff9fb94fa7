"""Column profiling (A-10…A-27, W-5, T-3).

Every per-column statistic is computed in ONE aggregate pass over the table
(one partial aggregate per task, one tiny shuffle) and turned into a long
``(column, value)`` table with ``unpivot``; nothing is looped per column on
the driver.  Quantiles go through ``exact_quantiles`` (no whole group in one
task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.functions.scalar import bias_corrected_skew, nan_to_null
from regionscore.operators.correlation import corr_long
from regionscore.operators.quantile import exact_quantiles, quantiles_long


def _value(df: DataFrame, c: str) -> Column:
    """The column, NaN as null."""
    return nan_to_null(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


def _clean(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: _value(df, c) for c in cols})


def _long(wide: DataFrame, names: list[str], value: str) -> DataFrame:
    return wide.unpivot([], names, "column", value)


def profile_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_missing, pct_missing) — nulls and NaN count as missing."""
    wide = df.agg(*[F.sum(_value(df, c).isNull().cast("long")).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"))
    long = wide.unpivot(["_n"], cols, "column", "n_missing")
    return long.select("column", "n_missing",
                       (F.col("n_missing") * 100.0 / F.col("_n")).alias("pct_missing"))


def missing_matrix(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """0/1 per cell: 1 when missing (A-27)."""
    return df.select(*keys, *[_value(df, c).isNull().cast("int").alias(c) for c in cols])


def profile_skew(df: DataFrame, cols: list[str], threshold: float = 1.0) -> DataFrame:
    """(column, skew, abs_skew, is_skewed): bias-corrected sample skewness (pandas ``skew``)."""
    df, aggs = _clean(df, cols), []
    for c in cols:
        aggs += [F.skewness(c).alias(f"s__{c}"), F.count(c).alias(f"n__{c}")]
    wide = df.agg(*aggs)
    wide = wide.select(*[bias_corrected_skew(F.col(f"s__{c}"), F.col(f"n__{c}")).alias(c) for c in cols])
    out = _long(wide, cols, "skew")
    return out.select("column", "skew", F.abs("skew").alias("abs_skew"),
                      F.coalesce(F.abs("skew") > threshold, F.lit(False)).alias("is_skewed"))


def profile_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, std) sample standard deviation."""
    wide = _clean(df, cols).agg(*[F.stddev(c).alias(c) for c in cols])
    return _long(wide, cols, "std")


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, mean, std, min, median, max): one pass + exact medians."""
    df = _clean(df, cols)
    wide = df.agg(*[x for c in cols for x in (
        F.count(c).alias(f"count__{c}"), F.avg(c).alias(f"mean__{c}"), F.stddev(c).alias(f"std__{c}"),
        F.min(F.col(c).cast("double")).alias(f"min__{c}"), F.max(F.col(c).cast("double")).alias(f"max__{c}"))])
    stats = ["count", "mean", "std", "min", "max"]
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").cast("double").alias(s) for s in stats])
        for c in cols])).alias("r")).select("r.*")
    med = quantiles_long(df, [], cols, {"median": 0.5})
    return rows.join(med, "column", "left").withColumn("count", F.col("count").cast("long"))


def corr_top_pairs(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """The ``n`` pairs with the largest |r| (top-k report)."""
    return (corr_long(df, cols).where(F.col("corr").isNotNull())
            .orderBy(F.abs("corr").desc(), "col_a", "col_b").limit(n))


def corr_target(df: DataFrame, cols: list[str], target: str, log1p: bool = True) -> DataFrame:
    """(column, corr) with the (log1p-transformed) target, sorted by |r|."""
    y = F.log1p(F.col(target)) if log1p else F.col(target)
    d = _clean(_clean(df, cols).withColumn("_y", y.cast("double")), ["_y"])
    wide = d.agg(*[F.corr(c, "_y").alias(c) for c in cols])
    return _long(wide, cols, "corr").orderBy(F.abs("corr").desc_nulls_last(), "column")


def describe_group(df: DataFrame, group: str, y: str) -> DataFrame:
    """Grouped describe: count, mean, std, min, q25, median, q75, max."""
    df = _clean(df, [y])
    base = df.groupBy(group).agg(F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev(y).alias("std"),
                                 F.min(F.col(y).cast("double")).alias("min"),
                                 F.max(F.col(y).cast("double")).alias("max"))
    q = exact_quantiles(df, [group], y, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(q, group, "left")


def hist_cut(df: DataFrame, col: str, edges: list[float], labels: list[str] | None = None) -> DataFrame:
    """Left-closed bins [e_i, e_{i+1}) with ordered labels; empty bins kept (count 0).

    The bin list has ``len(edges) - 1`` rows (a parameter, not data), so it is
    broadcast; values outside every bin are dropped as in ``pd.cut``.
    """
    spark = df.sparkSession
    labels = labels or [f"[{a}, {b})" for a, b in zip(edges[:-1], edges[1:])]
    bins = spark.createDataFrame([(i, labels[i], float(edges[i]), float(edges[i + 1]))
                                  for i in range(len(edges) - 1)], "bin int, label string, lo double, hi double")
    v = F.col(col).cast("double")
    idx = None
    for i in range(len(edges) - 1):
        cond = (v >= edges[i]) & (v < edges[i + 1])
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    counts = df.select(idx.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    return (F.broadcast(bins).join(counts, "bin", "left")
            .select("bin", "label", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")))


def hist_width(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed (numpy rule).

    Returns (bin, lo, hi, n) for every bin, empty ones with n = 0; min/max come
    from a one-row aggregate that is broadcast back.
    """
    v = F.col(col).cast("double")
    d = df.select(nan_to_null(v).alias("_v")).where(F.col("_v").isNotNull())
    mm = d.agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    d = d.crossJoin(F.broadcast(mm))
    width = (F.col("_max") - F.col("_min")) / F.lit(bins)
    b = F.when(F.col("_max") == F.col("_min"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_min")) / width), F.lit(bins - 1))).cast("int")
    counts = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = mm.where("_min is not null").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.col("_min") + F.col("bin") * (F.col("_max") - F.col("_min")) / bins).alias("lo"),
                      (F.col("_min") + (F.col("bin") + 1) * (F.col("_max") - F.col("_min")) / bins).alias("hi"), "n")


def quantile_bins(df: DataFrame, col: str, q: int = 10, bin_col: str = "bin") -> DataFrame:
    """``pd.qcut(q, duplicates='drop')``: edges at exact quantiles, repeated edges merged,
    bins right-closed with the lowest value in bin 0."""
    probs = {f"e{i}": i / q for i in range(1, q)}
    edges = exact_quantiles(df, [], col, probs)
    edges = edges.select(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(1, q)])).alias("_edges"))
    d = df.crossJoin(F.broadcast(edges))  # one row
    return d.withColumn(bin_col, F.size(F.filter("_edges", lambda e: e < F.col(col)))).drop("_edges")


def decile_calibration(df: DataFrame, y: str, yhat: str, q: int = 10) -> DataFrame:
    """(bin, n, mean_actual, mean_pred) over prediction quantile bins."""
    b = quantile_bins(df, yhat, q)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_actual"),
                                F.avg(yhat).alias("mean_pred"))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) — ``value_counts(normalize=True)``; the total is a one-row broadcast."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .select("value", "n", (F.col("n") / F.col("_total")).alias("share")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once (``duplicated(keep=False)``)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return df.join(dup, on=keys, how="left_semi")


def key_integrity(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, n_distinct_keys, n_duplicated_rows, is_unique."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_keys"),
                   F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n_duplicated_rows"),
                   (F.max("_n") <= 1).alias("is_unique"))


def top_groups(df: DataFrame, key: str, measure: str | None, n: int, how: str = "sum") -> DataFrame:
    """Top-n groups by sum of ``measure`` (or by row count); ties broken by key."""
    agg = F.sum(measure) if how == "sum" else F.count(F.lit(1))
    return (df.groupBy(key).agg(agg.alias("total")).orderBy(F.col("total").desc(), key).limit(n))
