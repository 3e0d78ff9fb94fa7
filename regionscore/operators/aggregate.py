"""Grouped aggregation and reshaping (A-1…A-3, A-8, A-9, U-1).

All are single ``groupBy`` passes: Spark plans a partial (map-side) hash
aggregate, one shuffle on the keys, and a final aggregate, so hot keys are
pre-combined per task before they cross the network.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.operators.quantile import exact_medians

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

_METHODS = {
    "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
    "median": exact_medians, "std": F.stddev, "count": F.count,
}


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def agg_by_key(df: DataFrame, keys: list[str], method: str = "median",
               cols: list[str] | None = None) -> DataFrame:
    """One aggregate per value column, chosen by ``method`` (median default).

    Null keys are dropped first (pandas ``groupby`` semantics). Medians are
    exact and never hold a group in one task (``exact_medians``); a group
    without values has none, and keeps its row.
    """
    cols = cols or numeric_columns(df, keys)
    if method not in _METHODS:
        raise ValueError(f"unknown aggregation {method!r}")
    keep = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if method == "median":
        return df.where(keep).select(*keys).distinct().join(exact_medians(df, keys, cols), keys, "left")
    fn = _METHODS[method]
    return df.where(keep).groupBy(*keys).agg(*[fn(c).alias(c) for c in cols])


def mean_by_key(df: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    return agg_by_key(df, keys, "mean", cols)


def count_by_key(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    keep = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(keep).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def pivot_first(df: DataFrame, index: list[str], column: str, values: list,
                value_cols: list[str] | str, names: dict | None = None) -> DataFrame:
    """Wide table from a long one: one column per (pivot value, value column).

    The explicit value list avoids the extra job Spark runs to discover the
    distinct values. The first value is taken deterministically (``min``) and
    rows with a null index are dropped, as pandas' ``pivot_table`` does.
    With one value column the output is named after the pivot value, else
    ``<value column>_<pivot value>``; ``names`` renames afterwards.
    """
    single = isinstance(value_cols, str)
    vcols = [value_cols] if single else list(value_cols)
    keep = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in index])
    g = df.where(keep).groupBy(*index).pivot(column, values)
    if single:
        out = g.agg(F.min(vcols[0]))
        out = out.toDF(*index, *[str(v) for v in values])
    else:
        out = g.agg(*[F.min(v).alias(v) for v in vcols])
        rename = {f"{val}_{v}": f"{v}_{val}" for val in values for v in vcols}
        out = out.withColumnsRenamed(rename)
    if names:
        out = out.withColumnsRenamed(names)
    return out


def union_sources(dfs: list[DataFrame], tag_col: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Union by name, missing columns filled with nulls; optional source tag."""
    if tag_col:
        dfs = [d.withColumn(tag_col, F.lit(t)) for d, t in zip(dfs, tags)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
