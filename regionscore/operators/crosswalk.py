"""Allocation of measures between grains through a weighted crosswalk (J-5, A-4…A-6).

Plan shape (checked with ``explain``): the crosswalk is aggregated once with a
map-side partial aggregate; the allocation is a left join of the crosswalk to
the measures on the source key (sort-merge at scale, AQE may split skewed
partitions or switch to broadcast when its runtime size check passes) followed
by a partial + final hash aggregate on the destination key.  A destination key
that holds a third of the rows is harmless: partial aggregation leaves at most
one row per (task, destination) before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crosswalk_ratio(df: DataFrame, src_key: str, dst_key: str, weight: str,
                    ratio_col: str = "ratio") -> DataFrame:
    """Share of ``weight`` per (src, dst) within each src: rows (src, dst, ratio).

    Aggregates to (src, dst) first, so the per-src window runs over at most
    #dst rows per source key, never over raw rows.
    """
    pairs = (df.where(F.col(src_key).isNotNull() & F.col(dst_key).isNotNull())
             .groupBy(src_key, dst_key).agg(F.sum(weight).alias("_w")))
    total = F.sum("_w").over(Window.partitionBy(src_key))
    return (pairs.withColumn(ratio_col, F.try_divide(F.col("_w"), total))
            .drop("_w"))


def crosswalk_allocate(measures: DataFrame, xwalk: DataFrame, src_key: str, dst_key: str,
                       ratio: str, additive: list[str] | None = None,
                       weighted: list[str] | None = None, weight_mode: str = "per_column",
                       carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Allocate source-grain measures to the destination grain.

    ``measures`` must be unique per ``src_key`` (aggregate first with
    ``mean_by_key`` / ``count_by_key``).  Returns ``(allocated, unallocated)``:

    * additive:  Σ coalesce(v, 0) · coalesce(ratio, 0)  (every destination key,
      0 when nothing maps to it)
    * weighted:  Σ v · ratio / Σ weight, null when the weight sum is 0, where
      weight = ratio if ``v`` is present (``per_column``) or if *any* weighted
      measure of the source row is present (``any``, the source pipeline's rule:
      a missing measure then counts as 0 with full weight).
    * carry:     columns of the crosswalk carried along (deterministic ``min``).

    ``unallocated`` holds measure rows whose source key is missing or has no
    crosswalk row (the source pipeline turned these into a bogus group).
    """
    additive = list(additive or [])
    weighted = list(weighted or [])
    carry = list(carry or [])
    if weight_mode not in ("any", "per_column"):
        raise ValueError("weight_mode must be 'any' or 'per_column'")

    m = measures.select(src_key, *additive, *weighted)
    x = xwalk.where(F.col(dst_key).isNotNull()).select(src_key, dst_key, ratio, *carry)
    j = x.join(m, on=src_key, how="left")
    r = F.coalesce(F.col(ratio).cast("double"), F.lit(0.0))

    aggs = []
    for c in additive:
        aggs.append(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * r).alias(c))
    if weighted:
        any_present = F.lit(False)
        for c in weighted:
            any_present = any_present | F.col(c).isNotNull()
        for c in weighted:
            num = F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * r)
            present = any_present if weight_mode == "any" else F.col(c).isNotNull()
            den = F.sum(F.when(present, r).otherwise(F.lit(0.0)))
            aggs.append(F.try_divide(num, F.when(den != 0, den)).alias(c))
    for c in carry:
        aggs.append(F.min(c).alias(c))
    allocated = j.groupBy(dst_key).agg(*aggs) if aggs else j.select(dst_key).distinct()

    unallocated = (measures.join(x.select(src_key).distinct(), on=src_key, how="left_anti"))
    return allocated, unallocated


def ratio_report(xwalk: DataFrame, src_key: str, ratio: str, tol: float = 1e-6) -> DataFrame:
    """Source keys whose ratios do not sum to 1 (within ``tol``)."""
    return (xwalk.groupBy(src_key).agg(F.sum(ratio).alias("ratio_sum"))
            .where(F.abs(F.col("ratio_sum") - 1.0) > tol))
