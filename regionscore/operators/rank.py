"""Global ranking and top-k without single-task windows (W-1, T-1...T-3, J-8).

``global_rank`` gives the exact 1-based position of every row in a total order
(score desc, key asc).  Rows are cut into chunks at approximate quantiles of the
score; rows that tie at a cut are a chunk of their own, cut again at approximate
quantiles of the key, so that a third of all rows with one score are spread like
any others.  Chunk sizes are prefix-summed, and a window inside each chunk
finishes the count.  A plain ``row_number() over (order by ...)`` would move
every row into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.session import cut_lineage


def _order_number(df: DataFrame, key: str):
    """A double that orders as the key does, but for ties: the number itself, or the first seven bytes of its text."""
    if isinstance(df.schema[key].dataType, T.NumericType):
        return F.col(key).cast("double")
    return F.conv(F.rpad(F.substring(F.hex(F.col(key).cast("string")), 1, 14), 14, "0"), 16, 10).cast("double")


def global_rank(df: DataFrame, score: str, key: str, rank_col: str = "rank", descending: bool = True,
                chunks: int = 256, accuracy: int = 10000) -> DataFrame:
    s = (-F.col(score)) if descending else F.col(score)
    d = df.withColumn("_s", s.cast("double")).withColumn("_k", _order_number(df, key))
    at = [i / chunks for i in range(1, chunks)]
    cuts = d.agg(F.array_distinct(F.percentile_approx("_s", at, accuracy)).alias("_cuts"),
                 F.array_distinct(F.percentile_approx("_k", at, accuracy)).alias("_keys"))
    d = d.crossJoin(F.broadcast(cut_lineage(cuts)))  # one row
    below = F.size(F.filter("_cuts", lambda x: x < F.col("_s")))
    tied = F.col("_s").isNull() | F.coalesce(F.array_contains("_cuts", F.col("_s")), F.lit(False))
    # even: between two cuts; odd: at a cut
    d = d.withColumn("_chunk", F.when(F.col("_s").isNull(), 2 * chunks + 1).otherwise(2 * below + tied.cast("int")))
    d = d.withColumn("_part", F.when(tied, F.coalesce(F.size(F.filter("_keys", lambda x: x < F.col("_k"))), F.lit(-1)))
                     .otherwise(0)).drop("_cuts", "_keys")
    per = d.groupBy("_chunk", "_part").agg(F.count(F.lit(1)).alias("_cc"))
    before = per.select("_chunk", "_part", F.coalesce(F.sum("_cc").over(
        Window.orderBy("_chunk", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_chunk", "_part").orderBy(F.col("_s").asc_nulls_last(), F.col(key))
    out = d.join(F.broadcast(before), ["_chunk", "_part"])  # two times chunks squared rows at most
    return (out.withColumn(rank_col, F.col("_before") + F.row_number().over(w))
            .drop("_s", "_k", "_chunk", "_part", "_before"))


def export_ranking(ranked: DataFrame, path: str, rank_col: str = "rank") -> None:
    """CSV of a ranking with its rank, in order (range partitions by rank, one file each)."""
    ranked.orderBy(rank_col).write.mode("overwrite").option("header", True).csv(path)


def top_k(df: DataFrame, score: str, key: str, k: int, descending: bool = True) -> DataFrame:
    """Top-k report (TakeOrderedAndProject: per-task heaps, k rows to the driver)."""
    o = F.col(score).desc() if descending else F.col(score).asc()
    return df.orderBy(o, F.col(key)).limit(k)


def semi_by_keys(df: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    return df.join(keys_df.select(key), key, "left_semi")


def sorted_distinct(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])).distinct().orderBy(*cols)
