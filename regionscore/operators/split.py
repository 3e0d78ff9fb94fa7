"""Deterministic stratified train/test split and stratified k-fold (M-2…M-4).

Rows are ordered inside their stratum by ``md5(key|seed)`` (``hash_rank``), so
the split is reproducible, exact in its per-stratum counts, independent of
partitioning, and equal to the SQL ``row_number() OVER (PARTITION BY stratum
ORDER BY md5(...), key)``.  ``sampleBy``/``randomSplit`` are inexact and
depend on partition layout, so they are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.operators.quantile import hash_rank


def stratified_split(df: DataFrame, key: str, stratum: Column | str, test_frac: float = 0.2,
                     seed: int = 42, out_col: str = "split") -> DataFrame:
    """Adds ``split`` in {'train', 'test'}: the first ceil(test_frac · n_s) rows of each stratum are test."""
    s = F.col(stratum) if isinstance(stratum, str) else stratum
    d = hash_rank(df.withColumn("_stratum", s), ["_stratum"], key, seed)
    n_test = F.ceil(F.col("_n") * F.lit(float(test_frac)))
    return (d.withColumn(out_col, F.when(F.col("_rank") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_stratum", "_rank", "_n"))


def kfold(df: DataFrame, key: str, stratum: Column | str, k: int = 5, seed: int = 42,
          out_col: str = "fold") -> DataFrame:
    """Adds ``fold`` in 0..k-1, dealt round-robin along the hash order inside each stratum."""
    s = F.col(stratum) if isinstance(stratum, str) else stratum
    d = hash_rank(df.withColumn("_stratum", s), ["_stratum"], key, seed)
    return d.withColumn(out_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_stratum", "_rank", "_n")


def holdout(df: DataFrame, key: str, stratum: Column | str, frac: float = 0.1, seed: int = 7,
            out_col: str = "is_valid") -> DataFrame:
    """Inner validation flag for early stopping (``validationIndicatorCol``)."""
    d = stratified_split(df, key, stratum, frac, seed, "_part")
    return d.withColumn(out_col, F.col("_part") == "test").drop("_part")
