"""Rows in a global order without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.llm.common import partitions, shared_table


def in_ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, stored in the shared folder by ranges of ``order``, with the column range (int, ascending with the order).

    The last of ``order`` should be unique, so that a value that a third of the
    rows have is cut as well. Spark samples the ranges anew for every job, hence
    the table: all later steps see the same ranges.
    """
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order)
    return shared_table(ranged.withColumn("range", F.spark_partition_id()), name, "zstd")
