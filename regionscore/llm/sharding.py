"""Operator 11: contiguous shards of equal bytes, from prefix sums of sizes.

All rows stand in one order: by doc_id (null last), then size, CRC-32 and
XXH64 of the text. They are stored in ranges of that order; each range gives its
total of bytes and rows, and the prefix sums of these totals, one row a range,
say where each range begins. A window inside a range then gives every row its
place in the whole. The bytes are cut at equal targets: a row belongs to the
shard that holds its middle byte, so that each cut lies within half a row of its
target and a shard's size is off by less than one row's size.

The ranges' last key is the place of the row in the input, which only tells equal
rows apart: a text or id that a third of the rows have is spread over as many
ranges as its share asks for. Equal texts may hence lie in several shards. Two
shuffles: by range and, since each range is a task of its own, by range number;
of the texts only if they are carried. Sums are integers and exact as long as
2 * shards * bytes is below 2**63. No Python runs on the executors.

Defined results: null text has the size of the empty one; null ids come last;
rows that agree in id and text are interchangeable, each has a slot of its own; a
row larger than a target fills shards alone, and shards in its middle stay empty,
as do some when there are fewer rows than shards; an empty table gives no rows.
Names of other columns are free, since ``row`` holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import fresh, partitions
from regionscore.llm.ordering import in_ranges

#: Bytes counted for a row besides its text.
ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id",
                  carry: list[str] | None = None) -> DataFrame:
    """One row per document: row (a struct of the columns in ``carry``; all, if none), size, text_crc32, shard, slot."""
    kept = docs.columns if carry is None else carry
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
                       F.xxhash64(whole).alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_last(), *map(F.col, ("size", "text_crc32", "digest", "place"))]
    stored = in_ranges(rows, order, "shards")

    earlier, everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = stored.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))  # a row a range
    begins = totals.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total"))
    inside = Window.partitionBy("range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (stored.withColumn("upto", F.sum("size").over(upto)).withColumn("k", F.row_number().over(inside))
              .join(F.broadcast(begins), "range")
              .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
              .withColumn("shard", F.expr(f"int(middle * {int(shards)} div (2 * total))"))
              .withColumn("at", F.col("rows_before") + F.col("k") - 1))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row a shard; reads no text
    return (placed.join(F.broadcast(first), "shard")
            .select("row", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> str:
    """Write all of ``docs`` as Parquet folders <shard column>=0 and so on; returns the name of that column.

    A shard's files are in the order of its slots, and each file holds a range of them.
    """
    name = fresh(docs.columns, "shard")
    rows = assign_shards(docs, shards, text, doc_id).repartitionByRange(partitions(docs.sparkSession), "shard", "slot")
    (rows.sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(name))
     .write.partitionBy(name).parquet(path))
    return name
