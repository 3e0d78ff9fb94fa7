"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.session import checkpoint_dir
from regionscore.sources.tables import read_table

#: A word is a run without ASCII white space; the same in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, in compressed columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash60(c: Column) -> Column:
    """60-bit integer of md5(c): the same value in Spark and in DuckDB."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def named(name: str) -> Column:
    """The column of that very name, which may hold dots."""
    return F.col(f"`{name}`")


def row_of(docs: DataFrame, *without: str) -> Column:
    """A struct of the columns of ``docs`` but those."""
    return F.struct(*[named(c) for c in docs.columns if c not in without])


def whole_text(name: str) -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def fresh(names: list[str], base: str) -> str:
    """A column name that clashes with none of ``names`` (case-insensitively)."""
    low = {n.lower() for n in names}
    while base.lower() in low:
        base = "_" + base
    return base
