"""Operator 7: token counts by a separator scan over flat token files.

A flat token file is a run of little-endian unsigned token ids; documents end
with a separator id, and nothing else says where. Files are read in blocks that
end anywhere. Each block is searched for separators in one vectorised compare,
and gives the lengths between them, the tokens before its first and after its
last one. A prefix scan over the blocks of a file (one row a block) carries the
unfinished tokens, over any number of blocks without a separator, to the block
where their document ends.

``pack`` writes the texts of a table as such files: one file a task, kept as a
table of blocks (file, block, data) in the shared folder, so that any store
that Spark reaches will do, with the ids of the documents that end in a block
beside it. ``read_files`` gives the blocks of token files from elsewhere.

Defined results: null and empty texts are documents of no tokens; tokens after
the last separator are a document that has not ended; repeated rows are
documents of their own; an empty file has no documents. A block whose bytes are
no whole number of ids raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionscore.llm.common import shared_table
from regionscore.llm.secret_scan import load

ID = np.dtype("<u2")


def pack(docs: DataFrame, path: str, pattern: str, separator: int, text: str = "text", doc_id: str = "doc_id",
         block_tokens: int = 1 << 18) -> DataFrame:
    """Flat token files of all texts, as a table of blocks: file, block, data, doc_ids (those that end in it, in order)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block = load(path, pattern).encode_ordinary, TaskContext.get().partitionId(), 0
        stream, ends = np.array([], ID), []  # ends: (place in the stream, id) of documents

        def cut(size: int) -> pa.RecordBatch:
            nonlocal stream, ends, block
            ids = [i for at, i in ends if at < size]
            out = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([stream[:size].tobytes()], pa.binary()),
                 pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "doc_ids"])
            stream, ends, block = stream[size:], [(at - size, i) for at, i in ends if at >= size], block + 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pieces, place = [stream], len(stream)
                for i, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(x.as_py()), separator], ID)
                    place += len(ids)
                    pieces.append(ids)
                    ends.append((place - 1, i))
                stream = np.concatenate(pieces)
                while len(stream) >= block_tokens:
                    yield cut(block_tokens)
        if len(stream):
            yield cut(len(stream))

    return shared_table(rows.mapInArrow(run, "file int, block long, data binary, doc_ids array<long>"), "tokens", "zstd")


def read_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks (file, block, data) of the token files under ``path``, each below the 2 GB of a binary value."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content"), F.col("length"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))
    return (files.filter("length > 0").withColumn("at", F.explode(starts))
            .select("file", F.floor(F.col("at") / block_bytes).alias("block"),
                    F.substring("content", (F.col("at") + 1).cast("int"), F.lit(block_bytes)).alias("data")))


def scan(blocks: DataFrame, separator: int) -> DataFrame:
    """blocks without data, and tokens, lengths (up to each separator), starts, tail (tokens after the last separator).

    starts: where in the block each document begins, the one after the last separator too.
    """
    others = [c for c in blocks.columns if c != "data"]
    rows = blocks.select(F.struct(*others).alias("row"), "data")
    shape = rows.select("row", F.lit(0).cast("long").alias("tokens"), F.array(F.lit(0).cast("long")).alias("lengths"),
                        F.array(F.lit(0).cast("long")).alias("starts"), F.lit(0).cast("long").alias("tail")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, lengths, starts, tails = [], [], [], []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_buffer(), ID)
                ends = np.flatnonzero(ids == separator)
                tokens.append(len(ids))
                lengths.append(np.diff(ends, prepend=-1) - 1)
                starts.append(np.concatenate(([0], ends + 1)))
                tails.append(len(ids) - 1 - ends[-1] if len(ends) else len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(lengths, pa.list_(pa.int64())),
                                              pa.array(starts, pa.list_(pa.int64())), pa.array(tails, pa.int64())],
                                             ["row", "tokens", "lengths", "starts", "tail"])

    return rows.mapInArrow(run, shape).select("row.*", "tokens", "lengths", "starts", "tail")


def token_counts(blocks: DataFrame, separator: int, doc_ids: str | None = None) -> DataFrame:
    """One row per document: file, document (its number in the file), start (its first token), n_tokens, ended.

    doc_ids: a column of ``blocks`` with the ids of the documents that end in each block, for a column doc_id.
    """
    columns = ["file", "block", "data"] + ([doc_ids] if doc_ids else [])
    found = scan(blocks.select(*columns), separator)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = (found.withColumn("n", F.size("lengths"))
             .withColumn("begin", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
             .withColumn("number", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .withColumn("last", F.row_number().over(order) == F.count("*").over(Window.partitionBy("file"))))
    # what is open at a block's begin: the tails since the block with the separator before
    found = found.withColumn("open", F.coalesce(F.lag("tail").over(order), F.lit(0)))
    found = found.withColumn("carry", F.sum("open").over(Window.partitionBy("file", "number").orderBy("block")))
    first = F.transform("lengths", lambda x, i: F.when(i == 0, x + F.col("carry")).otherwise(x))
    left = F.when(F.col("n") == 0, F.col("carry") + F.col("tail")).otherwise(F.col("tail"))
    open_end = F.when(F.col("last") & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>"))
    ids = [F.col(doc_ids).alias("ids")] if doc_ids else []
    whole = (found.withColumn("all", F.concat(first, open_end))
             .select("file", "number", "begin", "carry", "n", F.posexplode_outer("all").alias("i", "n_tokens"), "starts", *ids)
             .filter("i is not null"))
    starts = F.col("begin") + F.get("starts", F.col("i")) - F.when(F.col("i") == 0, F.col("carry")).otherwise(0)
    out = [F.get("ids", F.col("i")).alias("doc_id")] if doc_ids else []
    return whole.select("file", (F.col("number") + F.col("i")).alias("document"), starts.alias("start"), "n_tokens",
                        (F.col("i") < F.col("n")).alias("ended"), *out)
