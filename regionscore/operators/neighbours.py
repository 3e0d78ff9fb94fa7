"""Exact k nearest neighbours by cells and the triangle inequality (A-13).

Every row lies in the cell of its nearest centre; centres are a bounded sample of
the rows. Cells are cut into bands of the distance to the centre, and a band with
many rows (a vector that a third of them share) by hash, so that a piece has a
bounded number of rows. For a query q at distance d from a centre, no row of a
band [a, b] around it is nearer than max(0, d - b, a - d).

A first round scores the pieces of the nearest centres until they hold more than
k rows; the k-th distance found is an upper bound. The second scores all
other pieces whose lower bound does not exceed it: what is left out can't be among
the k nearest, so the answer is exact, ties by key. A piece meets its queries in
tiles of bounded sizes, and each tile keeps k rows a query.

Broadcast are the centres and a row of numbers for each piece, both bounded by
parameters. A vector is moved once to be stored by pieces, and once for each
block of queries that ask its piece.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from regionscore.session import checkpoint_dir

#: Relative and absolute room for rounding in bounds.
SLACK = 1e-9


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


class Pieces:
    """Centres and the pieces of their cells: which pieces a query has to see."""

    def __init__(self, centres: np.ndarray, cell, low, high, rows):
        self.centres, self.cell, self.low, self.high, self.rows = centres, cell, low, high, rows

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """Pieces of the nearest centres, of a cell by their lower bounds, that hold more than k rows."""
        d, bounds = self._bounds(q)
        order = np.lexsort((bounds, d))
        return order[:np.searchsorted(np.cumsum(self.rows[order]), k + 1) + 1]

    def second(self, q: np.ndarray, k: int, most: float) -> np.ndarray:
        """The others that may hold a row at distance ``most`` or less."""
        near = self._bounds(q)[1] * (1 - SLACK) - SLACK <= most
        near[self.first(q, k)] = False
        return np.flatnonzero(near)

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(self.centres, q)[self.cell]
        return d, np.maximum(0, np.maximum(d - self.high, self.low - d))


def _indexed(base: DataFrame, n: int, centres: np.ndarray, piece_rows: int, bands: int) -> tuple[DataFrame, Pieces]:
    """(piece, _id, _v), stored, and the pieces."""
    schema = base.schema

    def assign(batches):
        for batch in batches:
            v = _matrix(batch.column(1))
            cell, r = np.zeros(len(v), np.int32), np.full(len(v), np.inf)
            for c, centre in enumerate(centres):
                d = _distances(v, centre)
                cell, r = np.where(d < r, c, cell), np.minimum(r, d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(r)], ["_id", "_v", "cell", "r"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    rows = _stored(base.mapInArrow(assign, f"{kinds}, cell int, r double"), "cells")
    if bands > 1:
        cuts = rows.groupBy("cell").agg(F.array_distinct(F.percentile_approx("r", [i / bands for i in range(1, bands)])).alias("cuts"))
        rows = rows.join(F.broadcast(cuts), "cell")  # a row a centre
        rows = rows.withColumn("band", F.size(F.filter("cuts", lambda x: x < F.col("r")))).drop("cuts")
    else:
        rows = rows.withColumn("band", F.lit(0))
    parts = rows.groupBy("cell", "band").agg(F.ceil(F.count("*") / piece_rows).alias("parts"))
    rows = rows.join(F.broadcast(parts), ["cell", "band"]).withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")))
    found = rows.groupBy("cell", "band", "part").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    found = sorted(tuple(r) for r in found.collect())  # at most centres * bands + n / piece_rows
    number = rows.sparkSession.createDataFrame([(*p[:3], i) for i, p in enumerate(found)], "cell int, band int, part bigint, piece int")
    rows = _stored(rows.join(F.broadcast(number), ["cell", "band", "part"]).select("piece", "_id", "_v"), "pieces")
    cell, _, _, count, low, high = (np.array(x) for x in zip(*found, strict=True))
    return rows, Pieces(centres, cell, low, high, count)


def _asked(asked: DataFrame, pieces: Pieces, k: int, second: bool) -> DataFrame:
    """(piece, query_id, _q) of the pieces that each query is to see in a round."""
    kind = asked.schema["query_id"].dataType.simpleString()

    def pairs(batches):
        for batch in batches:
            for i, q in enumerate(_matrix(batch.column(1))):
                found = pieces.second(q, k, batch.column(2)[i].as_py()) if second else pieces.first(q, k)
                at = pa.array(np.full(len(found), i))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)],
                                                     ["piece", "query_id", "_q"])

    return asked.mapInArrow(pairs, f"piece int, query_id {kind}, _q array<double>")


def _scored(rows: DataFrame, pairs: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, neighbor_id, distance, scored): of each piece the k nearest to each query that asks it."""
    pairs = _stored(pairs, "asked")
    blocks = F.broadcast(pairs.groupBy("piece").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # a row a piece
    pairs = pairs.join(blocks, "piece").select("piece", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "_q")
    rows = rows.join(blocks, "piece").select("piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "_id", "_v")
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"query_id {kind}, neighbor_id {kind}, distance double, scored long"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = left.column("_id").to_pylist(), _matrix(left.column("_v"))
        out = []
        for query, q in zip(right.column("query_id").to_pylist(), _matrix(right.column("_q")), strict=True):
            if not ids:
                break
            d = _distances(v, q)
            most = np.partition(d, k)[k] if len(d) > k + 1 else np.inf  # one more than k: one of them may be the query
            near = sorted((d[i], ids[i]) for i in np.flatnonzero(d <= most) if ids[i] != query)[:k]
            out += [(query, x, float(y), len(ids) if j == 0 else 0) for j, (y, x) in enumerate(near)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    keys = ["piece", "block"]
    return _stored(rows.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(score, schema), "scored")


def knn(df: DataFrame, key: str, vec: str, query_ids: list | Column, k: int = 5, most_centres: int = 1024, piece_rows: int = 10_000,
        most_bands: int = 32, block: int = 5_000, scored: bool = False) -> DataFrame:
    """query_id, neighbor_id, distance, nn_rank: the k nearest rows (Euclidean) of each query row, itself excluded by key.

    The query rows are a list of ids, or those for which a condition holds, however many. Ties go by key. Rows without
    a vector are neither asked nor found. With ``scored``, how many rows were compared with each query.
    """
    spark, wide = df.sparkSession, F.transform(vec, lambda x: x.cast("double"))
    base = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("_id"), wide.alias("_v"))
    condition = query_ids if isinstance(query_ids, Column) else F.col(key).isin(list(query_ids))
    asked = df.where(condition & F.col(vec).isNotNull()).select(F.col(key).alias("query_id"), wide.alias("_q"))
    n = base.count()
    names = ["query_id", "neighbor_id", "distance", "nn_rank", *(["scored"] if scored else [])]
    kind = base.schema["_id"].dataType.simpleString()
    if n == 0:
        kinds = (kind, kind, "double", "int", "long")
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in zip(names, kinds, strict=False)))
    sample = base.orderBy(F.xxhash64("_id")).limit(min(most_centres, max(1, math.isqrt(n)))).select("_v").collect()
    centres = np.unique(np.array([r._v for r in sample]), axis=0)
    bands = max(1, min(most_bands, n // (256 * len(centres))))
    rows, pieces = _indexed(base, n, centres, max(piece_rows, n // 100_000), bands)

    one = _scored(rows, _asked(asked, pieces, k, False), k, block)
    by_distance = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    kth = one.withColumn("i", F.row_number().over(by_distance)).filter(F.col("i") == k).select("query_id", F.col("distance").alias("most"))
    bounded = asked.join(kth, "query_id", "left").select("query_id", "_q", F.coalesce("most", F.lit(math.inf)).alias("most"))
    two = _scored(rows, _asked(bounded, pieces, k, True), k, block)
    found = one.unionByName(two)  # k rows a query and piece it saw
    found = found.withColumn("nn_rank", F.row_number().over(by_distance)).withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
    return found.where(F.col("nn_rank") <= k).select(names)
