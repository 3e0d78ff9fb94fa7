"""Nearest neighbours of as many queries as a condition gives, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionscore.operators import neighbours as NB

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    out = set()
    for q, a in rows:
        if q in asked:
            near = sorted((np.sqrt(((a - b) ** 2).sum()), i) for i, b in rows if i != q)[:k]
            out |= {(q, i, r + 1, round(float(d), 9)) for r, (d, i) in enumerate(near)}
    return out


def found(df):
    return {(r.query_id, r.neighbor_id, r.nn_rank, round(r.distance, 9)) for r in df.collect()}


def groups(n=1500, dim=6):
    """Rows around a few places, a third of them one vector, some alone and far away."""
    rng = np.random.default_rng(3)
    places = rng.normal(0, 40, (12, dim))
    v = places[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, dim))
    v[::3] = places[0]
    v[-5:] = rng.normal(0, 500, (5, dim))
    return [(i, x.astype("f4").astype(float)) for i, x in enumerate(v)]


@pytest.mark.parametrize("options", [{}, {"piece_rows": 40, "block": 5}, {"most_centres": 3, "most_bands": 8}, {"most_centres": 1}])
def test_every_row_whose_id_divides_by_a_hundred(spark, options):
    rows = groups()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows] + [(5000, None)], SCHEMA)
    got = NB.knn(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=4, scored=True, **options).cache()
    assert found(got) == brute(rows, set(range(0, 1500, 100)), 4) and got.count() == 60
    if not options:  # what lies far off is not looked at
        assert max(r.scored for r in got.collect()) < 1000 and got.agg(F.avg("scored")).first()[0] < 700


def test_asked_by_ids_few_rows_and_none(spark):
    rows = groups(40, 2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], SCHEMA)
    got = NB.knn(df, "vec_id", "embedding", [1, 2, 999], k=3)
    assert got.columns == ["query_id", "neighbor_id", "distance", "nn_rank"] and found(got) == brute(rows, {1, 2}, 3)
    assert found(NB.knn(df, "vec_id", "embedding", [0], k=100)) == brute(rows, {0}, 100)
    assert NB.knn(df, "vec_id", "embedding", [], k=3).count() == 0
    assert NB.knn(df.limit(0), "vec_id", "embedding", [1], k=3).count() == 0
    assert NB.knn(df.filter("vec_id = 3"), "vec_id", "embedding", [3], k=3).count() == 0
    names = df.select(F.concat(F.lit("k"), "vec_id").alias("vec_id"), "embedding")
    assert {(r.query_id, r.neighbor_id) for r in NB.knn(names, "vec_id", "embedding", ["k7"], k=2).collect()} == {
        ("k7", f"k{i}") for _, i, _, _ in brute(rows, {7}, 2)}
