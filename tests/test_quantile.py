import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionscore.operators import quantile as Q
from regionscore.operators.quantile import exact_quantiles, hash_rank, prefix_sums
from regionscore.operators.rank import global_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    # group "hot" holds a third of the rows; values have ties
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", float(rng.integers(0, 500))) for i in range(6000)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_exact_quantiles_match_numpy(spark, skewed):
    df, rows = skewed
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"q25": 0.25, "med": 0.5, "q90": 0.9}, chunks=16).collect()}
    for g in out:
        vals = np.array([v for k, v in rows if k == g])
        assert out[g]["q25"] == pytest.approx(np.quantile(vals, 0.25))
        assert out[g]["med"] == pytest.approx(np.median(vals))
        assert out[g]["q90"] == pytest.approx(np.quantile(vals, 0.9))


def test_prefix_sums(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(100)], "s double, c double")
    out = {r["s"]: r["c_before"] for r in prefix_sums(df, [], "s", ["c"], chunks=8).collect()}
    assert all(out[float(i)] == i for i in range(100))


def test_global_rank_is_total_order(spark):
    rows = [(i, float(i % 17)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, s double")
    got = [(r["rank"], r["k"]) for r in global_rank(df, "s", "k", chunks=8).collect()]
    expect = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert sorted(got) == [(i + 1, k) for i, (k, _) in enumerate(expect)]


def test_hash_rank_dense_per_stratum(spark):
    df = spark.range(300).withColumn("s", (F.col("id") % 2).cast("int"))
    r = hash_rank(df, ["s"], "id", 42, prefix_hex=1)
    for s in (0, 1):
        ranks = sorted(x["_rank"] for x in r.where(F.col("s") == s).collect())
        assert ranks == list(range(1, 151))


def test_rank_spreads_ties(spark):
    """A third of all rows with one score, and null scores, are cut by key as well; text keys too."""
    rows = [(i, None if i % 11 == 0 else 0.0 if i % 3 == 0 else float(i % 97), f"k{i * 7919 % 4000:05d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, s double, t string")
    for key, at in (("k", 0), ("t", 2)):
        got = {r[key]: r["rank"] for r in global_rank(df, "s", key, chunks=16).collect()}
        expect = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[at]))
        assert [got[r[at]] for r in expect] == list(range(1, 4001))


def test_quantile_plan_has_no_cartesian_product_and_no_group_only_join(spark, skewed, monkeypatch):
    df, rows = skewed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)  # as with more groups than may be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_of = lambda d: d._jdf.queryExecution().executedPlan().toString()
        stored, cut = [], Q.cut_lineage
        monkeypatch.setattr(Q, "cut_lineage", lambda d: stored.append(plan_of(d)) or cut(d))
        found = Q.exact_quantiles(df, ["g"], "v", {"med": 0.5})
        plan = plan_of(found)
        assert "CartesianProduct" not in "".join([plan, *stored]) and "_salt" in stored[-1]  # the scan that counts all rows
        for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", "".join(stored)):
            assert "_salt" in keys
        for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", plan):  # of counts, by group and segment
            assert "_s#" in keys
        assert {r["g"]: r["med"] for r in found.collect()} == {
            g: pytest.approx(np.median([v for k, v in rows if k == g])) for g in {g for g, _ in rows}}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_segments_are_cut_before_they_are_ranked(spark, monkeypatch):
    """Two rounds: no window holds more than a few times the bound, and the result stays exact."""
    monkeypatch.setattr(Q, "WINDOW_ROWS", 1000)
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    sizes = []
    plain = Q.prefix_sums
    monkeypatch.setattr(Q, "prefix_sums", lambda d, k, o, s, chunks: sizes.append((d.count(), chunks)) or plain(d, k, o, s, chunks))
    got = exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.999}, chunks=64).first()
    values = np.array([r.v for r in df.select("v").collect()])
    assert tuple(got) == pytest.approx(tuple(np.quantile(values, [0.1, 0.5, 0.999])))
    assert len(sizes) == 1 and sizes[0][0] > 5 * 1000 and sizes[0][0] / sizes[0][1] < 2 * 1000  # more than one window's bound, cut below it


def test_quantiles_at_the_ends_and_of_few_rows(spark):
    rng = np.random.default_rng(8)
    rows = [("one", 5.0), ("two", 1.0), ("two", 2.0), ("inf", float("inf")), ("inf", -float("inf")), ("inf", 0.0), ("nan", float("nan")), (None, 3.0)]
    rows += [("many", float(x)) for x in rng.normal(0, 1, 3001)] + [("tied", float(i % 3)) for i in range(900)] + [("neg", -float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p1": 0.01, "p3": 1 / 3, "p5": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"one", "two", "inf", "many", "tied", "neg"}
    for g in set(got) - {"inf"}:
        assert got[g] == pytest.approx(tuple(np.quantile([v for k, v in rows if k == g], list(probs.values()))))
    assert got["inf"][3] == 0.0 and got["inf"][0] == -float("inf")
