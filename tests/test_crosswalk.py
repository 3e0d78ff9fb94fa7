import pytest

from regionscore.operators.crosswalk import crosswalk_allocate, crosswalk_ratio, ratio_report


@pytest.fixture()
def xw(spark):
    # zip 10001 spans two counties 0.7 / 0.3; 10002 ratios sum to 0.9; county C has no measured zip
    return spark.createDataFrame([
        ("10001", "A", 0.7), ("10001", "B", 0.3), ("10002", "B", 0.5), ("10002", "A", 0.4),
        ("10003", "C", 1.0)], "zip string, county string, ratio double")


@pytest.fixture()
def measures(spark):
    return spark.createDataFrame([
        ("10001", 10.0, 1.0, 2.0), ("10002", 20.0, None, 4.0), ("99999", 5.0, 9.0, 9.0)],
        "zip string, n double, ind double, com double")


def _rows(df, key="county"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_additive_allocation(spark, xw, measures):
    out, unalloc = crosswalk_allocate(measures, xw, "zip", "county", "ratio", additive=["n"])
    got = _rows(out)
    assert got["A"]["n"] == pytest.approx(10 * 0.7 + 20 * 0.4)
    assert got["B"]["n"] == pytest.approx(10 * 0.3 + 20 * 0.5)
    assert got["C"]["n"] == 0.0  # county with no measured zip
    assert [r["zip"] for r in unalloc.collect()] == ["99999"]  # zip with no county


def test_additive_conserves_total_when_ratios_sum_to_one(spark, xw, measures):
    xw1 = xw.where("zip <> '10002'")
    out, unalloc = crosswalk_allocate(measures.where("zip = '10001'"), xw1, "zip", "county", "ratio", additive=["n"])
    assert sum(r["n"] for r in out.collect()) == pytest.approx(10.0)


def test_weighted_modes_differ_on_partial_measures(spark, xw, measures):
    per, _ = crosswalk_allocate(measures, xw, "zip", "county", "ratio", weighted=["ind", "com"])
    anyw, _ = crosswalk_allocate(measures, xw, "zip", "county", "ratio", weighted=["ind", "com"], weight_mode="any")
    p, a = _rows(per), _rows(anyw)
    # per column: zip 10002 has no industrial price, so it carries no weight for "ind"
    assert p["A"]["ind"] == pytest.approx(1.0)
    # "any" (source rule): missing industrial counts as 0 with full weight
    assert a["A"]["ind"] == pytest.approx((1.0 * 0.7) / (0.7 + 0.4))
    assert p["A"]["com"] == pytest.approx((2 * 0.7 + 4 * 0.4) / 1.1)
    assert p["C"]["ind"] is None and p["C"]["com"] is None  # zero weight -> null, row kept


def test_ratio_and_report(spark):
    df = spark.createDataFrame([("z1", "A", 3.0), ("z1", "B", 1.0), ("z2", "A", 2.0)], "z string, c string, w double")
    r = {(x["z"], x["c"]): x["ratio"] for x in crosswalk_ratio(df, "z", "c", "w").collect()}
    assert r == {("z1", "A"): 0.75, ("z1", "B"): 0.25, ("z2", "A"): 1.0}
    bad = spark.createDataFrame([("z", 0.5)], "zip string, ratio double")
    assert ratio_report(bad, "zip", "ratio").count() == 1
