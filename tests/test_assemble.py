from regionscore.operators.assemble import drop_blank_keys, outer_assemble
from regionscore.operators.aggregate import pivot_first


def test_outer_assemble_suffixes_and_quarantine(spark):
    a = spark.createDataFrame([("01001", 1.0), (None, 2.0), ("nan", 3.0)], "k string, price double")
    b = spark.createDataFrame([("01001", 5.0), ("01003", 6.0), (None, 7.0)], "k string, price double")
    ka, ra = drop_blank_keys(a, ["k"])
    kb, rb = drop_blank_keys(b, ["k"])
    assert ra.count() == 2 and rb.count() == 1
    out = outer_assemble({"a": ka, "policy": kb}, "k")
    assert set(out.columns) == {"k", "price", "price_policy"}
    rows = {r["k"]: (r["price"], r["price_policy"]) for r in out.collect()}
    assert rows == {"01001": (1.0, 5.0), "01003": (None, 6.0)}
    assert out.count() >= max(ka.count(), kb.count())


def test_pivot_missing_category_duplicate_cell_null_index(spark):
    df = spark.createDataFrame([("c1", "IT", 10.0), ("c1", "IT", 12.0), ("c2", "Trade", 5.0), (None, "IT", 1.0)],
                               "county string, industry string, wage double")
    out = pivot_first(df, ["county"], "industry", ["IT", "Trade", "Prof"], "wage")
    rows = {r["county"]: r.asDict() for r in out.collect()}
    assert set(rows) == {"c1", "c2"}
    assert rows["c1"]["IT"] == 10.0 and rows["c1"]["Prof"] is None and rows["c2"]["Trade"] == 5.0
