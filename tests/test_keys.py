from pyspark.sql import functions as F

from regionscore.functions import keys as K


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o")).collect()]


def test_pad_code_never_truncates_and_keeps_sign(spark):
    out = _one(spark, lambda c: K.pad_code(c, 5), ["1001", " 01001 ", "1234567", "-12", "7"])
    assert out == ["01001", "01001", "1234567", "-0012", "00007"]


def test_normalise_code_strips_float_suffix_and_null_likes(spark):
    out = _one(spark, lambda c: K.normalise_code(c, 5), ["1001.0", "nan", None, "", "<NA>", "42"])
    assert out == ["01001", None, None, None, None, "00042"]


def test_title_case_matches_python_title(spark):
    vals = ["o'brien-st. mary", "miami-dade", "ST. LOUIS", "prince george's"]
    assert _one(spark, K.title_case, vals) == [v.title() for v in vals]


def test_state_full_name(spark):
    out = _one(spark, K.state_full_name, ["VA", "va", "virginia", " new york ", "", None, "XX"])
    assert out == ["Virginia", "Virginia", "Virginia", "New York", "", "", "Xx"]


def test_county_form_and_suffix_strip(spark):
    assert _one(spark, K.county_form, ["loudoun", "Loudoun County", "  ", None]) == \
        ["Loudoun County", "Loudoun County", "", ""]
    assert _one(spark, K.strip_place_suffix, ["Autauga County, Alabama", "Kent"]) == ["Autauga County", "Kent"]


def test_combine_codes_pads_each_part(spark):
    df = spark.createDataFrame([("1", "7"), ("51", "107")], "s string, c string")
    out = [r[0] for r in df.select(K.combine_codes(["s", "c"], [2, 3])).collect()]
    assert out == ["01007", "51107"]
