import json

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from regionscore.session import checkpoint_dir
from regionscore.plans.spec import TableSpec, compile_spec
from regionscore.sources import readers as RD


def test_csv_dtypes_thousands_special_and_names(spark, tmp_path):
    p = tmp_path / "grid.csv"
    p.write_text('County FIPS,State,"Natural\nGas",Solar\n1001,AL,<10,"1,234"\n1003,AL,12,x\n')
    spec = TableSpec(keys={"county_fips": "County FIPS", "state": "State"},
                     value_columns={"natural_gas": "Natural Gas", "solar": "Solar"},
                     special_values={"Natural Gas": {"<10": "5"}},
                     dtypes={"county_fips": "string", "natural_gas": "float64", "solar": "float64"},
                     pad={"county_fips": 5},
                     proxies={"energy": {"kind": "row_sum", "columns": ["natural_gas", "solar"]}})
    raw = spark.read.option("header", True).option("multiLine", True).csv(str(p))
    out = {r["county_fips"]: r for r in compile_spec(spec)(raw).collect()}
    assert out["01001"]["natural_gas"] == 5.0 and out["01001"]["solar"] == 1234.0
    assert out["01003"]["solar"] is None and out["01003"]["energy"] == 12.0


def test_detect_format_union_and_discover(spark, tmp_path):
    (tmp_path / "datacenter_a.csv").write_text("zip,name\n20147,A\n")
    (tmp_path / "datacenter_b.csv").write_text("zip\tname\n20148\tB\n")
    (tmp_path / "other.csv").write_text("zip,name\n1,x\n")
    paths = [str(tmp_path / "datacenter_a.csv"), str(tmp_path / "datacenter_b.csv")]
    fmt = {r["path"].split("/")[-1]: (r["encoding"], r["sep"]) for r in RD.detect_format(spark, paths).collect()}
    assert fmt["datacenter_a.csv"] == ("utf-8", ",") and fmt["datacenter_b.csv"] == ("utf-8", "\t")
    u = RD.read_union(spark, paths, ["zip", "name"], [fmt["datacenter_a.csv"], fmt["datacenter_b.csv"]])
    assert sorted(r["zip"] for r in u.collect()) == ["20147", "20148"]
    d = RD.discover(spark, str(tmp_path), "datacenter", ["zip", "name"])
    assert d.count() == 2
    empty = RD.discover(spark, str(tmp_path / "missing"), "datacenter", ["zip", "name"])
    assert empty.count() == 0 and "zip" in empty.columns


def test_json_map_scan_and_inspection(spark, tmp_path):
    p = tmp_path / "verdicts.json"
    p.write_text(json.dumps({"u1": {"summary": "a", "llm_confidence": 0.9}, "u2": {"summary": "b"}}))
    schema = T.StructType([T.StructField("summary", T.StringType()), T.StructField("llm_confidence", T.DoubleType())])
    out = {r["url"]: r for r in RD.explode_json_map(spark, str(p), schema).collect()}
    assert out["u1"]["llm_confidence"] == 0.9 and out["u2"]["llm_confidence"] is None
    nation = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    info = RD.inspect_dtypes({"nation": nation})
    assert info.where(F.col("column") == "n_name").first()["dtype"] == "string"
    md = RD.to_markdown(nation.orderBy("n_nationkey"), max_rows=3)
    assert md.count("\n") == 5


def test_integers_keep_all_digits_and_overflow_is_null(spark):
    df = spark.createDataFrame([("9,007,199,254,740,993",), ("1e30",), ("12.0",), ("x",), (None,)], "n string")
    assert [r["n"] for r in RD.apply_dtypes(df, {"n": "int64"}).collect()] == [9007199254740993, None, 12, None, None]


def test_latin1_and_utf16_files_are_recognised(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("zip,name\n1,Café\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("zip\tname\n2\tÉté\n".encode("utf-16"))
    (tmp_path / "c.csv").write_bytes("zip,name\n3,Ñandú\n".encode())
    paths = [str(tmp_path / f"{x}.csv") for x in "abc"]
    found = {r["path"][-5]: (r["encoding"], r["sep"]) for r in RD.detect_format(spark, paths).collect()}
    assert found == {"a": ("latin-1", ","), "b": ("UTF-16LE", "\t"), "c": ("utf-8", ",")}
    rows = RD.read_union(spark, paths, ["zip", "name"], [found[x] for x in "abc"]).collect()
    assert {(r["zip"], r["name"]) for r in rows} == {("1", "Café"), ("2", "Été"), ("3", "Ñandú")}


def test_reports_of_files_and_registries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("zip,name\n1,x\n")
    (tmp_path / "b.csv").write_text("zip,other\n1,x\n2,y\n")
    got = {r["path"][-5]: (r["missing"], r["n_lines"]) for r in RD.header_report(spark, [str(tmp_path)], ["zip", "name"]).collect()}
    assert got == {"a": ([], 2), "b": (["name"], 3)}
    tables = {"good": lambda: spark.range(1), "gone": lambda: spark.read.parquet(str(tmp_path / "none"))}
    rows = {r["table"]: (r["column"], r["error"]) for r in RD.inspect_registry(spark, [tables]).collect()}
    assert rows == {"good": ("id", None), "gone": (None, "PATH_NOT_FOUND")}
    with pytest.raises(ValueError):
        RD.inspect_registry(spark, [tables, {"good": tables["good"]}])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError):
        checkpoint_dir(Session())
