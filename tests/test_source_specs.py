"""The nine public tables on literal rows: every spec, and the run from raw tables to a prepared, ranked county table."""

import math

import pytest
from pyspark.sql import functions as F

from regionscore.operators import evidence as E
from regionscore.operators.prep import Preprocessor
from regionscore.operators.rank import global_rank
from regionscore.plans import source_specs as S


def table(spark, rows):
    names = list(rows[0])
    return spark.createDataFrame([tuple(None if r[n] is None else str(r[n]) for n in names) for r in rows],
                                 ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="module")
def raw(spark):
    airports = {a: 0 for a in S.AIRPORTS.values()}
    hazards = {f"{h} - Hazard Type Risk Index Value": 1.5 for h in S.HAZARDS} | {c: 2 for c in S.COMMUNITY.values()}
    jobs = {j: 3 for j in S.JOBS.values()}
    wage = {"Area Type": "County", "Ownership": "Private"}
    net = {"geography_type": "County", "biz_res": "B"}
    zips = {"RES_RATIO": 1, "BUS_RATIO": 1, "OTH_RATIO": 1, "USPS_ZIP_PREF_CITY": "X"}
    return {
        "transportation": table(spark, [
            {"State": "Alabama", "County Name": "Autauga County", **airports, "Large Primary Airports": 1, "Small Primary Airports": 2,
             "All Rail Track": "1,000", "Docks": 0, "Good": 2, "Fair": 2, "Poor": 0},
            {"State": "Virginia", "County Name": "Loudoun County", **airports, "All Rail Track": None, "Docks": 4, "Good": 0, "Fair": 0,
             "Poor": 0}]),
        "environment_risk": table(spark, [
            {"State Name": "Alabama", "County Name": "Autauga", "County Type": "County", "State-County FIPS Code": "1001", **hazards},
            {"State Name": "Virginia", "County Name": "Loudoun", "County Type": "County", "State-County FIPS Code": "51107", **hazards,
             "Hurricane - Hazard Type Risk Index Value": None},
            {"State Name": "Nowhere", "County Name": "Blank", "County Type": "County", "State-County FIPS Code": None, **hazards}]),
        "labor_price": table(spark, [
            {"St Name": "Alabama", "Area": "Autauga County, Alabama", **wage, "Industry": i, "Annual Average Weekly Wage": "1,100"}
            for i in S.INDUSTRIES] + [
            {"St Name": "Alabama", "Area": "Autauga County, Alabama", **wage, "Ownership": "Total", "Industry": next(iter(S.INDUSTRIES)),
             "Annual Average Weekly Wage": "9"}]),
        "grid_infrastructure": table(spark, [
            {"County FIPS": "1001", "State": "AL", "County Name": "Autauga", **jobs, "Solar": "<10", "Natural Gas": "<10"},
            {"County FIPS": "51107", "State": "VA", "County Name": "Loudoun", **jobs, "Wind": None, "Natural Gas": 50}]),
        "high_speed_internet": table(spark, [
            {"geography_id": "51107", **net, "technology": t, "speed_100_20": k, "speed_1000_100": k / 2}
            for k, t in enumerate(S.TECHNOLOGIES, 1)] + [
            {"geography_id": "51107", **net, "biz_res": "R", "technology": "Fiber", "speed_100_20": 9, "speed_1000_100": 9}]),
        "land_price": table(spark, [{"County Code": "1001", "Year": y, S.LAND_VALUE: v} for y, v in ((2022, 1), (2023, "50,000"))]),
        "zip_to_fips": table(spark, [
            {"ZIP": "36003", "COUNTY": "1001", "USPS_ZIP_PREF_STATE": "AL", "TOT_RATIO": 0.25, **zips},
            {"ZIP": "36003", "COUNTY": "51107", "USPS_ZIP_PREF_STATE": "VA", "TOT_RATIO": 0.75, **zips},
            {"ZIP": "20147", "COUNTY": "51107", "USPS_ZIP_PREF_STATE": "VA", "TOT_RATIO": 1.0, **zips}]),
        "fips_to_county": table(spark, [
            {"Summary Level": "50", "State FIPS Code": "1", "County FIPS Code": "1", "Area Name": "Autauga County"},
            {"Summary Level": "050", "State FIPS Code": "51", "County FIPS Code": "107", "Area Name": "Loudoun County"},
            {"Summary Level": "050", "State FIPS Code": "51", "County FIPS Code": "0", "Area Name": "Virginia"},
            {"Summary Level": "040", "State FIPS Code": "51", "County FIPS Code": "9", "Area Name": "No"}]),
        "electricity_price": table(spark, [
            {"zip": "36003", "ownership": "a", "comm_rate": 0.10, "ind_rate": 0.04, "res_rate": 0.001},
            {"zip": "36003", "ownership": "b", "comm_rate": 0.20, "ind_rate": None, "res_rate": 0.003},
            {"zip": "20147", "ownership": "c", "comm_rate": 0.30, "ind_rate": 0.08, "res_rate": 0.2}]),
    }


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_every_spec(raw):
    t = S.county_tables(raw)
    assert set(t) == set(S.SPECS)
    moved = rows(t["transportation"], "county")
    assert moved["Autauga County",]["air_connectivity"] == pytest.approx(math.log1p(5 + 2 * 3))
    assert moved["Autauga County",]["rail_intensity"] == pytest.approx(math.log1p(1000))
    assert moved["Autauga County",]["infrastructure_quality"] == pytest.approx(0.75)
    assert moved["Loudoun County",]["infrastructure_quality"] is None and moved["Loudoun County",]["dock_presence"] == 1
    assert set(t["transportation"].columns) == {"state", "county", *S.SPECS["transportation"].proxies}
    risk = rows(t["environment_risk"], "county_fips")
    assert risk["01001",]["county"] == "Autauga County" and risk["51107",]["hurricane_risk_index_value"] is None
    wages = rows(t["labor_price"], "state", "county")
    assert {wages["Alabama", "Autauga County"][c] for c in S.INDUSTRIES.values()} == {1100.0}
    grid = rows(t["grid_infrastructure"], "county_fips")
    assert grid["01001",]["clean_energy_jobs"] == 5 + 3 + 3 and grid["51107",]["clean_energy_jobs"] == 6
    assert grid["01001",]["grid_infrastructure_jobs"] == 12 and grid["01001",]["epg_natural_gas"] == 5 and "epg_solar" not in grid["01001",]
    net = rows(t["high_speed_internet"], "county_fips")["51107",]
    assert net["fiber_availability"] == 0.5 and net["high_speed_wired_coverage"] == 1.0
    assert rows(t["land_price"], "county_fips") == {("01001",): {"county_fips": "01001", "land_value_1_4_acre_standardized": 50000.0}}
    assert set(rows(t["fips_to_county"], "county_fips")) == {("01001",), ("51107",)}
    price = rows(t["electricity_price"], "zip_code")
    assert price["36003",]["commercial_price"] == pytest.approx(0.15) and price["36003",]["industrial_price"] == pytest.approx(0.04)


def test_raw_tables_to_ranking(spark, raw):
    sites = spark.createDataFrame([("20147",), ("20147-1234",), ("36003",), ("36003",), ("bad",)], "zip string")
    reply = '{"mentioned_state": "VA", "mentioned_county": "loudoun", "is_data_center_policy": true, "support_data_center_siting": %s}'
    verdicts = E.classify(spark.createDataFrame([(1, reply % "true"), (2, reply % '"neutral"'), (3, "broken")], "id int, reply string"),
                          lambda df: df["reply"], ["id"])
    wide, report = S.county_table(S.county_tables(raw), sites, verdicts)
    assert {r["table"]: r["n_rejected"] for r in report.collect()} == {
        n: int(n == "environment_risk") for n in ("environment_risk", "grid_infrastructure", "high_speed_internet", "land_price", "prices",
                                                  "sites", "transportation", "labor_price", "policy")}
    got = rows(wide, "county_fips")
    assert set(got) == {("01001",), ("51107",)}
    a, b = got["01001",], got["51107",]
    assert (a["state"], a["county"], b["state"], b["county"]) == ("Alabama", "Autauga County", "Virginia", "Loudoun County")
    assert a["num_datacenters"] == 0.5 and b["num_datacenters"] == 3.5  # sites are shared out by ratio, none is lost
    assert a["commercial_price"] == pytest.approx(0.15) and b["commercial_price"] == pytest.approx((0.15 * 0.75 + 0.3) / 1.75)
    assert b["policy_direction_score"] == 0.5 and b["has_policy_signal"] == 1 and a["has_policy_signal"] == 0 == a["policy_direction_score"]
    assert b["wage_information"] is None and a["land_value_1_4_acre_standardized"] == 50000.0
    extra = wide.limit(1).select(*[F.lit("72001").alias(c) if c == "county_fips" else F.lit(" Puerto Rico ").alias(c) if c == "state" else
                                   F.lit("Adjuntas County").alias(c) if c == "county" else F.col(c) for c in wide.columns])
    nameless = extra.withColumn("state", F.lit(" "))
    assert set(rows(S.clean_county_table(wide.unionByName(extra).unionByName(nameless)), "county_fips")) == set(got)
    wide = S.clean_county_table(wide)
    ready = Preprocessor(S.PREP).fit(wide).transform(wide)
    prepared = rows(ready, "county_fips")
    assert prepared["51107",]["hurricane_risk_index_value"] == 0.0 and prepared["51107",]["wage_information"] == 0.0
    # by hand, after the source's steps: median of what there is, then log1p
    assert prepared["51107",]["land_value_missing"] == 1 and prepared["01001",]["land_value_missing"] == 0
    assert prepared["51107",]["land_value_1_4_acre_standardized"] == pytest.approx(math.log1p(50000.0))
    assert prepared["01001",]["residential_price"] == pytest.approx(0.002)  # has no least price, no flag, no log1p
    assert not [c for c in ready.columns if c.endswith("_missing") and c != "land_value_missing"]
    assert prepared["01001",]["commercial_price"] == pytest.approx(math.log1p(0.15))
    assert prepared["51107",]["wage_prof_business"] == pytest.approx(math.log1p(1100.0)) and prepared["51107",]["infrastructure_quality"] == 0.75
    assert prepared["01001",]["epg_natural_gas"] == pytest.approx(math.log1p(5)) and len(S.LOG1P) == 24
    assert prepared["01001",]["epg_natural_gas_above_floor"] == 0 and prepared["51107",]["epg_natural_gas_above_floor"] == 1
    ranked = global_rank(ready.withColumn("score", F.col("num_datacenters")), "score", "county_fips")
    assert rows(ranked, "county_fips")["51107",]["rank"] == 1


def test_preparation_of_bad_values(spark):
    """Negative land values and implausible prices are missing; only land has a flag."""
    names = ["county_fips", "state", "county", *dict.fromkeys([*S.LOG1P, "infrastructure_quality", "rail_intensity", "residential_price", "dock_presence"]),
             "num_datacenters"]
    base = {c: 1.0 for c in names} | {"state": "A", "county": "B"}
    given = [{"land_value_1_4_acre_standardized": -5.0, "industrial_price": 0.0, "commercial_price": 0.005},
             {"land_value_1_4_acre_standardized": None, "industrial_price": 0.02, "commercial_price": 0.3, "residential_price": 0.001},
             {"land_value_1_4_acre_standardized": 100.0, "industrial_price": 0.04, "commercial_price": 0.5, "residential_price": None},
             {"num_datacenters": None}]
    data = [tuple((base | g | {"county_fips": str(i)})[c] for c in names) for i, g in enumerate(given)]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'string' if c in ('county_fips', 'state', 'county') else 'double'}" for c in names))
    got = rows(Preprocessor(S.PREP).fit(df).transform(df), "county_fips")
    assert set(got) == {("0",), ("1",), ("2",)}
    assert [got[str(i),]["land_value_missing"] for i in range(3)] == [1, 1, 0]
    land = math.log1p((100 + 1) / 2)  # the row without a target counts for the median
    assert [got[str(i),]["land_value_1_4_acre_standardized"] for i in range(3)] == pytest.approx([land, land, math.log1p(100)])
    assert [got[str(i),]["industrial_price"] for i in range(3)] == pytest.approx([math.log1p(0.04), math.log1p(0.02), math.log1p(0.04)])
    assert got["0",]["commercial_price"] == pytest.approx(math.log1p(0.5)) and got["1",]["residential_price"] == 0.001
    assert got["2",]["residential_price"] == 1.0


def test_skew_before_and_after(spark):
    from regionscore.operators.prep import skew_change
    df = spark.createDataFrame([(float(2 ** i), float(i)) for i in range(12)], "a double, b double")
    got = skew_change(df, ["b", "a"]).collect()
    import pandas as pd
    import numpy as np
    p = df.toPandas()
    assert [r.column for r in got] == ["a", "b"]
    for r in got:
        assert r.before == pytest.approx(p[r.column].skew()) and r.after == pytest.approx(np.log1p(p[r.column]).skew())
        assert r.reduction == pytest.approx(r.before - r.after) and isinstance(pd.Series([r.before]).iloc[0], float)
