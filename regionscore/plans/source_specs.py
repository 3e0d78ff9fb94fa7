"""The nine public tables as specs, and the run from raw tables to one table per county.

Raw tables come with the publishers' column names; ``county_tables`` compiles
each spec, ``county_table`` joins them with the allocated ZIP measures and the
policy signal, and ``PREP`` prepares the features. Everything stays one lazy
plan up to the fitted medians.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.functions import keys as K
from regionscore.functions import scalar as X
from regionscore.operators import aggregate as A
from regionscore.operators import assemble as J
from regionscore.operators import crosswalk as C
from regionscore.operators import evidence as E
from regionscore.operators.filters import exclude_values
from regionscore.operators.prep import FLOOR_SPECS, PRICE_MIN_THRESHOLD, STRUCTURAL_ZERO, PrepSpec
from regionscore.plans.spec import TableSpec, build_tables

# ---------------------------------------------------------------------------
# Fixed values that must equal the sources' for right results: column names and codes of the public tables.
AIRPORTS = {"primary_large_airport_count": "Large Primary Airports", "primary_medium_airport_count": "Medium Primary Airports",
            "primary_small_airport_count": "Small Primary Airports", "non_hub_primary_airport_count": "Non-Hub Primary Airport",
            "national_non_primary_airport_count": "National Non-Primary Airport",
            "regional_non_primary_airport_count": "Regional Non-Primary Airport",
            "local_non_primary_airport_count": "Local Non-Primary Airport",
            "basic_non_primary_airport_count": "Basic Non-Primary Airport",
            "unclassified_non_primary_airport_count": "Unclassified Non-Primary Airport"}
TRANSPORT = {"rail_track_count": "All Rail Track", "docks_count": "Docks", "infra_good_count": "Good", "infra_fair_count": "Fair",
             "infra_poor_count": "Poor"}
COMMUNITY = {"community_resilience_value": "Community Resilience - Value", "community_risk_factor_value": "Community Risk Factor - Value"}
HAZARDS = ["Cold Wave", "Drought", "Earthquake", "Hail", "Heat Wave", "Hurricane", "Ice Storm", "Landslide", "Lightning",
           "Riverine Flooding", "Strong Wind", "Tornado", "Wildfire", "Winter Weather"]
INDUSTRIES = {"1021 Trade, transportation, and utilities": "wage_trade_transport_utilities", "1022 Information": "wage_information",
              "1024 Professional and business services": "wage_prof_business"}
JOBS = {"epg_solar": "Solar", "epg_wind": "Wind", "epg_hydroelectric": "Hydroelectric", "epg_natural_gas": "Natural Gas",
        "tds_traditional": "Traditional TDS", "tds_storage": "Storage", "tds_smart_grid": "Smart Grid", "tds_micro_grid": "Micro Grid"}
SUPPRESSED_JOBS = {"<10": "5"}
TECHNOLOGIES = {"Fiber": "fiber", "Cable/Fiber": "cable_fiber", "Any Technology": "any_tech"}
SPEEDS = ["speed_100_20", "speed_1000_100"]
PRICES = {"commercial_price": "comm_rate", "industrial_price": "ind_rate", "residential_price": "res_rate"}
RATIOS = {"zip_code": "ZIP", "state_cap": "USPS_ZIP_PREF_STATE", "res_ratio": "RES_RATIO", "business_ratio": "BUS_RATIO",
          "other_ratio": "OTH_RATIO", "total_ratio": "TOT_RATIO"}
LAND_VALUE = "Land Value (1/4 Acre Lot, Standardized)"
LAND_COLUMN = "land_value_1_4_acre_standardized"
LOG1P = ["cold_wave_risk_index_value", "drought_risk_index_value", "earthquake_risk_index_value", "hail_risk_index_value",
         "heat_wave_risk_index_value", "hurricane_risk_index_value", "ice_storm_risk_index_value", "landslide_risk_index_value",
         "lightning_risk_index_value", "riverine_flooding_risk_index_value", "strong_wind_risk_index_value", "tornado_risk_index_value",
         "wildfire_risk_index_value", "winter_weather_risk_index_value", "grid_infrastructure_jobs", "clean_energy_jobs",
         "epg_natural_gas", "wage_information", "wage_prof_business", "wage_trade_transport_utilities", "commercial_price",
         "industrial_price", "land_value_1_4_acre_standardized", "air_connectivity"]
# ---------------------------------------------------------------------------


def _numbers(names) -> dict:
    return {n: "float64" for n in names}


def _hazard(name: str) -> str:
    return name.lower().replace(" ", "_") + "_risk_index_value"


_COVERAGE = {f"{short}_{s.removeprefix('speed_')}_coverage": f"{s}_{full}" for full, short in TECHNOLOGIES.items() for s in SPEEDS}

SPECS: dict[str, TableSpec] = {
    "transportation": TableSpec(
        keys={"state": "State", "county": "County Name"}, value_columns={**AIRPORTS, **TRANSPORT},
        dtypes={"state": "string", "county": "string", **_numbers([*AIRPORTS, *TRANSPORT])},
        proxies={"air_connectivity": {"kind": "weighted_log", "columns": list(AIRPORTS)},
                 "rail_intensity": {"kind": "log1p_zero", "columns": ["rail_track_count"]},
                 "infrastructure_quality": {"kind": "condition_index", "columns": ["infra_good_count", "infra_fair_count", "infra_poor_count"]},
                 "dock_presence": {"kind": "presence", "columns": ["docks_count"]}},
        drop_inputs="all", strict=True),
    "environment_risk": TableSpec(
        keys={"state": "State Name", "county": "county_name", "county_fips": "State-County FIPS Code"},
        combine_columns={"county_name": {"columns": ["County Name", "County Type"], "method": "concat", "sep": " "}},
        value_columns={**COMMUNITY, **{_hazard(h): f"{h} - Hazard Type Risk Index Value" for h in HAZARDS}},
        dtypes={"state": "string", "county": "string", "county_fips": "string", **_numbers([*COMMUNITY, *map(_hazard, HAZARDS)])},
        pad={"county_fips": 5}, strict=True),
    "labor_price": TableSpec(
        keys={"state": "St Name", "county": "Area"}, normalize={"Area": "strip_suffix"},
        filters={"Area Type": "County", "Ownership": "Private", "Industry": list(INDUSTRIES)},
        pivot={"index": ["St Name", "Area"], "column": "Industry", "values": "Annual Average Weekly Wage",
               "categories": list(INDUSTRIES), "rename": INDUSTRIES},
        dtypes={"state": "string", "county": "string", **_numbers(INDUSTRIES.values())}, strict=True),
    "grid_infrastructure": TableSpec(
        keys={"county_fips": "County FIPS"}, special_values={raw: SUPPRESSED_JOBS for raw in JOBS.values()},
        value_columns={"state": "State", "county": "County Name", **JOBS},
        dtypes={"county_fips": "string", "state": "string", "county": "string", **_numbers(JOBS)}, pad={"county_fips": 5},
        proxies={"clean_energy_jobs": {"kind": "row_sum", "columns": ["epg_solar", "epg_wind", "epg_hydroelectric"]},
                 "grid_infrastructure_jobs": {"kind": "row_sum", "columns": ["tds_traditional", "tds_storage", "tds_smart_grid",
                                                                             "tds_micro_grid"]}},
        drop_inputs="used", strict=True),
    "high_speed_internet": TableSpec(
        keys={"county_fips": "geography_id"}, value_columns=_COVERAGE,
        filters={"geography_type": "County", "biz_res": "B", "technology": list(TECHNOLOGIES)},
        pivot={"index": ["geography_id"], "column": "technology", "values": SPEEDS, "categories": list(TECHNOLOGIES)},
        dtypes={"county_fips": "string", **_numbers(_COVERAGE)}, pad={"county_fips": 5},
        proxies={"fiber_availability": {"kind": "column", "columns": ["fiber_1000_100_coverage"]},
                 "high_speed_wired_coverage": {"kind": "column", "columns": ["cable_fiber_1000_100_coverage"]}},
        drop_inputs="all", strict=True),
    "land_price": TableSpec(
        keys={"county_fips": "County Code"}, filters={"Year": "2023"}, value_columns={"land_value_1_4_acre_standardized": LAND_VALUE},
        dtypes={"county_fips": "string", "land_value_1_4_acre_standardized": "float64"}, pad={"county_fips": 5}, strict=True),
    "zip_to_fips": TableSpec(
        keys={"county_fips": "COUNTY"}, value_columns=RATIOS,
        dtypes={"county_fips": "string", "zip_code": "string", "state_cap": "string",
                **_numbers(["res_ratio", "business_ratio", "other_ratio", "total_ratio"])},
        pad={"county_fips": 5, "zip_code": 5}, strict=True),
    "fips_to_county": TableSpec(
        keys={"county_fips": "county_fips"}, value_columns={"county_name": "Area Name"}, padded_filters={"Summary Level": ("050", 3)},
        combine_columns={"county_fips": {"columns": ["State FIPS Code", "County FIPS Code"], "method": "concat_zfill", "widths": [2, 3]}},
        dtypes={"county_fips": "string", "county_name": "string"},
        post_filters={"not_ending_with": {"county_fips": "000"}}, strict=True),
    "electricity_price": TableSpec(
        keys={"zip_code": "zip"}, value_columns={"ownership": "ownership", **PRICES},
        dtypes={"zip_code": "string", "ownership": "string", **_numbers(PRICES)}, pad={"zip_code": 5},
        aggregation={"by": ["zip_code"], "method": "mean", "columns": list(PRICES)}, strict=True),
}

PREP = PrepSpec(floors=FLOOR_SPECS, zero_fill=STRUCTURAL_ZERO,
                invalid_below={LAND_COLUMN: 0.0, "commercial_price": PRICE_MIN_THRESHOLD, "industrial_price": PRICE_MIN_THRESHOLD},
                flag_then_median=[LAND_COLUMN], flag_names={LAND_COLUMN: "land_value_missing"},
                median_fill=["infrastructure_quality", "rail_intensity", "air_connectivity", "commercial_price", "industrial_price",
                             "wage_prof_business", "wage_trade_transport_utilities"],
                target="num_datacenters", log1p=LOG1P)


def county_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every raw table through its spec; the lists of one table (two rate files) are one DataFrame by union."""
    return build_tables({n: SPECS[n] for n in raw}, raw)


def reference_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Crosswalk x gazetteer: one row per ZIP and county with the county's and the state's name."""
    both = J.outer_assemble({"zip_to_fips": tables["zip_to_fips"], "fips_to_county": tables["fips_to_county"]}, "county_fips")
    return both.withColumn("state", K.state_full_name("state_cap"))


def county_table(tables: dict[str, DataFrame], sites: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(county table, report of rows left out for a blank key, per table).

    sites: one row per site with its zip. verdicts: one row per document (``classify``).
    """
    places = reference_table(tables)
    crosswalk = places.where(F.col("zip_code").isNotNull())
    names = (places.where(~K.is_blank_key("county_fips")).groupBy("county_fips")
             .agg(F.min("county_name").alias("county"), F.min("state").alias("state")))
    prices, _ = C.crosswalk_allocate(tables["electricity_price"], crosswalk, "zip_code", "county_fips", "total_ratio", weighted=list(PRICES))
    counts = A.count_by_key(sites.select(X.zip5("zip").alias("zip_code")), ["zip_code"], "num_datacenters")
    placed, _ = C.crosswalk_allocate(counts, crosswalk, "zip_code", "county_fips", "total_ratio", additive=["num_datacenters"])
    by_code = {n: tables[n] for n in ("environment_risk", "grid_infrastructure", "high_speed_internet", "land_price")}
    by_code = {n: t.drop("state", "county") for n, t in by_code.items()} | {"prices": prices, "sites": placed}
    by_name = {n: tables[n].withColumn("state", K.state_full_name("state")).withColumn("county", K.county_form("county"))
               for n in ("transportation", "labor_price")}
    by_name["policy"] = E.entity_signal(verdicts).withColumnsRenamed({"mentioned_state": "state", "mentioned_county": "county"})
    report = J.quarantine_report(by_code, ["county_fips"]).unionByName(J.quarantine_report(by_name, ["state", "county"]))
    kept = {n: J.drop_blank_keys(t, ["county_fips"])[0] for n, t in by_code.items()}
    wide = J.outer_assemble({"names": names, **kept}, "county_fips")
    wide = wide.withColumn("state", K.state_full_name("state")).withColumn("county", K.county_form("county"))
    named = {n: J.drop_blank_keys(t, ["state", "county"])[0] for n, t in by_name.items()}
    # a county without a policy has none: only rows with a code get it, before names alone bring more rows
    ruled = J.outer_assemble({"wide": wide, "policy": named.pop("policy")}, ["state", "county"]).where(~K.is_blank_key("county_fips"))
    ruled = ruled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("has_policy_signal", "policy_direction_score")})
    return J.outer_assemble({"ruled": ruled, **named}, ["state", "county"]), report


def clean_county_table(wide: DataFrame) -> DataFrame:
    """Rows with a state and a county, outside the territories."""
    named = wide.where(~K.is_blank_key("state") & ~K.is_blank_key("county"))
    return exclude_values(named.withColumns({c: F.trim(c) for c in ("state", "county")}), "state", K.US_TERRITORIES)
