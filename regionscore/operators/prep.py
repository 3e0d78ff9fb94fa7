"""Preprocessing fit / apply (I-a…I-h): floor flags, structural zeros, invalid
values, missing flags, median imputation, target-null drop, log1p, checks.

``Preprocessor.fit`` computes every median in distributed passes (exact,
chunked quantiles; one small row per column) and one null-count pass; only
those bounded fitted parameters reach the driver.  ``transform`` is a single
projection, so it fuses into the scan's whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.functions.scalar import above_floor
from regionscore.operators.profile import profile_skew
from regionscore.operators.quantile import exact_medians

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
FLOOR_SPECS = {"epg_natural_gas": 5.0, "clean_energy_jobs": 15.0, "grid_infrastructure_jobs": 20.0}
STRUCTURAL_ZERO = ["hurricane_risk_index_value", "ice_storm_risk_index_value", "wage_information",
                   "dock_presence", "lightning_risk_index_value", "landslide_risk_index_value"]
PRICE_MIN_THRESHOLD = 0.01
NON_FEATURE_COLS = ["num_datacenters", "county_fips", "county_key", "state", "county"]
# ---------------------------------------------------------------------------


@dataclass
class PrepSpec:
    floors: dict = field(default_factory=dict)            # col -> floor  => col_above_floor
    zero_fill: list = field(default_factory=list)          # structural zeros
    invalid_below: dict = field(default_factory=dict)      # col -> min valid value (else null)
    flag_then_median: list = field(default_factory=list)   # col_missing flag, then median
    median_fill: list = field(default_factory=list)
    median_fill_rest: bool = True                          # any other feature with nulls
    non_features: list = field(default_factory=lambda: list(NON_FEATURE_COLS))
    target: str | None = None                              # rows with a null target dropped
    log1p: list = field(default_factory=list)
    missing_suffix: str = "_missing"
    flag_names: dict = field(default_factory=dict)         # col -> name of its missing flag, if another


class PrepModel:
    def __init__(self, spec: PrepSpec, medians: dict, rest: list):
        self.spec, self.medians, self.rest = spec, medians, rest

    def flags(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_above_floor": above_floor(c, v) for c, v in self.spec.floors.items()})

    def impute(self, df: DataFrame) -> DataFrame:
        s = self.spec
        df = self.flags(df)
        df = df.withColumns({c: F.when(F.col(c) >= F.lit(t), F.col(c)) for c, t in s.invalid_below.items()})
        df = df.withColumns({s.flag_names.get(c, f"{c}{s.missing_suffix}"): F.col(c).isNull().cast("int") for c in s.flag_then_median})
        fills = {c: 0.0 for c in s.zero_fill}
        fills.update({c: self.medians[c] for c in [*s.flag_then_median, *s.median_fill, *self.rest]
                      if self.medians.get(c) is not None})
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})
        if s.target:
            df = df.where(F.col(s.target).isNotNull())
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        df = self.impute(df)
        return df.withColumns({c: F.log1p(F.col(c)) for c in self.spec.log1p})


class Preprocessor:
    def __init__(self, spec: PrepSpec):
        self.spec = spec

    def fit(self, df: DataFrame) -> PrepModel:
        s = self.spec
        d = df.withColumns({c: F.when(F.col(c) >= F.lit(t), F.col(c)) for c, t in s.invalid_below.items()})
        handled = set(s.zero_fill) | set(s.flag_then_median) | set(s.median_fill) | set(s.non_features)
        if s.target:
            handled.add(s.target)
        rest = []
        if s.median_fill_rest:
            num = {"double", "float", "int", "bigint", "smallint", "tinyint"}
            cand = [c for c, t in d.dtypes if c not in handled and (t in num or t.startswith("decimal"))]
            nulls = d.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cand]).first()
            rest = [c for c in cand if nulls[c]]
        med_cols = [*s.flag_then_median, *s.median_fill, *rest]
        medians = {}
        if med_cols:
            row = exact_medians(d, [], med_cols).first()
            medians = {c: (row[c] if row is not None else None) for c in med_cols}
        return PrepModel(s, medians, rest)


def skew_change(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, before, after, reduction): skewness of the columns and of their log1p, most skewed first; one pass."""
    names = [x for c in cols for x in (c, f"log1p {c}")]
    both = df.select(*[F.col(c).cast("double").alias(c) for c in cols], *[F.log1p(F.col(c).cast("double")).alias(f"log1p {c}") for c in cols])
    found = profile_skew(both, names)
    plain = found.where(~F.col("column").startswith("log1p ")).select("column", F.col("skew").alias("before"))
    after = found.where(F.col("column").startswith("log1p ")).select(F.substring("column", 7, 1000).alias("column"), F.col("skew").alias("after"))
    return (plain.join(after, "column").withColumn("reduction", F.col("before") - F.col("after"))
            .orderBy(F.col("before").desc_nulls_last(), "column"))


def expectations(df: DataFrame, key: str | None = None, no_nulls: list | None = None,
                 non_negative: list | None = None) -> DataFrame:
    """Checks as data: (check, column, n_violations, ok) — one aggregate pass."""
    aggs, names = [], []
    for c in no_nulls or []:
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"nonnull::{c}"))
    for c in non_negative or []:
        aggs.append(F.sum((F.col(c) < 0).cast("long")).alias(f"nonneg::{c}"))
    if key:
        aggs.append((F.count(F.lit(1)) - F.count_distinct(key)).alias(f"unique::{key}"))
    wide = df.agg(*aggs)
    names = [a for a in wide.columns]
    long = wide.unpivot([], names, "check_col", "n_violations")
    parts = F.split("check_col", "::")
    return long.select(parts[0].alias("check"), parts[1].alias("column"),
                       F.coalesce("n_violations", F.lit(0)).cast("long").alias("n_violations"),
                       (F.coalesce("n_violations", F.lit(0)) == 0).alias("ok"))
