"""Declarative source specs compiled to one chain of DataFrame operations.

A ``TableSpec`` describes how a raw public table becomes a clean grain table.
``compile_spec(spec)`` returns a ``DataFrame -> DataFrame`` function applying,
in one fixed order: column names → filter → special values → combine →
normalise → pivot → rename/keep → cast → pad → post-filter → aggregate →
proxies → drop inputs.  It is all lazy column work plus at most one
``groupBy`` (pivot / aggregate), so Catalyst sees one plan and pushes the
filters and the column selection into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.functions import keys as K
from regionscore.functions import scalar as X
from regionscore.operators import aggregate as A
from regionscore.operators import filters as FL
from regionscore.sources.readers import apply_dtypes, normalise_columns


@dataclass(frozen=True)
class TableSpec:
    keys: dict                                   # canonical -> raw
    value_columns: dict = field(default_factory=dict)   # canonical -> raw
    filters: dict = field(default_factory=dict)          # raw -> value | [values]
    padded_filters: dict = field(default_factory=dict)   # raw -> (value, width)
    special_values: dict = field(default_factory=dict)   # raw -> {token: replacement}
    combine_columns: dict = field(default_factory=dict)  # new -> {"columns": [...], "method": "concat"|"concat_zfill", "widths": [...], "sep": " "}
    normalize: dict = field(default_factory=dict)        # raw -> "strip_suffix" | "title" | "state" | "county"
    pivot: dict | None = None                    # {"index": [...], "column": c, "values": v | [v...], "categories": [...], "rename": {}}
    dtypes: dict = field(default_factory=dict)           # canonical -> dtype name
    pad: dict = field(default_factory=dict)              # canonical -> width
    post_filters: dict = field(default_factory=dict)     # {"not_ending_with": {col: suffix}, "exclude": {col: [...]}}
    aggregation: dict | None = None              # {"by": [...], "method": "median", "columns": [...]}
    proxies: dict = field(default_factory=dict)          # name -> {"kind": ..., "columns": [...], "weights": [...]}
    drop_inputs: str = "none"                    # "none" | "used" | "all"
    strict: bool = False


def _proxy(cfg: dict):
    kind, cols = cfg["kind"], cfg.get("columns", [])
    if kind == "row_sum":
        return X.row_sum(cols)
    if kind == "column":
        return F.col(cols[0])
    if kind == "weighted_log":
        return X.weighted_log(cols, cfg.get("weights"))
    if kind == "log1p_zero":
        return X.log1p_zero(cols[0])
    if kind == "condition_index":
        return X.condition_index(*cols)
    if kind == "presence":
        return X.presence_flag(cols[0])
    raise ValueError(f"unknown proxy kind {kind!r}")


_NORMALISERS = {"strip_suffix": K.strip_place_suffix, "title": K.title_case, "state": K.state_full_name,
                "county": K.county_form}


def compile_spec(spec: TableSpec):
    def run(df: DataFrame) -> DataFrame:
        df = normalise_columns(df)
        df = FL.spec_filter(df, spec.filters, strict=spec.strict)
        if spec.padded_filters:
            df = FL.padded_equals(df, spec.padded_filters)
        if spec.special_values:
            df = df.withColumns({c: X.special_values(c, m) for c, m in spec.special_values.items() if c in df.columns})
        for new, cfg in spec.combine_columns.items():
            cols = cfg["columns"]
            if cfg.get("method", "concat") == "concat_zfill":
                df = df.withColumn(new, K.combine_codes(cols, cfg["widths"]))
            else:
                df = df.withColumn(new, K.combine_text(cols, cfg.get("sep", " ")))
            df = df.drop(*[c for c in cols if c != new])
        if spec.normalize:
            df = df.withColumns({c: _NORMALISERS[how](c) for c, how in spec.normalize.items() if c in df.columns})
        rename = {raw: canon for canon, raw in {**spec.keys, **spec.value_columns}.items()}
        if spec.pivot:
            p = spec.pivot
            df = A.pivot_first(df, p["index"], p["column"], p["categories"], p["values"], p.get("rename"))
            rename = {k: v for k, v in rename.items() if k in df.columns}
            keep = list(df.columns)
        else:
            missing = [r for r in rename if r not in df.columns]
            if missing and spec.strict:
                raise KeyError(f"spec columns missing: {missing}")
            rename = {k: v for k, v in rename.items() if k in df.columns}
            keep = list(rename)
        df = df.select(*[F.col(c).alias(rename.get(c, c)) for c in keep])
        df = apply_dtypes(df, spec.dtypes, strict=spec.strict)
        if spec.pad:
            df = df.withColumns({c: K.pad_code(c, w) for c, w in spec.pad.items() if c in df.columns})
        for col, suffix in spec.post_filters.get("not_ending_with", {}).items():
            df = FL.not_ending_with(df, col, suffix)
        for col, values in spec.post_filters.get("exclude", {}).items():
            df = FL.exclude_values(df, col, values)
        if spec.aggregation:
            a = spec.aggregation
            df = A.agg_by_key(df, a["by"], a.get("method", "median"), a.get("columns"))
        if spec.proxies:
            df = df.withColumns({name: _proxy(cfg) for name, cfg in spec.proxies.items()})
            used = {c for cfg in spec.proxies.values() for c in cfg.get("columns", [])}
            if spec.drop_inputs == "used":
                df = df.drop(*[c for c in used if c not in spec.keys and c not in spec.proxies])
            elif spec.drop_inputs == "all":
                df = df.drop(*[c for c in spec.value_columns if c not in spec.keys and c not in spec.proxies])
        return df
    return run


def build_tables(specs: dict[str, TableSpec], raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Named registry: compile every spec against its raw table (unknown name -> KeyError)."""
    return {name: compile_spec(specs[name])(df) for name, df in raw.items()}
