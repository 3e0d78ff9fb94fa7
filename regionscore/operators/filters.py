"""Row filters (F-1…F-10). Plain predicates, so Catalyst pushes them into the scan."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.functions.keys import pad_code
from regionscore.functions.scalar import is_truthy


def spec_filter(df: DataFrame, conditions: dict, strict: bool = True) -> DataFrame:
    """AND over columns of equality / IN conditions; a missing column raises, or is skipped with
    a warning that names it if not ``strict``. Column names are matched
    after trimming."""
    by_stripped = {c.strip(): c for c in df.columns}
    preds = []
    for col, val in conditions.items():
        real = by_stripped.get(col.strip())
        if real is None:
            if strict:
                raise KeyError(f"filter column {col!r} not in {df.columns}")
            warnings.warn(f"filter column {col!r} is missing: its condition lets all rows through", stacklevel=2)
            continue
        vals = val if isinstance(val, (list, tuple, set)) else [val]
        preds.append(F.col(real).isin(list(vals)))
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def padded_equals(df: DataFrame, conditions: dict[str, tuple]) -> DataFrame:
    """Code equality after padding both sides: {col: (value, width)} (``50`` == ``"050"``)."""
    preds = [pad_code(F.col(c), w) == pad_code(F.lit(str(v)), w) for c, (v, w) in conditions.items()]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def not_ending_with(df: DataFrame, col: str, suffix: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(col).endswith(suffix), F.lit(False)))


def exclude_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """Drop rows whose trimmed value is in a fixed list (null rows are kept)."""
    return df.where(~F.coalesce(F.trim(F.col(col)).isin(list(values)), F.lit(False)))


def invalid_code(col: str):
    """Blank code or one that contains 'nan'."""
    s = F.trim(F.col(col).cast("string"))
    return s.isNull() | (s == "") | F.lower(s).contains("nan")


def point_lookup(df: DataFrame, keys: dict) -> DataFrame:
    """The rows with these key values."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in keys.items()]))


def drop_names(df: DataFrame, names: set[str]) -> DataFrame:
    """The table without the columns of a set of names; absent ones don't matter."""
    return df.drop(*names)


def keep_truthy(df: DataFrame, col: str) -> DataFrame:
    return df.where(is_truthy(col))


def result_filter(df: DataFrame, activity: str | None = None, mode: str = "all",
                  p_col: str | None = None, p_min: float | None = None,
                  col_in: tuple[str, list] | None = None) -> DataFrame:
    """Dashboard-style result filters: zero-only / positive-only, min probability, value list."""
    if activity and mode == "zero":
        df = df.where(F.col(activity) == 0)
    elif activity and mode == "positive":
        df = df.where(F.col(activity) > 0)
    if p_col and p_min is not None:
        df = df.where(F.col(p_col) >= p_min)
    if col_in:
        df = df.where(F.col(col_in[0]).isin(list(col_in[1])))
    return df
