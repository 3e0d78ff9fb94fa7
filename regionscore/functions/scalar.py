"""Scalar feature expressions (X-*, F-7, N12, N15, N16) as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]
NEUTRAL_WORD = "neutral"
# Air-connectivity weight per airport-count column.
AIR_WEIGHTS = {
    "primary_large_airport_count": 5,
    "primary_medium_airport_count": 4,
    "primary_small_airport_count": 3,
    "non_hub_primary_airport_count": 2,
    "national_non_primary_airport_count": 1.5,
    "regional_non_primary_airport_count": 1.0,
    "local_non_primary_airport_count": 0.7,
    "basic_non_primary_airport_count": 0.4,
    "unclassified_non_primary_airport_count": 0.2,
}
# Condition index: good counts 1, fair counts 0.5, poor counts 0.
CONDITION_FAIR_WEIGHT = 0.5
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Best-effort numeric: strip thousands commas and blanks, ``try_cast``; NaN -> null."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), ",", "")
    v = s.try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def nan_to_null(c) -> Column:
    return F.when(F.isnan(_c(c)), F.lit(None).cast("double")).otherwise(_c(c))


def special_values(c, mapping: dict) -> Column:
    """Replace suppressed tokens (e.g. ``"<10"`` -> 5) before numeric cast."""
    s = F.trim(_c(c).cast("string"))
    out = None
    for token, value in mapping.items():
        cond = s == F.lit(str(token).strip())
        out = F.when(cond, F.lit(str(value))) if out is None else out.when(cond, F.lit(str(value)))
    return s if out is None else out.otherwise(s)


def row_sum(cols: list) -> Column:
    """Row-wise sum skipping nulls (an all-null row sums to 0)."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(x).cast("double"), F.lit(0.0)) for x in cols])


def weighted_sum(cols: list, weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b,
                  [F.lit(float(w)) * F.coalesce(_c(x).cast("double"), F.lit(0.0)) for x, w in zip(cols, weights)])


def weighted_log(cols: list, weights: list[float] | None = None) -> Column:
    """log1p of a weighted row sum with nulls as 0 (air connectivity).

    Without explicit weights the columns must be named as in ``AIR_WEIGHTS``.
    """
    if weights is None:
        weights = [AIR_WEIGHTS[c] for c in cols]
    return F.log1p(weighted_sum(cols, weights))


def log1p_zero(c) -> Column:
    """log1p with null -> 0 input (rail intensity)."""
    return F.log1p(F.coalesce(_c(c).cast("double"), F.lit(0.0)))


def condition_index(good, fair, poor) -> Column:
    """(good + 0.5 fair) / (good + fair + poor); null when the total is 0."""
    g, f, p = (F.coalesce(_c(x).cast("double"), F.lit(0.0)) for x in (good, fair, poor))
    total = g + f + p
    return F.when(total > 0, (g + F.lit(CONDITION_FAIR_WEIGHT) * f) / total)


def presence_flag(c) -> Column:
    return (F.coalesce(_c(c).cast("double"), F.lit(0.0)) > 0).cast("int")


def above_floor(c, floor: float) -> Column:
    """1 when value > floor, 0 otherwise (null compares false, as in pandas)."""
    return F.coalesce(_c(c) > F.lit(floor), F.lit(False)).cast("int")


def is_truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def tri_state(c) -> Column:
    """true/1/yes -> 1, false/0/no -> -1, neutral / null / anything else -> 0."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return (F.when(s.isin(*TRUE_WORDS), F.lit(1))
            .when(s.isin(*FALSE_WORDS), F.lit(-1))
            .otherwise(F.lit(0)))


def number_or_zero(c) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))



def zip5(c) -> Column:
    """Recognise ZIP / ZIP+4 and keep the first five digits; else null."""
    m = F.regexp_extract(F.trim(_c(c)), r"^(\d{5})(?:-\d{4})?$", 1)
    return F.when(m != "", m)


def url_path(c) -> Column:
    """Path part of an absolute or relative URL (no host, no query)."""
    u = _c(c)
    absolute = F.try_parse_url(u, F.lit("PATH"))
    rel = F.regexp_extract(u, r"^([^?#]*)", 1)
    return F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), absolute).otherwise(rel)


def url_segments(c) -> Column:
    """Non-empty path segments as an array."""
    return F.filter(F.split(url_path(c), "/"), lambda s: s != "")


def url_host(c) -> Column:
    return F.try_parse_url(_c(c), F.lit("HOST"))


def status_class(activity, p, threshold: float = 0.5) -> Column:
    """Badge: has activity / ready (p >= threshold) / none."""
    return (F.when(F.coalesce(_c(activity), F.lit(0)) > 0, F.lit("active"))
            .when(_c(p) >= F.lit(threshold), F.lit("ready"))
            .otherwise(F.lit("none")))


def bias_corrected_skew(c, n) -> Column:
    """Turn Spark's population skewness into the sample (G1) estimate; null if n < 3."""
    n = _c(n).cast("double")
    return F.when(n >= 3, _c(c) * F.sqrt(n * (n - 1)) / (n - 2))
