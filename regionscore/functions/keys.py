"""Key and place-name column expressions (all JVM-side, codegen friendly).

Every function takes and returns ``Column`` objects so Catalyst can fold them
into the surrounding projection and push filters through them.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Two-letter US state / territory abbreviation -> full name.
STATE_ABBR_TO_FULL = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "AS": "American Samoa", "FM": "Federated States of Micronesia", "GU": "Guam",
    "MH": "Marshall Islands", "MP": "Northern Mariana Islands", "PW": "Palau", "PR": "Puerto Rico",
    "VI": "U.S. Virgin Islands",
}
# Overseas territories dropped from the final county table.
US_TERRITORIES = ["Puerto Rico", "Guam", "U.S. Virgin Islands", "American Samoa",
                  "Northern Mariana Islands"]
# Null-like key spellings treated as missing when cleaning keys.
NULL_LIKE = ["", "nan", "none", "null", "<na>"]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_code(c, n: int) -> Column:
    """Left-pad with zeros to ``n`` characters without ever truncating.

    Spark's ``lpad`` cuts longer strings; the code convention keeps them.
    A leading minus sign stays in front of the zeros.
    """
    s = F.trim(_c(c).cast("string"))
    neg = s.startswith("-")
    body = F.when(neg, F.substring(s, 2, 1 << 20)).otherwise(s)
    width = F.length(s)
    padded_pos = F.when(width < n, F.lpad(s, n, "0")).otherwise(s)
    padded_neg = F.when(width < n, F.concat(F.lit("-"), F.lpad(body, n - 1, "0"))).otherwise(s)
    return F.when(neg, padded_neg).otherwise(padded_pos)


def normalise_code(c, n: int = 5) -> Column:
    """Code normaliser: trim, strip a trailing ``.0``, null-like -> null, pad.

    Unlike the source pipeline (which turned missing codes into ``00nan`` or
    ``0<NA>`` strings) a missing code stays a real null so it never matches.
    """
    s = F.trim(_c(c).cast("string"))
    s = F.regexp_replace(s, r"\.0+$", "")
    s = F.when(s.isNull() | F.lower(s).isin(*NULL_LIKE), F.lit(None).cast("string")).otherwise(s)
    return pad_code(s, n)


def title_case(c) -> Column:
    """Python ``str.title()``: upper-case the first letter after any non-letter."""
    parts = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)))
    return F.when(_c(c).isNull(), F.lit(None).cast("string")).otherwise(F.array_join(cap, ""))


def strip_place_suffix(c) -> Column:
    """Drop the last ``, xxx`` part of a place name ("Autauga County, Alabama")."""
    return F.trim(F.regexp_replace(F.trim(_c(c)), r",\s*[^,]+$", ""))


def _state_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(STATE_ABBR_TO_FULL.items())])


def state_full_name(c) -> Column:
    """2-letter abbreviation -> full name, anything else title-cased; blank -> ''."""
    s = F.trim(_c(c).cast("string"))
    looked = F.element_at(_state_map(), F.upper(s))
    out = F.when(F.length(s) == 2, F.coalesce(looked, title_case(s))).otherwise(title_case(s))
    return F.when(s.isNull() | (s == ""), F.lit("")).otherwise(out)



def county_form(c) -> Column:
    """Title-case and make sure the name ends with `` County``; blank -> ''."""
    s = title_case(F.trim(_c(c).cast("string")))
    out = F.when(s.endswith(" County"), s).otherwise(F.concat(s, F.lit(" County")))
    return F.when(_c(c).isNull() | (F.trim(_c(c)) == ""), F.lit("")).otherwise(out)


def combine_codes(parts: list, widths: list[int]) -> Column:
    """Concatenate per-part zero-padded codes (state 2 + county 3 -> FIPS 5)."""
    return F.concat(*[pad_code(p, w) for p, w in zip(parts, widths)])


def combine_text(parts: list, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.trim(_c(p)) for p in parts])


def composite_key(state, county) -> Column:
    """state || '||' || county, the modelling-table key."""
    return F.concat(_c(state), F.lit("||"), _c(county))


def display_label(county, state) -> Column:
    return F.concat_ws(", ", _c(county), _c(state))


def is_blank_key(c) -> Column:
    s = F.lower(F.trim(_c(c).cast("string")))
    return s.isNull() | s.isin(*NULL_LIKE)
