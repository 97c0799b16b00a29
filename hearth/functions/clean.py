"""Cleaning expressions (zip codes, county names, states, flags).

All are native column expressions: no Python UDF is involved.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col_

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's lists (order matters:
# suffixes are stripped one after another, in this order).
# ---------------------------------------------------------------------------
COUNTY_SUFFIXES_CROSSWALK = (
    " COUNTY", " PARISH", " BOROUGH", " CENSUS AREA", " CITY AND BOROUGH",
    " MUNICIPALITY", " DISTRICT",
)
COUNTY_SUFFIXES_QUALITY = (
    " COUNTY", " PARISH", " BOROUGH", " CENSUS AREA", " CITY AND BOROUGH",
    " MUNICIPALITY", " DISTRICT", " CITY",
)
COUNTY_SUFFIXES_CRIME = (
    " COUNTY", " PARISH", " BOROUGH", " CENSUS AREA", " MUNICIPALITY",
)

# State name -> postal abbreviation (fixed values, 50 states + DC).
STATE_ABBREVIATIONS = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR",
    "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT",
    "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC",
}

STATE_SUFFIX_PATTERN = r",\s*([A-Za-z]{2})\s*$"
# ---------------------------------------------------------------------------


def upper_trim(c) -> Column:
    return F.upper(F.trim(col_(c)))


def zfill5(c) -> Column:
    """pandas ``zfill(5)``: pad short values, never truncate long ones
    (``lpad`` alone would cut '123456' to '12345')."""
    c = F.trim(col_(c).cast("string"))
    return F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)


def extract_zip(c) -> Column:
    """Text after the last 'US' of a GEO_ID, else its last 5 characters;
    zero-filled to 5."""
    c = col_(c).cast("string")
    after_us = F.trim(F.element_at(F.split(c, "US"), -1))
    last5 = F.substring(c, -5, 5)
    return zfill5(F.when(c.contains("US"), after_us).otherwise(last5))


def clean_county(c, suffixes=COUNTY_SUFFIXES_CROSSWALK,
                 longest_first: bool = False) -> Column:
    """Upper-case, trim, then strip each suffix in turn (sequential order
    is the source behaviour; ``longest_first`` fixes 'CITY AND BOROUGH')."""
    out = upper_trim(c)
    order = sorted(suffixes, key=len, reverse=True) if longest_first else suffixes
    for sfx in order:
        out = F.trim(F.regexp_replace(out, sfx + "$", ""))
    return out


def state_from_county_name(c) -> Column:
    """'Travis County, TX' -> 'TX'; no match -> NULL (not '')."""
    s = F.regexp_extract(F.trim(col_(c)), STATE_SUFFIX_PATTERN, 1)
    return F.nullif(F.upper(F.trim(s)), F.lit(""))


def strip_state_suffix(c) -> Column:
    return upper_trim(F.regexp_replace(F.trim(col_(c)), STATE_SUFFIX_PATTERN, ""))


def state_abbreviation(c) -> Column:
    """Full state name -> postal code; unmapped -> NULL (a literal map,
    evaluated inside the generated code, no join)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATE_ABBREVIATIONS.items())])
    return m[upper_trim(c)]


def fuzzy_key(c) -> Column:
    return F.regexp_replace(col_(c), "[^A-Z0-9]", "")


def yes_flag(c) -> Column:
    return F.coalesce((upper_trim(c) == "YES").cast("int"), F.lit(0))


def contains_flag(c, word: str) -> Column:
    return F.coalesce(F.upper(col_(c)).contains(word).cast("int"), F.lit(0))


def short_metro(c) -> Column:
    """'Austin, TX' -> 'Austin' (text before the first comma)."""
    return F.substring_index(col_(c), ",", 1)


def aqi_label(c) -> Column:
    c = col_(c)
    return F.when(c <= 50, "Good").when(c <= 100, "Moderate").when(c.isNotNull(), "Unhealthy")


# ---------------------------------------------------------------------------
# Schema helpers
# ---------------------------------------------------------------------------

def normalize_headers(df: DataFrame, how: str = "upper") -> DataFrame:
    """Header normalisation: 'upper', 'lower' or 'strip_quotes'."""
    def f(name: str) -> str:
        n = name.strip()
        if how == "upper":
            return n.upper()
        if how == "lower":
            return n.lower()
        return n.strip('"')
    return df.toDF(*[f(c) for c in df.columns])


def rename_positional(df: DataFrame, names) -> DataFrame:
    """Assign names by position (extra source columns keep theirs)."""
    names = list(names)
    n = min(len(names), len(df.columns))
    return df.toDF(*(names[:n] + df.columns[n:]))


def first_col(df: DataFrame, candidates, contains: str | None = None) -> str | None:
    """First candidate present in the schema (or first containing a word)."""
    for c in candidates:
        if c in df.columns:
            return c
    if contains:
        for c in df.columns:
            if contains in c:
                return c
    return None


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """Missing-column-tolerant select."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)
