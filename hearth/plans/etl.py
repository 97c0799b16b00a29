"""Batch ETL: raw files -> zip-level and metro-level tables (E1-E5).

Every builder takes DataFrames (raw columns as strings or numbers) and
returns a DataFrame; reading and writing live in ``sources.io``. Global
statistics (95th percentiles, min/max, latest year) are scalar subqueries
evaluated once and broadcast as values, never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import (COUNTY_SUFFIXES_CRIME, COUNTY_SUFFIXES_CROSSWALK,
                               COUNTY_SUFFIXES_QUALITY, clean_county, col_or_null,
                               contains_flag, extract_zip, first_col, normalize_headers,
                               state_abbreviation, state_from_county_name,
                               strip_state_suffix, upper_trim, yes_flag, zfill5)
from ..functions.indices import (air_quality_index, education_index, minmax_0_100,
                                 natural_amenity_score, p95_clip_score, pct,
                                 rate_per_100k, safety_index)
from ..functions.numeric import exact_mean, nonzero, round_half_even, to_int, to_num
from ..operators.selection import exact_percentiles
from ..operators.county import join_county_metrics
from ..operators.reshape import align_outer, melt_wide
from ..session import cut_lineage
from ..sources.io import drop_repeated_header

# ---------------------------------------------------------------------------
# Id columns of the wide market files and their value names.
# ---------------------------------------------------------------------------
METRO_ID_COLS = ("RegionID", "SizeRank", "RegionName", "RegionType", "StateName")
ZIP_ID_COLS = ("RegionID", "SizeRank", "RegionName", "RegionType", "StateName",
               "State", "City", "Metro", "CountyName")
METRO_VALUE_NAMES = ("median_sale_price", "days_to_pending", "market_heat_index",
                     "for_sale_inventory", "pct_sold_above_list")
ZIP_VALUE_NAMES = ("zhvi_sfr", "zhvi_sfrcondo", "zori_rent")
ACTIVE_SCHOOL_STATUS = (1, 2, 3, 4)
AMENITY_COLUMNS = (
    "fips_code", "fips_used", "state", "county", "census_division",
    "rural_urban_code", "urban_influence", "jan_temp", "jan_sun",
    "jul_temp", "jul_humidity", "topography_code", "water_area_pct",
    "water_area_log", "jan_temp_z", "jan_sun_z", "jul_temp_z",
    "jul_humidity_z", "topography_z", "water_area_z",
    "amenity_scale", "amenity_rank",
)
SEDA_NAME_CANDIDATES = ("sedaleaname", "sedaleanm", "geodistname", "distname", "leanm")
SEDA_STATE_CANDIDATES = ("stateabb", "state", "st")
# ---------------------------------------------------------------------------


def _present(df: DataFrame, ids) -> list[str]:
    return [c for c in ids if c in df.columns]


# ---------------------------------------------------------------- E1 market

def build_zip_market(raw_by_value: dict[str, DataFrame]) -> DataFrame:
    """Wide zip files (one per value name) -> long monthly zip panel."""
    longs = []
    for value_name, raw in raw_by_value.items():
        ids = _present(raw, ZIP_ID_COLS)
        long = melt_wide(raw, ids, value_name)
        longs.append(long.select(
            zfill5("RegionName").alias("zip_code"),
            col_or_null(long, "City").alias("city"),
            col_or_null(long, "State").alias("state"),
            col_or_null(long, "Metro").alias("metro_area"),
            col_or_null(long, "CountyName").alias("county"),
            "date", value_name))
    keys = ["zip_code", "city", "state", "metro_area", "county", "date"]
    return align_outer(longs, keys, list(raw_by_value))


def build_metro_market(raw_by_value: dict[str, DataFrame]) -> DataFrame:
    """Wide metro files -> long monthly metro panel (one shuffle)."""
    longs = []
    for value_name, raw in raw_by_value.items():
        long = melt_wide(raw, _present(raw, METRO_ID_COLS), value_name)
        longs.append(long.select(F.col("RegionName").alias("metro_area"),
                                 col_or_null(long, "StateName").alias("state"),
                                 "date", value_name))
    return align_outer(longs, ["metro_area", "state", "date"], list(raw_by_value))


# ---------------------------------------------------------------- E2 census

def census_income(raw: DataFrame) -> DataFrame:
    """ACS income table: GEO_ID -> zip, median income (+ margin)."""
    df = drop_repeated_header(raw, "GEO_ID", "Geography")
    out = df.select(extract_zip("GEO_ID").alias("zip_code"),
                    to_num(col_or_null(df, "S1901_C01_012E")).alias("median_income"),
                    to_num(col_or_null(df, "S1901_C01_012M")).alias("income_margin"))
    return out.where(F.col("median_income").isNotNull() & (F.col("median_income") > 0))


def census_housing(raw: DataFrame) -> DataFrame:
    df = drop_repeated_header(raw, "GEO_ID", "Geography")
    out = df.select(extract_zip("GEO_ID").alias("zip_code"),
                    to_num(col_or_null(df, "DP04_0001E")).alias("total_units"),
                    to_num(col_or_null(df, "DP04_0002E")).alias("occupied_units"),
                    to_num(col_or_null(df, "DP04_0046PE")).alias("owner_occupied_pct"),
                    to_num(col_or_null(df, "DP04_0037E")).alias("median_rooms"))
    return out.where(F.col("total_units").isNotNull() & (F.col("total_units") > 0))


def build_census(income_raw: DataFrame, housing_raw: DataFrame) -> DataFrame:
    return census_income(income_raw).join(census_housing(housing_raw), "zip_code", "inner")


# ---------------------------------------------------------------- E3 education

def school_zip_stats(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """School directory -> (per-zip counts, distinct zip/district/state)."""
    df = normalize_headers(raw, "upper")
    if "SY_STATUS" in df.columns:
        df = df.where(to_int("SY_STATUS").isin(*ACTIVE_SCHOOL_STATUS))
    df = df.select(
        zfill5(F.regexp_replace(F.col("LZIP").cast("string"), r"^(\d{5})-\d{4}$", "$1")).alias("zip_code"),
        yes_flag("CHARTER_TEXT").alias("is_charter"),
        upper_trim("LEA_NAME").alias("district_name"),
        upper_trim("LSTATE").alias("state"),
        contains_flag("LEVEL", "ELEMENTARY").alias("is_elementary"),
        contains_flag("LEVEL", "HIGH").alias("is_high"))
    by_zip = (df.groupBy("zip_code")
                .agg(F.count(F.lit(1)).alias("total_schools"),
                     F.sum("is_charter").alias("charter_schools"),
                     F.sum("is_elementary").alias("elementary_schools"),
                     F.sum("is_high").alias("high_schools"))
                .withColumn("charter_pct", pct("charter_schools", "total_schools")))
    district_zip = df.select("zip_code", "district_name", "state").distinct()
    return by_zip, district_zip


def district_scores(raw: DataFrame) -> DataFrame:
    """Long district score file -> academic_score 0-100 per district.

    Latest year only (a scalar subquery). An all-students mean serves as both
    the 'ELA' and the 'math' column, as in the source; without one the first
    two mean columns of the file do. Returns an empty frame with the full
    schema when columns are missing.
    """
    df = normalize_headers(raw, "lower")
    name_col = first_col(df, SEDA_NAME_CANDIDATES)
    state_col = first_col(df, SEDA_STATE_CANDIDATES)
    both = first_col(df, (), contains="mn_all")
    scores = [both, both] if both else [c for c in df.columns if "mn_" in c or "_mean" in c][:2]
    empty = df.sparkSession.createDataFrame(
        [], "district_name string, state string, academic_score double")
    if not name_col or len(scores) < 2:
        return empty
    if "year" in df.columns:
        latest = df.select(F.max(to_int("year"))).scalar()
        df = df.where(to_int("year") == latest)
    df = df.select(upper_trim(name_col).alias("district_name"),
                   (upper_trim(state_col) if state_col else F.lit("UNKNOWN")).alias("state"),
                   *[to_num(c).alias(f"score{i}") for i, c in enumerate(scores)])
    by_district = (df.groupBy("district_name", "state")
                     .agg(*[F.avg(f"score{i}").alias(f"avg{i}") for i in (0, 1)])
                     .where(F.col("avg0").isNotNull() & F.col("avg1").isNotNull()))
    bounds = by_district.select(F.struct(*[f(f"avg{i}").alias(f"{n}{i}") for i in (0, 1)
                                           for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    ela, math = (minmax_0_100(f"avg{i}", bounds.getField(f"lo{i}"), bounds.getField(f"hi{i}"))
                 for i in (0, 1))
    return by_district.select("district_name", "state",
                              round_half_even(ela * 0.5 + math * 0.5, 1).alias("academic_score"))


def build_education(schools_raw: DataFrame, scores_raw: DataFrame) -> DataFrame:
    by_zip, district_zip = school_zip_stats(schools_raw)
    scores = cut_lineage(district_scores(scores_raw))   # one row per district
    seda_by_zip = (district_zip.join(scores, ["district_name", "state"], "left")
                   .groupBy("zip_code")
                   .agg(exact_mean("academic_score", 1).alias("academic_score")))
    result = by_zip.join(seda_by_zip, "zip_code", "left")
    p95 = F.lit(exact_percentiles(result, {"total_schools": [0.95]})["total_schools", 0.95]).cast("double")
    schools_norm = p95_clip_score(F.col("total_schools").cast("double"), p95)
    return result.select(
        "zip_code", "total_schools", "charter_schools", "charter_pct", "academic_score",
        education_index("academic_score", schools_norm).alias("education_index"))


# ---------------------------------------------------------------- E4 crosswalk

def build_crosswalk(raw: DataFrame, suffixes=COUNTY_SUFFIXES_CROSSWALK) -> DataFrame:
    """Zip listing (RegionName, State, City, Metro, CountyName) -> distinct
    zip-county pairs. Only the five needed columns are read."""
    df = raw.select(
        zfill5("RegionName").alias("zip_code"),
        upper_trim("State").alias("state"),
        F.col("City").alias("city"),
        F.col("Metro").alias("metro_area"),
        F.trim("CountyName").alias("county_raw"),
        clean_county("CountyName", suffixes).alias("county_clean"))
    return df.distinct().where(F.col("zip_code").isNotNull() & F.col("county_clean").isNotNull())


def crosswalk_keys(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.select("zip_code", upper_trim("state").alias("state"),
                            upper_trim("county_clean").alias("county_clean"))


# ---------------------------------------------------------------- E5 quality

def crime_by_county(raw: DataFrame, suffixes=COUNTY_SUFFIXES_CRIME) -> DataFrame:
    df = normalize_headers(raw, "upper")
    county = strip_state_suffix("COUNTY_NAME")
    for sfx in suffixes:
        county = F.trim(F.regexp_replace(county, sfx + "$", ""))
    counts = {c: F.coalesce(to_num(c), F.lit(0.0))
              for c in ("MURDER", "RAPE", "ROBBERY", "AGASSLT", "BURGLRY", "LARCENY", "MVTHEFT")}
    violent = counts["MURDER"] + counts["RAPE"] + counts["ROBBERY"] + counts["AGASSLT"]
    prop = counts["BURGLRY"] + counts["LARCENY"] + counts["MVTHEFT"]
    pop = to_num("POPULATION")
    rates = df.select(county.alias("county_clean"),
                      state_from_county_name("COUNTY_NAME").alias("state_abbr"),
                      rate_per_100k(violent, pop).alias("violent_crime_rate"),
                      rate_per_100k(prop, pop).alias("property_crime_rate"))
    p95 = exact_percentiles(rates, {"violent_crime_rate": [0.95], "property_crime_rate": [0.95]})
    p95v, p95p = (F.lit(p95[c, 0.95]).cast("double") for c in ("violent_crime_rate", "property_crime_rate"))
    out = rates.withColumn("safety_index", safety_index("violent_crime_rate",
                                                        "property_crime_rate", p95v, p95p))
    return out.dropna()


def build_crime(raw: DataFrame, crosswalk: DataFrame,
                match: str = "fuzzy") -> DataFrame:
    # The county table (one row per county) is written to the checkpoint
    # folder: the zip join then scans stored rows instead of re-planning
    # the percentile subqueries.
    return join_county_metrics(crosswalk_keys(crosswalk), cut_lineage(crime_by_county(raw)),
                               ["violent_crime_rate", "property_crime_rate", "safety_index"],
                               match=match)


def aqi_by_county(raw: DataFrame, state_is_abbreviation: bool = False,
                  suffixes=COUNTY_SUFFIXES_QUALITY) -> DataFrame:
    df = normalize_headers(raw, "strip_quotes")
    df = df.withColumnsRenamed({k: v for k, v in {
        "State": "state", "County": "county", "Median AQI": "median_aqi",
        "Good Days": "good_days", "Days with AQI": "days_with_aqi",
        "Unhealthy Days": "unhealthy_days", "Hazardous Days": "hazardous_days",
    }.items() if k in df.columns})
    state = (upper_trim("state_abbr") if "state_abbr" in df.columns else
             upper_trim("state") if state_is_abbreviation else state_abbreviation("state"))
    base = df.select(clean_county("county", suffixes).alias("county_clean"),
                     state.alias("state_abbr"),
                     to_num("median_aqi").alias("median_aqi"),
                     round_half_even(to_num("good_days") / nonzero(to_num("days_with_aqi")) * 100.0,
                                     1).alias("good_day_pct"))
    p95 = F.lit(exact_percentiles(base, {"median_aqi": [0.95]})["median_aqi", 0.95]).cast("double")
    return base.withColumn("air_quality_index", air_quality_index("median_aqi", p95)).dropna()


def build_air_quality(raw: DataFrame, crosswalk: DataFrame,
                      state_is_abbreviation: bool = False) -> DataFrame:
    return join_county_metrics(crosswalk_keys(crosswalk),
                               cut_lineage(aqi_by_county(raw, state_is_abbreviation)),
                               ["median_aqi", "good_day_pct", "air_quality_index"],
                               match="exact")


def amenities_by_county(raw: DataFrame, positional: bool = False,
                        suffixes=COUNTY_SUFFIXES_QUALITY) -> DataFrame:
    from ..functions.clean import rename_positional
    df = rename_positional(raw, AMENITY_COLUMNS) if positional else raw
    rank = to_num("amenity_rank")
    return df.select(clean_county("county", suffixes).alias("county_clean"),
                     upper_trim("state").alias("state"),
                     rank.alias("amenity_rank"),
                     natural_amenity_score(rank).alias("natural_amenity_score"),
                     to_num("topography_z").alias("topography_z"),
                     to_num("water_area_pct").alias("water_area_pct")
                     ).where(F.col("amenity_rank").isNotNull())


def build_amenities(raw: DataFrame, crosswalk: DataFrame, positional: bool = False) -> DataFrame:
    return join_county_metrics(crosswalk_keys(crosswalk),
                               cut_lineage(amenities_by_county(raw, positional)),
                               ["amenity_rank", "natural_amenity_score", "topography_z",
                                "water_area_pct"],
                               county_state_col="state", match="exact")


# ---------------------------------------------------------------- A15-A18

def match_report(education: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Quality metrics as one DataFrame: match rate of academic scores and
    crosswalk statistics (rows, distinct zips, distinct counties)."""
    edu = education.agg(F.count("academic_score").alias("academic_matched"),
                        F.count(F.lit(1)).alias("education_rows"))
    xw = crosswalk.agg(F.count(F.lit(1)).alias("crosswalk_rows"),
                       F.countDistinct("zip_code").alias("crosswalk_zips"),
                       F.countDistinct("county_clean").alias("crosswalk_counties"))
    return (edu.select("*", *[xw.select(c).scalar().alias(c) for c in xw.columns])
               .withColumn("academic_match_pct",
                           round_half_even(F.try_divide(F.col("academic_matched") * 100.0,
                                                        F.col("education_rows")), 1)))
