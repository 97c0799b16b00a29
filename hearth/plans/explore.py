"""Explorer queries over the feature mart and the monthly panel (Q1-Q5).

Parameters follow the source API: every optional filter is off when falsy.
User text goes through Column expressions (``contains``), never through
SQL strings, so '%' and '_' are literal characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean_round_half_up

# Sortable columns of the search and top-metric endpoints.
SEARCH_SORTS = ("value_score", "affordability_score", "zhvi_sfr", "median_income",
                "education_index", "price_to_income_ratio", "safety_index",
                "air_quality_index", "natural_amenity_score")
TOP_METRICS = ("education_index", "academic_score", "median_income", "owner_occupied_pct",
               "market_heat_index", "value_score", "affordability_score")
SEARCH_COLUMNS = (
    "zip_code", "city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent",
    "median_sale_price", "days_to_pending", "market_heat_index", "median_income",
    "owner_occupied_pct", "total_schools", "academic_score", "education_index",
    "price_to_income_ratio", "affordability_score", "value_score", "value_tier",
    "safety_index", "violent_crime_rate", "property_crime_rate", "air_quality_index",
    "median_aqi", "natural_amenity_score", "amenity_rank", "total_population",
    "pop_density_class", "last_updated",
)


def all_of(conditions) -> Column:
    conditions = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def state_is(state: str | None) -> Column | None:
    return (F.upper(F.col("state")) == state.upper()) if state else None


def metro_like(metro: str | None) -> Column | None:
    return F.lower(F.col("metro_area")).contains(metro.lower()) if metro else None


def as_of_date(panel: DataFrame, as_of=None) -> Column:
    """The reference date of time-relative queries: a literal, or the
    panel's latest month as a scalar subquery."""
    if as_of is not None:
        return F.lit(as_of).cast("date")
    if "month" in panel.columns:
        # month-partitioned panel: find the newest partition first, then read
        # dates from that partition only
        newest = panel.select(F.max("month")).scalar()
        return panel.where(F.col("month") == newest).select(F.max("date")).scalar()
    return panel.select(F.max("date")).scalar()


def trailing_months(panel: DataFrame, months: int, as_of=None) -> Column:
    """``date >= as_of - months``; on a month-partitioned panel the same
    bound is also put on the ``month`` partition column so the scan skips
    whole directories."""
    start = F.add_months(as_of_date(panel, as_of), -months)
    cond = F.col("date") >= start
    if "month" in panel.columns:
        cond = cond & (F.col("month") >= F.date_format(start, "yyyy-MM"))
    return cond


def search_neighborhoods(features: DataFrame, q: str | None = None, state: str | None = None,
                         min_price=None, max_price=None, max_budget=None, min_education=None,
                         min_income=None, value_tier: str | None = None, min_population=None,
                         max_population=None, pop_class: str | None = None, min_safety=None,
                         min_air_quality=None, sort_by: str = "value_score",
                         limit: int = 20) -> DataFrame:
    """Q1: dynamic conjunctive filter + whitelisted sort, NULLS LAST, top-n
    (TakeOrderedAndProject: a per-partition heap, one small merge)."""
    if sort_by not in SEARCH_SORTS:
        sort_by = "value_score"
    z = F.col("zhvi_sfr")
    cond = all_of([
        F.col("zip_code").isNotNull(),
        (F.lower(F.col("city")).contains(q.lower()) | F.col("zip_code").contains(q)) if q else None,
        state_is(state),
        (z <= max_budget) if max_budget else None,
        (z >= min_price) if min_price else None,
        (z <= max_price) if max_price else None,
        (F.col("education_index") >= min_education) if min_education else None,
        (F.col("median_income") >= min_income) if min_income else None,
        (F.col("value_tier") == value_tier) if value_tier else None,
        (F.col("total_population") >= min_population) if min_population else None,
        (F.col("total_population") <= max_population) if max_population else None,
        (F.col("pop_density_class") == pop_class) if pop_class else None,
        (F.col("safety_index") >= min_safety) if min_safety else None,
        (F.col("air_quality_index") >= min_air_quality) if min_air_quality else None,
    ])
    key = F.col(sort_by)
    order = key.asc_nulls_last() if sort_by == "price_to_income_ratio" else key.desc_nulls_last()
    return (features.where(cond).select(*SEARCH_COLUMNS)
                    .orderBy(order, F.col("zip_code").asc()).limit(limit))


def get_neighborhoods(features: DataFrame, zips: DataFrame) -> DataFrame:
    """Q2 (batch lookup): feature rows of the requested zip codes. The
    request list is made distinct before it is shuffled for the semi join."""
    return features.join(zips.select("zip_code").distinct(), "zip_code", "left_semi")


def price_history(panel: DataFrame, zips: DataFrame, months: int = 24, as_of=None,
                  last_n: int | None = None) -> DataFrame:
    """Q3 (batch): trailing-N-month history of the requested zips;
    ``last_n`` keeps only each zip's latest rows (W6: the explorer shows 6)."""
    rows = (panel.where(trailing_months(panel, months, as_of))
                 .select("zip_code", "date", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent"))
    rows = rows.join(zips.select("zip_code").distinct(), "zip_code", "left_semi")
    if last_n:
        latest = Window.partitionBy("zip_code").orderBy(F.col("date").desc())
        rows = rows.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= last_n) \
                   .drop("_rn")
    # the order is within a zip: no global sort of the output
    return rows.repartition("zip_code").sortWithinPartitions("zip_code", "date")


def top_neighborhoods(features: DataFrame, metric: str, state: str | None = None,
                      limit: int = 10) -> DataFrame:
    """Q4: top-n zips by a whitelisted metric."""
    if metric not in TOP_METRICS:
        raise ValueError(f"metric must be one of {TOP_METRICS}")
    cond = all_of([F.col(metric).isNotNull(), F.col("city").isNotNull(), state_is(state)])
    return (features.where(cond)
            .select("zip_code", "city", "state", "metro_area", "zhvi_sfr", "median_income",
                    "education_index", "academic_score", "market_heat_index",
                    F.col(metric).alias("sort_metric"))
            .orderBy(F.col("sort_metric").desc(), F.col("zip_code").asc()).limit(limit))


def metro_summary(features: DataFrame, state: str | None = None, limit: int = 20) -> DataFrame:
    """Q5: per-metro averages, top-n by average home value."""
    cond = all_of([F.col("metro_area").isNotNull(), state_is(state)])
    return (features.where(cond).groupBy("metro_area", "state")
            .agg(F.countDistinct("zip_code").alias("zip_count"),
                 mean_round_half_up("zhvi_sfr", None, 0).alias("avg_home_value"),
                 mean_round_half_up("median_income", None, 0).alias("avg_income"),
                 mean_round_half_up("education_index", 1, 1).alias("avg_education_index"),
                 mean_round_half_up("market_heat_index", None, 2).alias("avg_heat_index"))
            .orderBy(F.col("avg_home_value").desc_nulls_last(), "metro_area", "state")
            .limit(limit))
