"""Dashboard queries (Q6-Q11): KPIs, trends, metro comparison, value bins,
education vs value, affordability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean_round_half_up, round_half_up
from .explore import all_of, metro_like, state_is, trailing_months

# Home-value bins (upper bounds, label), last one open-ended.
VALUE_BINS = ((200000, "Under $200K"), (400000, "$200K - $400K"), (600000, "$400K - $600K"),
              (800000, "$600K - $800K"), (1000000, "$800K - $1M"))
VALUE_BIN_OPEN = "Over $1M"


def kpis(features: DataFrame, metro_area: str | None = None,
         state: str | None = None) -> DataFrame:
    """Q6: one-row summary; the two COUNT DISTINCTs are planned by Catalyst
    as one Expand + two-phase aggregate."""
    cond = all_of([F.col("zhvi_sfr").isNotNull(), metro_like(metro_area), state_is(state)])
    return features.where(cond).agg(
        mean_round_half_up("zhvi_sfr", None, 0).alias("avg_home_value"),
        mean_round_half_up("median_income", None, 0).alias("avg_median_income"),
        mean_round_half_up("education_index", 1, 1).alias("avg_education_index"),
        mean_round_half_up("owner_occupied_pct", 1, 1).alias("avg_owner_occupied"),
        F.countDistinct("zip_code").alias("total_zip_codes"),
        F.countDistinct("metro_area").alias("total_metros"))


def price_trends(panel: DataFrame, metro_area: str | None = None, state: str | None = None,
                 months: int = 24, interval: str = "month", as_of=None) -> DataFrame:
    """Q7: panel averages per month or quarter over a trailing window."""
    unit = "quarter" if interval == "quarter" else "month"
    cond = all_of([trailing_months(panel, months, as_of), metro_like(metro_area), state_is(state)])
    return (panel.where(cond)
            .groupBy(F.trunc("date", unit).alias("period"))
            .agg(mean_round_half_up("zhvi_sfr", None, 0).alias("avg_zhvi_sfr"),
                 mean_round_half_up("zhvi_sfrcondo", None, 0).alias("avg_zhvi_sfrcondo"),
                 mean_round_half_up("zori_rent", None, 0).alias("avg_rent"),
                 F.countDistinct("zip_code").alias("zip_count"))
            .orderBy("period"))


def metro_comparison(features: DataFrame, state: str | None = None,
                     limit: int = 15) -> DataFrame:
    """Q8: per-metro comparison, top-n by average home value."""
    cond = all_of([F.col("metro_area").isNotNull(), F.col("zhvi_sfr").isNotNull(),
                   state_is(state)])
    return (features.where(cond).groupBy("metro_area", "state")
            .agg(F.countDistinct("zip_code").alias("zip_count"),
                 mean_round_half_up("zhvi_sfr", None, 0).alias("avg_home_value"),
                 mean_round_half_up("zori_rent", None, 0).alias("avg_rent"),
                 mean_round_half_up("median_income", None, 0).alias("avg_income"),
                 mean_round_half_up("education_index", 1, 1).alias("avg_education"),
                 mean_round_half_up("owner_occupied_pct", 1, 1).alias("avg_owner_pct"))
            .orderBy(F.col("avg_home_value").desc_nulls_last(), "metro_area", "state")
            .limit(limit))


def price_range_label(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for upper, label in VALUE_BINS:
        out = F.when(c < upper, label) if out is None else out.when(c < upper, label)
    return out.otherwise(VALUE_BIN_OPEN)


def value_distribution(features: DataFrame, metro_area: str | None = None,
                       state: str | None = None) -> DataFrame:
    """Q9: zips per home-value bin."""
    cond = all_of([F.col("zhvi_sfr").isNotNull(), metro_like(metro_area), state_is(state)])
    return (features.where(cond)
            .groupBy(price_range_label("zhvi_sfr").alias("price_range"))
            .agg(F.count(F.lit(1)).alias("zip_count"),
                 mean_round_half_up("zhvi_sfr", None, 0).alias("avg_value"))
            .orderBy("avg_value"))


def education_vs_value(features: DataFrame, state: str | None = None,
                       limit: int = 100) -> DataFrame:
    """Q10: most expensive zips with their education index."""
    cond = all_of([F.col("zhvi_sfr").isNotNull(), F.col("education_index").isNotNull(),
                   F.col("city").isNotNull(), state_is(state)])
    return (features.where(cond)
            .orderBy(F.col("zhvi_sfr").desc(), F.col("zip_code").asc()).limit(limit)
            .select("zip_code", "city", "state",
                    round_half_up("zhvi_sfr", 0).alias("home_value"),
                    round_half_up("education_index", 1).alias("education_index"),
                    round_half_up("median_income", 0).alias("median_income")))


def affordability(features: DataFrame, state: str | None = None, limit: int = 20) -> DataFrame:
    """Q11: lowest price-to-income ratios (NULL ratios first, as ASC does)."""
    cond = all_of([F.col("zhvi_sfr").isNotNull(), F.col("median_income").isNotNull(),
                   F.col("city").isNotNull(), state_is(state)])
    ratio = round_half_up(F.try_divide(F.col("zhvi_sfr"),
                                       F.nullif(F.col("median_income"), F.lit(0.0))), 2)
    return (features.where(cond)
            .select("zip_code", "city", "state", "metro_area",
                    round_half_up("zhvi_sfr", 0).alias("home_value"),
                    round_half_up("median_income", 0).alias("median_income"),
                    ratio.alias("price_to_income_ratio"),
                    round_half_up("zori_rent", 0).alias("monthly_rent"),
                    round_half_up("education_index", 1).alias("education_index"))
            .orderBy(F.col("price_to_income_ratio").asc_nulls_first(), F.col("zip_code").asc())
            .limit(limit))
