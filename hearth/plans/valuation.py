"""Valuation: property estimates, forecasts and market trends (Q15-Q17,
N22-N26, W3-W4), all as batch jobs over DataFrames of requests.

Per-zip trend statistics come from a bounded trailing window of the panel
(12-14 months per zip), so the per-zip groups stay small however long the
panel grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import falsy_to, round_half_even
from .explore import as_of_date, trailing_months

# ---------------------------------------------------------------------------
# Fixed values of the two valuation formulas.
# ---------------------------------------------------------------------------
MEDIAN_SQFT = 1800.0
SIZE_EXPONENT = 0.85
ML_ADJ = {"bed": 0.035, "bath": 0.025, "age": 0.0025, "age_floor": 0.70, "garage": 1.035,
          "condition": {"excellent": 1.08, "good": 1.00, "fair": 0.89, "poor": 0.76},
          "type": {"single_family": 1.00, "condo": 0.87, "townhouse": 0.93}}
FALLBACK_ADJ = {"bed": 0.04, "bath": 0.03, "age": 0.003, "age_floor": 0.65, "garage": 1.04,
                "condition": {"excellent": 1.10, "good": 1.00, "fair": 0.88, "poor": 0.75},
                "type": {"single_family": 1.00, "condo": 0.88, "townhouse": 0.93}}
FALLBACK_BASE_PRICE = 350000.0
FALLBACK_RANGE = (0.92, 1.08)
FALLBACK_CONFIDENCE = 75.0
DEFAULT_GROWTH = 0.04
GROWTH_CLIP = (-0.10, 0.20)
FORECAST_MARGIN = (0.06, 0.03)      # base, added per extra year
TREND_MONTHS = 14
# ---------------------------------------------------------------------------


def _lookup(c: Column, mapping: dict, default: float = 1.0) -> Column:
    key = F.lower(c)
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def adjusted_value(base: Column, p: dict, year_now: Column) -> Column:
    """Base price times the property adjustments (size, beds, baths, age,
    condition, type, garage) of one constant set, multiplied left to right
    in the source's order (floating-point products are order-sensitive)."""
    size = F.pow(F.col("sqft") / MEDIAN_SQFT, SIZE_EXPONENT)
    bed = 1 + (F.col("bedrooms") - 3) * p["bed"]
    bath = 1 + (F.col("bathrooms") - 2) * p["bath"]
    age = F.greatest(F.lit(0), year_now - F.col("year_built"))
    age_adj = F.greatest(F.lit(p["age_floor"]), 1 - age * p["age"])
    cond = _lookup(F.col("condition"), p["condition"])
    typ = _lookup(F.col("property_type"), p["type"])
    garage = F.when(F.col("garage"), p["garage"]).otherwise(1.0)
    return base * size * bed * bath * age_adj * cond * typ * garage


def fallback_base() -> Column:
    """The formula's base price: house value, else condo value, else a constant."""
    return falsy_to("zhvi_sfr", falsy_to("zhvi_sfrcondo", FALLBACK_BASE_PRICE))


def valuation_fallback(properties: DataFrame, features: DataFrame, panel: DataFrame,
                       as_of=None) -> DataFrame:
    """Formula valuation of every property whose zip is in the mart
    (unmatched zips are the 404s of the source API; see ``unmatched``)."""
    year_now = F.year(as_of_date(panel, as_of))
    nb = features.select("zip_code", "city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo")
    df = properties.join(nb, "zip_code", "inner")
    est = adjusted_value(fallback_base(), FALLBACK_ADJ, year_now)
    lo, hi = FALLBACK_RANGE
    return df.select(
        "property_id", "zip_code", "city", "state", "metro_area", "forecast_years",
        round_half_even(est, -2).alias("estimated_value"),
        round_half_even(est * lo, -2).alias("low_estimate"),
        round_half_even(est * hi, -2).alias("high_estimate"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        round_half_even(F.try_divide(est, F.col("sqft")), 2).alias("price_per_sqft"),
        F.lit("fallback").alias("model_version"))


def unmatched(properties: DataFrame, features: DataFrame) -> DataFrame:
    """Requests whose zip code is not in the mart."""
    return properties.join(features.select("zip_code"), "zip_code", "left_anti")


def recent_trend_stats(panel: DataFrame, months: int = TREND_MONTHS, as_of=None) -> DataFrame:
    """Per zip over the trailing window: row count, latest value and the
    values 12 and 3 rows back from the end (positions -1, -12, -3 of the
    ascending list, as the source indexes them)."""
    w = Window.partitionBy("zip_code").orderBy(F.col("date").desc())
    ranked = (panel.where(trailing_months(panel, months, as_of)).select("zip_code", "date", "zhvi_sfr")
                   .withColumn("_rn", F.row_number().over(w)))
    return ranked.groupBy("zip_code").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.max(F.when(F.col("_rn") == 1, F.col("zhvi_sfr"))).alias("zhvi_last"),
        F.max(F.when(F.col("_rn") == 12, F.col("zhvi_sfr"))).alias("zhvi_12th_last"),
        F.max(F.when(F.col("_rn") == 3, F.col("zhvi_sfr"))).alias("zhvi_3rd_last"))


def growth_rate(n_months: Column, last: Column, twelfth_last: Column, base: Column) -> Column:
    """Annual growth from the trend, default 4 %, clipped to [-10 %, 20 %]."""
    current = falsy_to(last, base)
    year_ago = falsy_to(twelfth_last, current)
    raw = (current - year_ago) / year_ago
    lo, hi = GROWTH_CLIP
    clipped = F.least(F.greatest(raw, F.lit(lo)), F.lit(hi))
    ok = (n_months >= 12) & year_ago.isNotNull() & (year_ago > 0)
    return F.when(ok, clipped).otherwise(F.lit(DEFAULT_GROWTH))


def forecast_fields(base: Column, rate: Column, yr: Column, year_now: Column) -> list[Column]:
    """The columns of one forecast year."""
    projected = base * F.pow(1 + rate, yr)
    m0, step = FORECAST_MARGIN
    margin = m0 + (yr - 1) * step
    return [(year_now + yr).cast("int").alias("year"),
            round_half_even(projected, -2).alias("projected_value"),
            round_half_even(projected * (1 - margin), -2).alias("low_estimate"),
            round_half_even(projected * (1 + margin), -2).alias("high_estimate"),
            round_half_even(rate * 100, 1).alias("annual_rate_pct"),
            round_half_even(F.try_divide(projected - base, base) * 100, 1).alias("total_gain_pct")]


def forecast(valuations: DataFrame, panel: DataFrame, as_of=None) -> DataFrame:
    """One row per property and forecast year (years <= 0: no rows)."""
    as_of_c = as_of_date(panel, as_of)
    stats = recent_trend_stats(panel, as_of=as_of)
    v = valuations.where(F.col("forecast_years") >= 1).join(stats, "zip_code", "left")
    base = F.col("estimated_value")
    rate = growth_rate(F.coalesce(F.col("n_months"), F.lit(0)), F.col("zhvi_last"),
                       F.col("zhvi_12th_last"), base)
    v = v.select("property_id", base.alias("base_value"), rate.alias("annual_rate"),
                 F.explode(F.sequence(F.lit(1), F.col("forecast_years"))).alias("yr"))
    return v.select("property_id", *forecast_fields(F.col("base_value"), F.col("annual_rate"),
                                                    F.col("yr"), F.year(as_of_c)))


def market_trends(panel: DataFrame, zips: DataFrame, months: int = 12, as_of=None) -> DataFrame:
    """Q17 (batch): trailing rows per zip plus first-to-last appreciation
    (NULL with fewer than 2 rows, 0 when the first value is 0/NULL)."""
    rows = (panel.where(trailing_months(panel, months, as_of))
                 .select("zip_code", "date", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent")
                 .join(zips.select("zip_code").distinct(), "zip_code", "left_semi"))
    w = Window.partitionBy("zip_code")
    first = F.coalesce(F.min_by("zhvi_sfr", "date").over(w), F.lit(0.0))
    last = F.coalesce(F.max_by("zhvi_sfr", "date").over(w), F.lit(0.0))
    n = F.count(F.lit(1)).over(w)
    appreciation = (F.when(n < 2, F.lit(None).cast("double"))
                    .when(first == 0, F.lit(0.0))
                    .otherwise(round_half_even((last - first) / first * 100, 2)))
    return rows.withColumn("appreciation", appreciation)


def comparables(features: DataFrame, k: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """Q16 (batch): for each target zip, the k zips of the same metro with
    the closest home value (ties: smaller zip first).

    No metro-wide self join: zips are numbered in (metro, value, zip) order
    and each target meets only the candidates within 3k positions of its
    own. That band provably holds the answer once every run of identical
    (metro, value) is cut to its k+1 smallest zips: at most 2k rows below
    and k above are needed, plus at most k tied rows on each side. Targets
    beyond the first k+1 of such a run take its first k zips directly.
    """
    from ..operators.positions import band_join, with_positions
    cols = ["zip_code", "city", "state", "metro_area", "zhvi_sfr", "median_income",
            "education_index"]
    f = features.where(F.col("zhvi_sfr").isNotNull() & F.col("metro_area").isNotNull()).select(*cols)
    run = Window.partitionBy("metro_area", "zhvi_sfr").orderBy("zip_code")
    cand = f.withColumn("_g", F.row_number().over(run)).where(F.col("_g") <= k + 1)
    if targets is not None:
        f = f.join(targets.select("zip_code"), "zip_code", "left_semi")
    overflow = f.join(cand.select("zip_code"), "zip_code", "left_anti")
    pos = with_positions(cand, [F.col("metro_area"), F.col("zhvi_sfr"), F.col("zip_code")])
    probe_rows = pos if targets is None else pos.join(targets.select("zip_code"), "zip_code",
                                                       "left_semi")
    probe = (probe_rows
                .select(F.col("zip_code").alias("target_zip"), F.col("metro_area").alias("_tm"),
                        F.col("zhvi_sfr").alias("_tv"), F.col("_pos").alias("_tp")))
    build = pos.select(*cols, F.col("_pos").alias("_cp"))
    w = 3 * k
    pairs = (band_join(probe, build, "_tp", "_cp", -w, w, block=w)
             .where((F.col("metro_area") == F.col("_tm")) & (F.col("zip_code") != F.col("target_zip")))
             .withColumn("value_diff", F.abs(F.col("zhvi_sfr") - F.col("_tv"))))
    heads = cand.where(F.col("_g") <= k).select(*cols)
    tied = (overflow.select(F.col("zip_code").alias("target_zip"), F.col("metro_area").alias("_tm"),
                            F.col("zhvi_sfr").alias("_tv"))
            .join(heads, (F.col("metro_area") == F.col("_tm")) & (F.col("zhvi_sfr") == F.col("_tv")))
            .withColumn("value_diff", F.lit(0.0)))
    out_cols = ["target_zip", "zip_code", "city", "state", "zhvi_sfr", "median_income",
                "education_index", "value_diff"]
    both = pairs.select(*out_cols).unionByName(tied.select(*out_cols))
    rank = Window.partitionBy("target_zip").orderBy("value_diff", "zip_code")
    return (both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k))
