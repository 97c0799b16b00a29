"""The neighborhood feature mart (E6) and latest-row snapshots (W5).

The source system never shipped the SQL that builds this table; its
columns and scores follow the documented methodology (SURVEY §2.8 N12-N17
and the [D] decisions there). Every zip-level input is one row per zip, so
the chained left joins are all zip-keyed: Catalyst plans them as
sort-merge joins on one co-partitioned key (or broadcasts under the AQE
size threshold) and the metro snapshot, a few hundred rows, is joined on
metro_area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indices as ix

FEATURE_COLUMNS = (
    "zip_code", "city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent",
    "median_sale_price", "days_to_pending", "market_heat_index", "median_income",
    "owner_occupied_pct", "total_schools", "academic_score", "education_index",
    "safety_index", "violent_crime_rate", "property_crime_rate", "air_quality_index",
    "median_aqi", "natural_amenity_score", "amenity_rank", "topography_z", "water_area_pct",
    "price_to_income_ratio", "affordability_score", "value_score", "value_tier",
    "total_population", "pop_density_class", "last_updated",
)


def latest_by_key(panel: DataFrame, keys, value_cols, date_col: str = "date") -> DataFrame:
    """Latest row per key as a ``max_by`` aggregate: partial aggregation
    before the shuffle, so a key with millions of months costs one row per
    map task, not a sort of the whole group."""
    keys = list(keys)
    value_cols = list(value_cols)
    packed = F.max_by(F.struct(*value_cols, F.col(date_col).alias("_d")), date_col)
    return (panel.groupBy(*keys).agg(packed.alias("_l"))
                 .select(*keys, *[F.col("_l")[c].alias(c) for c in value_cols],
                         F.col("_l._d").alias(date_col)))


def zip_snapshot(zip_market: DataFrame) -> DataFrame:
    """Latest panel row per zip: the mart's base."""
    snap = latest_by_key(zip_market, ["zip_code"],
                         ["city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo",
                          "zori_rent"])
    return snap.withColumnRenamed("date", "last_updated")


def metro_snapshot(metro_market: DataFrame) -> DataFrame:
    return latest_by_key(metro_market, ["metro_area"],
                         ["median_sale_price", "days_to_pending", "market_heat_index"]) \
        .drop("date")


def build_neighborhood_features(base: DataFrame, census: DataFrame,
                                education: DataFrame | None = None,
                                crime: DataFrame | None = None,
                                air_quality: DataFrame | None = None,
                                amenities: DataFrame | None = None,
                                metro: DataFrame | None = None) -> DataFrame:
    """base (one row per zip) + zip-level tables -> 31-column feature mart."""
    spark = base.sparkSession

    def part(df, cols, schema):
        if df is None:
            return spark.createDataFrame([], schema)
        return df.select("zip_code", *cols)

    c = census.select("zip_code", "median_income", "owner_occupied_pct", "occupied_units")
    e = part(education, ["total_schools", "academic_score", "education_index"],
             "zip_code string, total_schools long, academic_score double, education_index double")
    k = part(crime, ["safety_index", "violent_crime_rate", "property_crime_rate"],
             "zip_code string, safety_index double, violent_crime_rate double, "
             "property_crime_rate double")
    a = part(air_quality, ["air_quality_index", "median_aqi"],
             "zip_code string, air_quality_index double, median_aqi double")
    n = part(amenities, ["natural_amenity_score", "amenity_rank", "topography_z",
                         "water_area_pct"],
             "zip_code string, natural_amenity_score double, amenity_rank double, "
             "topography_z double, water_area_pct double")
    df = (base.join(c, "zip_code", "left").join(e, "zip_code", "left")
              .join(k, "zip_code", "left").join(a, "zip_code", "left")
              .join(n, "zip_code", "left"))
    if metro is None:
        metro = spark.createDataFrame([], "metro_area string, median_sale_price double, "
                                          "days_to_pending double, market_heat_index double")
    df = df.join(metro.select("metro_area", "median_sale_price", "days_to_pending",
                              "market_heat_index"), "metro_area", "left")

    pti = ix.price_to_income("zhvi_sfr", "median_income")
    pop = ix.total_population("occupied_units")
    df = (df.withColumn("price_to_income_ratio", pti)
            .withColumn("total_population", pop)
            .withColumn("pop_density_class", ix.density_class("total_population"))
            .withColumn("affordability_score", ix.affordability_score("price_to_income_ratio"))
            .withColumn("value_tier", ix.value_tier("price_to_income_ratio", "education_index")))
    df = df.withColumn("value_score", ix.value_score(
        "affordability_score", "safety_index", "education_index", "air_quality_index",
        "natural_amenity_score", "value_tier"))
    return df.select(*FEATURE_COLUMNS)
