"""Fixed schemas of the warehouse tables and schema enforcement (S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, LongType, StringType, StructField,
                               StructType)


def _schema(spec: str, required=()) -> StructType:
    types = {"s": StringType(), "f": DoubleType(), "l": LongType(), "d": DateType()}
    fields = []
    for item in spec.split():
        name, t = item.split(":")
        fields.append(StructField(name, types[t], nullable=name not in required))
    return StructType(fields)


ZIP_MARKET = _schema("zip_code:s city:s state:s metro_area:s county:s date:d zhvi_sfr:f "
                     "zhvi_sfrcondo:f zori_rent:f", required=("zip_code", "date"))
METRO_MARKET = _schema("metro_area:s state:s date:d median_sale_price:f days_to_pending:f "
                       "market_heat_index:f for_sale_inventory:f pct_sold_above_list:f",
                       required=("metro_area", "date"))
CENSUS = _schema("zip_code:s median_income:f income_margin:f total_units:f occupied_units:f "
                 "owner_occupied_pct:f median_rooms:f", required=("zip_code",))
EDUCATION = _schema("zip_code:s total_schools:l charter_schools:l charter_pct:f "
                    "academic_score:f education_index:f", required=("zip_code",))
CRIME = _schema("zip_code:s violent_crime_rate:f property_crime_rate:f safety_index:f")
AIR_QUALITY = _schema("zip_code:s median_aqi:f good_day_pct:f air_quality_index:f")
NATURAL_AMENITIES = _schema("zip_code:s amenity_rank:f natural_amenity_score:f topography_z:f "
                            "water_area_pct:f")
CROSSWALK = _schema("zip_code:s state:s city:s metro_area:s county_raw:s county_clean:s")
NEIGHBORHOOD_FEATURES = _schema(
    "zip_code:s city:s state:s metro_area:s zhvi_sfr:f zhvi_sfrcondo:f zori_rent:f "
    "median_sale_price:f days_to_pending:f market_heat_index:f median_income:f "
    "owner_occupied_pct:f total_schools:l academic_score:f education_index:f safety_index:f "
    "violent_crime_rate:f property_crime_rate:f air_quality_index:f median_aqi:f "
    "natural_amenity_score:f amenity_rank:f topography_z:f water_area_pct:f "
    "price_to_income_ratio:f affordability_score:f value_score:f value_tier:s "
    "total_population:f pop_density_class:s last_updated:d",
    required=("zip_code", "last_updated"))

TABLES = {"zip_market": ZIP_MARKET, "zip_history": ZIP_MARKET, "metro_market": METRO_MARKET, "census": CENSUS,
          "education": EDUCATION, "crime": CRIME, "air_quality": AIR_QUALITY,
          "natural_amenities": NATURAL_AMENITIES, "crosswalk": CROSSWALK,
          "neighborhood_features": NEIGHBORHOOD_FEATURES}


def enforce_schema(df: DataFrame, schema: StructType, drop_invalid: bool = False) -> DataFrame:
    """Select the schema's columns in order, ``try_cast`` each to its type
    (missing columns become NULL). A NULL in a required column fails the job,
    as the load of the source does; ``drop_invalid`` drops such rows instead."""
    cols = []
    for f in schema.fields:
        src = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(src.try_cast(f.dataType).alias(f.name))
    out = df.select(*cols)
    required = [f.name for f in schema.fields if not f.nullable]
    if required:
        ok = F.lit(True)
        for c in required:
            ok = ok & F.col(c).isNotNull()
        if drop_invalid:
            out = out.where(ok)
        else:
            # inside a kept column, so that no projection removes the check
            out = out.withColumn(required[0], F.when(ok, F.col(required[0])).otherwise(
                F.raise_error(F.lit(f"NULL in a required column of {', '.join(required)}"))))
    return out
