"""End-to-end warehouse build from raw files (the production entry point).

Reads the raw market, census, school, crime, AQI and amenity files, runs
the builders of ``plans.etl``, writes every table as parquet under
``out_dir`` with its fixed schema (the zip panel partitioned by month),
then builds the feature mart from the *written* tables. Writing and
re-reading cuts the lineage, so a lost executor late in the run re-reads
stored tables instead of recomputing the ETL. Each table is replaced as a
whole (``replace_table``): a run that fails leaves the tables it has not reached as
they were. Row counts come from ``DataFrame.observe`` on the write itself.

The panel is kept twice, for its two ways of reading: ``zip_market`` by month for trailing
windows, ``zip_history`` in hash buckets of the zip, sorted by date, for what runs per zip.
The zip tables have the same buckets, so the training set (``training_table``) joins them and takes its
LAGs without an exchange. A bucket can't get hot: a zip has one row a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import to_num
from ..sources import schemas
from ..sources.io import bucket_count, drop_repeated_header, read_raw_csv, read_table, replace_table
from ..sources.rejects import load_checked, read_checked_csv
from . import etl
from .features import build_neighborhood_features, metro_snapshot, zip_snapshot
from .training import build_training_data

# Keys of the ``raw`` path mapping.
RAW_KEYS = (
    *(f"zip_{v}" for v in etl.ZIP_VALUE_NAMES), *(f"metro_{v}" for v in etl.METRO_VALUE_NAMES),
    "census_income", "census_housing", "schools", "district_scores", "crime", "aqi",
    "amenities",
)
# Tables dealt by zip, and the order inside their buckets.
BY_ZIP = {"zip_history": ["zip_code", "date"], "census": ["zip_code"], "education": ["zip_code"],
          "neighborhood_features": ["zip_code"]}
CROSSWALK_COLUMNS = ("RegionName", "State", "City", "Metro", "CountyName")


def raw_rules(key: str, columns: list[str], amenities_positional: bool = True) -> dict[str, Column]:
    """Reason -> condition for raw rows that their builder can't use: it would drop them without a word.

    A value that is there but is no number counts; an empty one does not, nor does a repeated header.
    """
    needed = {"census_income": "S1901_C01_012E", "census_housing": "DP04_0001E", "crime": "POPULATION", "aqi": "Median AQI",
              "amenities": "amenity_rank"}.get(key)
    if key == "amenities" and amenities_positional:
        at = etl.AMENITY_COLUMNS.index("amenity_rank")
        name = columns[at] if at < len(columns) else None
    else:
        name = next((c for c in columns if needed and c.strip().strip('"').lower() == needed.lower()), None)
    if name is None:
        return {}
    value = F.col("`" + name.replace("`", "``") + "`")
    rule = (F.trim(value) != "") & to_num(value).isNull()
    if key.startswith("census") and "GEO_ID" in columns:
        rule = rule & (F.col("GEO_ID") != "Geography")
    return {f"{needed} is no number": rule}


def write_by_zip(df: DataFrame, out_dir: str, name: str, buckets: int) -> int:
    """Load one of the tables that are dealt by zip; returns the rows written."""
    return replace_table(df, f"{out_dir}/{name}", schema=schemas.TABLES.get(name), bucket_by="zip_code", buckets=buckets,
                         sort_cols=BY_ZIP[name])


def training_table(spark: SparkSession, out_dir: str, start: str = "2018-01-01") -> DataFrame:
    """The training set from written tables; joins by zip and LAGs follow the tables' buckets."""
    table = lambda name: read_table(spark, f"{out_dir}/{name}")
    return build_training_data(table("zip_history"), table("census"), table("education"), table("metro_market"),
                               table("neighborhood_features"), start=start)


def _write(df: DataFrame, out_dir: str, name: str, counts: dict, **kw) -> DataFrame:
    counts[name] = replace_table(df, f"{out_dir}/{name}", schema=schemas.TABLES.get(name), **kw)
    return read_table(df.sparkSession, f"{out_dir}/{name}")


def build_warehouse(spark: SparkSession, raw: dict[str, str], out_dir: str,
                    zip_listing: str | None = None, schools_encoding: str = "ISO-8859-1",
                    aqi_state_is_abbreviation: bool = False,
                    amenities_positional: bool = True, rows_per_bucket: int = 1_000_000,
                    rejects_dir: str | None = None) -> dict[str, int]:
    """Build and write all tables; returns rows written per table.

    ``rejects_dir``: raw files are staged there once, split into rows to load and rows that are malformed (more or fewer
    fields than the header) or break ``raw_rules``, with reasons and file. Counts then also hold `<raw key>: <reason>`.
    """
    counts: dict[str, int] = {}

    def read(key: str, **kw) -> DataFrame:
        if rejects_dir is None:
            return read_raw_csv(spark, raw[key], **kw)
        lines = read_checked_csv(spark, raw[key], **kw)
        rules = raw_rules(key, lines.columns, amenities_positional)
        accepted, _, seen = load_checked(lines, rules, f"{rejects_dir}/{key}")
        counts.update({f"{key}: {reason}": n for reason, n in seen.items()})
        return accepted


    zip_market = _write(etl.build_zip_market({v: read(f"zip_{v}") for v in etl.ZIP_VALUE_NAMES}),
                        out_dir, "zip_market", counts, partition_by_month=True,
                        sort_cols=["zip_code", "date"])
    buckets = bucket_count(counts["zip_market"], rows_per_bucket)

    def by_zip(df: DataFrame, name: str) -> DataFrame:
        counts[name] = write_by_zip(df, out_dir, name, buckets)
        return read_table(spark, f"{out_dir}/{name}")

    by_zip(zip_market, "zip_history")
    metro_market = _write(
        etl.build_metro_market({v: read(f"metro_{v}") for v in etl.METRO_VALUE_NAMES}),
        out_dir, "metro_market", counts, sort_cols=["metro_area", "date"])
    listing = read_raw_csv(spark, zip_listing or raw["zip_zhvi_sfr"], columns=CROSSWALK_COLUMNS)
    crosswalk = _write(etl.build_crosswalk(listing), out_dir, "crosswalk", counts)
    census = by_zip(etl.build_census(
        drop_repeated_header(read("census_income"), "GEO_ID", "Geography"),
        drop_repeated_header(read("census_housing"), "GEO_ID", "Geography")), "census")
    education = by_zip(etl.build_education(read("schools", encoding=schools_encoding),
                                           read("district_scores")), "education")
    crime = _write(etl.build_crime(read("crime"), crosswalk), out_dir, "crime", counts)
    air = _write(etl.build_air_quality(read("aqi"), crosswalk,
                                       state_is_abbreviation=aqi_state_is_abbreviation),
                 out_dir, "air_quality", counts)
    amen = _write(etl.build_amenities(read("amenities"), crosswalk,
                                      positional=amenities_positional),
                  out_dir, "natural_amenities", counts)
    features = build_neighborhood_features(zip_snapshot(zip_market), census, education, crime,
                                           air, amen, metro_snapshot(metro_market))
    by_zip(features, "neighborhood_features")
    return counts
