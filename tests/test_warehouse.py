"""Raw CSV files -> written warehouse tables (S1-S9, A18, E1-E6 end to end)."""

import tempfile

import pytest

from pyspark.sql import functions as F

from hearth.plans import etl
from hearth.plans.registry import pivot_wide
from hearth.plans.warehouse import build_warehouse
from hearth.sources.io import read_raw_csv, read_table, replace_table
from hearth.sources.schemas import NEIGHBORHOOD_FEATURES, enforce_schema


def _csv(df, root, name):
    path = f"{root}/{name}"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def test_build_warehouse_from_raw_files(spark, catalog):
    fx = catalog.fx
    root = tempfile.mkdtemp(prefix="hearth-raw-")
    out = tempfile.mkdtemp(prefix="hearth-wh-")
    raw = {}
    zip_ids = {"zip_code": "RegionName", "city": "City", "state": "State", "metro_area": "Metro"}
    for v in etl.ZIP_VALUE_NAMES:
        wide = pivot_wide(fx.fx_zip_market.where(F.col(v).isNotNull()),
                          ("zip_code", "city", "state", "metro_area"), v)
        raw[f"zip_{v}"] = _csv(wide.withColumnsRenamed(zip_ids), root, f"zip_{v}")
    for v in etl.METRO_VALUE_NAMES:
        wide = pivot_wide(fx.fx_metro_market, ("metro_area", "state"), v)
        raw[f"metro_{v}"] = _csv(wide.withColumnsRenamed(
            {"metro_area": "RegionName", "state": "StateName"}), root, f"metro_{v}")
    header_row = catalog.spark.createDataFrame([("Geography", "Estimate")], "GEO_ID string, S1901_C01_012E string")
    raw["census_income"] = _csv(header_row.unionByName(catalog.income_raw), root, "inc")
    raw["census_housing"] = _csv(catalog.housing_raw, root, "hou")
    raw["schools"] = _csv(fx.fx_schools_raw, root, "schools")
    raw["district_scores"] = _csv(fx.fx_seda_raw, root, "seda")
    raw["crime"] = _csv(fx.fx_crime_raw, root, "crime")
    raw["aqi"] = _csv(fx.fx_aqi_raw, root, "aqi")
    raw["amenities"] = _csv(fx.fx_amenity_raw, root, "amen")
    listing = _csv(catalog.crosswalk_raw, root, "listing")

    counts = build_warehouse(spark, raw, out, zip_listing=listing, amenities_positional=False, rejects_dir=f"{out}/rejects")
    assert counts["crime: rows"] == fx.fx_crime_raw.count() and counts["crime: malformed line"] == 0

    def same(table, df):
        got = sorted(map(tuple, read_table(spark, f"{out}/{table}").select(*df.columns).collect()))
        assert got == sorted(map(tuple, df.collect())), table

    same("crime", catalog.crime)
    same("air_quality", catalog.air_quality)
    same("natural_amenities", catalog.amenities)
    same("education", catalog.education)
    same("census", catalog.census)
    same("crosswalk", catalog.crosswalk)
    same("zip_market", fx.fx_zip_market)
    assert counts["zip_market"] == fx.fx_zip_market.count()
    feats = read_table(spark, f"{out}/neighborhood_features")
    assert feats.columns == [f.name for f in NEIGHBORHOOD_FEATURES.fields]
    assert counts["neighborhood_features"] == feats.count() == fx.fx_zip_market.select("zip_code").distinct().count()
    # the panel is month-partitioned on disk
    assert "month" in read_table(spark, f"{out}/zip_market").columns


def test_enforce_schema_and_raw_reader(spark):
    df = spark.createDataFrame([("01001", "x"), (None, "y")], "zip_code string, junk string")
    with pytest.raises(Exception, match="required column"):
        enforce_schema(df, NEIGHBORHOOD_FEATURES).select("zip_code").collect()
    out = enforce_schema(df, NEIGHBORHOOD_FEATURES, drop_invalid=True)
    assert out.columns == [f.name for f in NEIGHBORHOOD_FEATURES.fields]
    assert out.count() == 0          # last_updated is required and missing
    path = tempfile.mkdtemp(prefix="hearth-csv-") + "/f.csv"
    with open(path, "w", encoding="latin-1") as fh:
        fh.write("LZIP,LEA_NAME\n01001,Montréal\n")
    got = read_raw_csv(spark, path, encoding="ISO-8859-1", columns=["LZIP"]).collect()
    assert got[0].LZIP == "01001"    # text: leading zero kept
    full = read_raw_csv(spark, path, encoding="ISO-8859-1").collect()
    assert full[0].LEA_NAME == "Montréal"


def test_trailing_windows_prune_month_partitions(spark, catalog):
    from hearth.plans import dashboard, explore
    from hearth.sources.io import write_table
    path = tempfile.mkdtemp(prefix="hearth-zm-") + "/zm"
    write_table(catalog.fx.fx_zip_market, path, partition_by_month=True)
    zm = spark.read.parquet(path)
    part = dashboard.price_trends(zm, months=12)
    flat = dashboard.price_trends(catalog.fx.fx_zip_market, months=12)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, flat.collect()))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    hist = explore.price_history(zm, catalog.fx.fx_features_base, months=24, last_n=6)
    flat_hist = explore.price_history(catalog.fx.fx_zip_market, catalog.fx.fx_features_base,
                                      months=24, last_n=6)
    assert sorted(map(tuple, hist.collect())) == sorted(map(tuple, flat_hist.collect()))


def test_a_failed_load_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(100).selectExpr("id", "id * 2 as x")
    assert replace_table(old, path) == 100

    def same_as_old():
        return sorted(map(tuple, read_table(spark, path).collect())) == [(i, 2 * i) for i in range(100)]

    broken = spark.range(0, 1000, numPartitions=4).select("id", F.when(F.col("id") < 990, F.col("id")).otherwise(
        F.raise_error(F.lit("lost midway")).cast("long")).alias("x"))
    with pytest.raises(Exception, match="lost midway"):
        replace_table(broken, path)
    assert same_as_old()
    with pytest.raises(ValueError, match="stays as it was"):
        replace_table(spark.range(5).selectExpr("id", "id as x"), path, expect_rows=6)
    assert same_as_old()
    reader = read_table(spark, path)                       # planned before the switch
    assert replace_table(spark.range(7).selectExpr("id", "id as x"), path) == 7
    assert read_table(spark, path).count() == 7 and reader.count() == 100
    assert read_table(spark, path, version=1).count() == 100
    with pytest.raises(ValueError, match="no version"):
        read_table(spark, path, version=9)


def test_months_have_few_files_with_narrow_keys(spark, tmp_path):
    from hearth.sources.io import write_table
    path = str(tmp_path / "panel")
    rows = spark.range(0, 60_000, numPartitions=200).select(
        F.lpad((F.col("id") * 7919 % 5000).cast("string"), 5, "0").alias("zip_code"),
        F.add_months(F.lit("2020-01-01").cast("date"), (F.col("id") % 12).cast("int")).alias("date"), F.rand(3).alias("zhvi_sfr"))
    write_table(rows, path, partition_by_month=True, sort_cols=["zip_code", "date"])
    files = spark.read.parquet(path).groupBy("month", F.input_file_name().alias("f")) \
        .agg(F.min("zip_code").alias("lo"), F.max("zip_code").alias("hi"), F.count("*").alias("n"))
    per_month = {r["month"]: r["count"] for r in files.groupBy("month").count().collect()}
    assert len(per_month) == 12 and max(per_month.values()) <= 3 and files.count() <= 12 + 16
    seen: dict = {}
    for r in files.orderBy("month", "lo").collect():
        assert r["month"] not in seen or seen[r["month"]] <= r["lo"]       # ranges of one month do not overlap
        seen[r["month"]] = r["hi"]
    one = files.first()["f"]
    inside = [r.zip_code for r in spark.read.parquet(one).collect()]
    assert inside == sorted(inside)                        # T1: sorted inside the file
