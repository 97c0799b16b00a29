"""ETL builders on hand-made rows (defects and traps of SURVEY §1.5/§2.12)."""

from pyspark.sql import functions as F

from hearth.operators.county import join_county_metrics
from hearth.operators.reshape import align_outer, melt_wide
from hearth.plans import etl


def test_melt_drops_bad_dates_and_values(spark):
    wide = spark.createDataFrame(
        [("1", "a", "", "NaN", "1,000", "1d", " 12 "), ("2", "b", None, None, None, None, "7")],
        "RegionName string, City string, `2000-01-31` string, notadate string, "
        "`2000-02-29` string, `2000-03-31` string, `2000-04-30` string")
    # values per month column: '', '1,000', '1d', ' 12 ' -> only ' 12 ' survives
    long = melt_wide(wide, ["RegionName", "City"], "v").orderBy("RegionName").collect()
    assert [(r.RegionName, str(r.date), r.v) for r in long] == \
        [("1", "2000-04-30", 12.0), ("2", "2000-04-30", 7.0)]


def test_outer_alignment_groups_null_keys(spark):
    a = spark.createDataFrame([("United States", None, "2000-01-31", 1.0)],
                              "metro string, state string, d string, x double")
    b = spark.createDataFrame([("United States", None, "2000-01-31", 2.0)],
                              "metro string, state string, d string, y double")
    out = align_outer([a, b], ["metro", "state", "d"]).collect()
    assert len(out) == 1 and out[0].x == 1.0 and out[0].y == 2.0


def test_second_header_line_dropped(spark):
    raw = spark.createDataFrame([("Geography", "Estimate"), ("8600000US01001", "52000")],
                                "GEO_ID string, S1901_C01_012E string")
    out = etl.census_income(raw).collect()
    assert [(r.zip_code, r.median_income, r.income_margin) for r in out] == [("01001", 52000.0, None)]


def test_crime_rows(spark):
    raw = spark.createDataFrame([
        ("Travis County, TX", "1", "1", "1", "1", "10", "10", "10", "0"),        # population 0 -> 1
        ("Nowhere County", "1", "1", "1", "1", "1", "1", "1", "1000"),           # no state -> dropped
        ("Bexar County, TX", "1", "1", "1", "1", "1", "1", "n/a", None),          # population NULL
        ("Harris County, TX", "2", "0", "0", "0", "5", "5", "n/a", "100000"),      # n/a -> 0
    ], "county_name string, murder string, rape string, robbery string, agasslt string, "
       "burglry string, larceny string, mvtheft string, population string")
    out = {r.county_clean: r for r in etl.crime_by_county(raw).collect()}
    assert set(out) == {"TRAVIS", "HARRIS"}
    assert out["TRAVIS"].violent_crime_rate == 400000.0
    assert out["HARRIS"].property_crime_rate == 10.0
    assert all(0 <= r.safety_index <= 100 for r in out.values())


def test_fuzzy_county_fallback(spark):
    xw = spark.createDataFrame([("63101", "MO", "ST. LOUIS"), ("63102", "MO", "ST. LOUIS")],
                               "zip_code string, state string, county_clean string")
    county = spark.createDataFrame([("ST LOUIS", "MO", 42.0)],
                                   "county_clean string, state_abbr string, safety_index double")
    exact_only = join_county_metrics(xw, county, ["safety_index"])
    assert exact_only.count() == 0
    fuzzy = join_county_metrics(xw, county, ["safety_index"], match="fuzzy")
    assert sorted(r.zip_code for r in fuzzy.collect()) == ["63101", "63102"]
    # other rows, however many match exactly, change nothing; an exact match comes first
    many = xw.unionByName(spark.range(1500).selectExpr(
        "cast(70000 + id as string) as zip_code", "'TX' as state", "'TRAVIS' as county_clean"))
    more = county.unionByName(spark.createDataFrame(
        [("TRAVIS", "TX", 7.0), ("ST. LOUIS", "IL", 1.0)], county.schema))
    got = {r.zip_code: r.safety_index for r in
           join_county_metrics(many, more, ["safety_index"], match="fuzzy").collect()}
    assert len(got) == 1502 and got["63101"] == got["63102"] == 42.0
    both = county.unionByName(spark.createDataFrame([("ST. LOUIS", "MO", 9.0)], county.schema))
    assert {r.safety_index for r in join_county_metrics(xw, both, ["safety_index"], match="fuzzy").collect()} == {9.0}


def test_district_scores_empty_schema(spark):
    raw = spark.createDataFrame([("x", 1)], "foo string, year int")
    out = etl.district_scores(raw)
    assert out.count() == 0 and out.columns == ["district_name", "state", "academic_score"]


def test_school_counts_and_flags(spark):
    raw = spark.createDataFrame([
        (1, "1001", "1", "Yes", "a", "ma", "Elementary"),
        (2, "1001", "2", "No", "a", "ma", "High"),
        (3, "1001", "6", "No", "a", "ma", "High"),        # inactive
        (4, "10010-1234", "3", None, "b", "ma", None),
    ], "school_id int, lzip string, sy_status string, charter_text string, lea_name string, "
       "lstate string, level string")
    by_zip, districts = etl.school_zip_stats(raw)
    r = {x.zip_code: x for x in by_zip.collect()}
    assert r["01001"].total_schools == 2 and r["01001"].charter_schools == 1
    assert r["01001"].charter_pct == 50.0 and r["10010"].high_schools == 0
    assert districts.count() == 2


def test_aqi_from_raw_headers_and_state_names(spark):
    raw = spark.createDataFrame([
        ("Texas", "Travis", "40", "300", "365"),
        ("Texas", "Baltimore City", "80", "100", "0"),      # 0 days -> denominator 1
        ("Atlantis", "Nowhere", "50", "10", "20"),          # unknown state -> dropped
    ], '`"State"` string, `"County"` string, `"Median AQI"` string, `"Good Days"` string, '
       '`"Days with AQI"` string')
    out = {r.county_clean: r for r in etl.aqi_by_county(raw).collect()}
    assert set(out) == {"TRAVIS", "BALTIMORE"}               # quality preset strips CITY
    assert out["TRAVIS"].state_abbr == "TX" and out["TRAVIS"].good_day_pct == 82.2
    assert out["BALTIMORE"].good_day_pct == 10000.0
    assert all(0 <= r.air_quality_index <= 100 for r in out.values())


def test_amenities_positional(spark):
    cols = [f"c{i}" for i in range(22)]
    row = ["01001", "01001", "al", " Autauga County ", *["0"] * 14, "1.5", "0", "3", "4"]
    raw = spark.createDataFrame([tuple(row)], ", ".join(f"{c} string" for c in cols))
    out = etl.amenities_by_county(raw, positional=True).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.county_clean, r.state, r.amenity_rank, r.topography_z) == ("AUTAUGA", "AL", 4.0, 1.5)
    assert r.natural_amenity_score == 50.0
