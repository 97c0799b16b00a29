"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs the library's builders over the whole driver tables (via
``Catalog``); its DuckDB twin lives in ``hearth.oracle_queries``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import (COUNTY_SUFFIXES_CRIME, COUNTY_SUFFIXES_CROSSWALK,
                               COUNTY_SUFFIXES_QUALITY, STATE_ABBREVIATIONS, aqi_label, clean_county,
                               short_metro, state_from_county_name, strip_state_suffix)
from ..functions.numeric import falsy_to, round_half_up
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import io, schemas
from . import dashboard, etl, explore
from .catalog import TOP_METROS_MAX_BUDGET, Catalog
from .recommend import top_metros_for_budget

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def punctuated_crime_raw(raw: DataFrame) -> DataFrame:
    """County names with a '.' inserted ('BU.ILDING County, AV'): the exact
    county join finds nothing, the alphanumeric fallback recovers them."""
    name = F.concat(F.substring("county_name", 1, 2), F.lit("."),
                    F.expr("substr(county_name, 3)"))
    return raw.withColumn("county_name", name)


# --------------------------------------------------------------- ETL / E1-E6

@query("crosswalk")
def q_crosswalk(spark, sf):
    return Catalog.of(spark, sf).crosswalk


@query("county_clean")
def q_county_clean(spark, sf):
    raw = Catalog.of(spark, sf).fx.fx_crime_raw
    return raw.select(
        "county_name",
        state_from_county_name("county_name").alias("state_abbr"),
        strip_state_suffix("county_name").alias("county_upper"),
        clean_county(strip_state_suffix("county_name"), COUNTY_SUFFIXES_CRIME).alias("county_crime"),
        clean_county(strip_state_suffix("county_name"), COUNTY_SUFFIXES_CROSSWALK).alias("county_crosswalk"),
        clean_county(strip_state_suffix("county_name"), COUNTY_SUFFIXES_QUALITY).alias("county_quality"))


@query("crime")
def q_crime(spark, sf):
    return Catalog.of(spark, sf).crime


@query("crime_fuzzy")
def q_crime_fuzzy(spark, sf):
    c = Catalog.of(spark, sf)
    return etl.build_crime(punctuated_crime_raw(c.fx.fx_crime_raw), c.crosswalk)


@query("air_quality")
def q_air_quality(spark, sf):
    return Catalog.of(spark, sf).air_quality


@query("amenities")
def q_amenities(spark, sf):
    return Catalog.of(spark, sf).amenities


@query("school_zip_stats")
def q_school_zip_stats(spark, sf):
    return etl.school_zip_stats(Catalog.of(spark, sf).fx.fx_schools_raw)[0]


@query("district_scores")
def q_district_scores(spark, sf):
    return etl.district_scores(Catalog.of(spark, sf).fx.fx_seda_raw)


@query("education")
def q_education(spark, sf):
    return Catalog.of(spark, sf).education


@query("census_join")
def q_census_join(spark, sf):
    return Catalog.of(spark, sf).census


@query("features")
def q_features(spark, sf):
    return Catalog.of(spark, sf).features


@query("match_report")
def q_match_report(spark, sf):
    c = Catalog.of(spark, sf)
    return etl.match_report(c.education, c.crosswalk)


# --------------------------------------------------------------- explorer

@query("search")
def q_search(spark, sf):
    return explore.search_neighborhoods(Catalog.of(spark, sf).features, min_income=50000,
                                        min_education=30, sort_by="value_score", limit=20)


@query("search_affordable")
def q_search_affordable(spark, sf):
    return explore.search_neighborhoods(Catalog.of(spark, sf).features, q="0", max_budget=900000,
                                        pop_class="urban", sort_by="price_to_income_ratio",
                                        limit=25)


@query("lookup")
def q_lookup(spark, sf):
    c = Catalog.of(spark, sf)
    return explore.get_neighborhoods(c.features, c.properties)


@query("price_history")
def q_price_history(spark, sf):
    c = Catalog.of(spark, sf)
    return explore.price_history(c.zip_market, c.fx.fx_features_base, months=24)


@query("top_metric")
def q_top_metric(spark, sf):
    return explore.top_neighborhoods(Catalog.of(spark, sf).features, "education_index", limit=10)


@query("metros")
def q_metros(spark, sf):
    return explore.metro_summary(Catalog.of(spark, sf).features, limit=20)


# --------------------------------------------------------------- dashboard

@query("kpis")
def q_kpis(spark, sf):
    return dashboard.kpis(Catalog.of(spark, sf).features)


@query("price_trends_month")
def q_price_trends_month(spark, sf):
    return dashboard.price_trends(Catalog.of(spark, sf).zip_market, months=24, interval="month")


@query("price_trends_quarter")
def q_price_trends_quarter(spark, sf):
    return dashboard.price_trends(Catalog.of(spark, sf).zip_market, months=84, interval="quarter")


@query("metro_compare")
def q_metro_compare(spark, sf):
    return dashboard.metro_comparison(Catalog.of(spark, sf).features, limit=15)


@query("distribution")
def q_distribution(spark, sf):
    return dashboard.value_distribution(Catalog.of(spark, sf).features)


@query("edu_vs_value")
def q_edu_vs_value(spark, sf):
    return dashboard.education_vs_value(Catalog.of(spark, sf).features, limit=100)


@query("affordability")
def q_affordability(spark, sf):
    return dashboard.affordability(Catalog.of(spark, sf).features, limit=20)


@query("top_metros")
def q_top_metros(spark, sf):
    return top_metros_for_budget(Catalog.of(spark, sf).features, TOP_METROS_MAX_BUDGET, limit=10)


# --------------------------------------------------------------- panel / E1, W5, Q17

from .features import zip_snapshot  # noqa: E402
from .training import build_training_data  # noqa: E402
from .catalog import TRAINING_START  # noqa: E402
from . import valuation  # noqa: E402
from ..operators.reshape import align_outer  # noqa: E402

ZIP_IDS = ("zip_code", "city", "state", "metro_area")


def pivot_wide(long: DataFrame, ids, value: str) -> DataFrame:
    """A long panel back to the raw 'one column per month' file layout
    (values as text, plus a non-date column the reader must drop)."""
    return (long.select(*ids, F.date_format("date", "yyyy-MM-dd").alias("_d"),
                        F.col(value).cast("string").alias("_v"))
                .groupBy(*ids).pivot("_d").agg(F.first("_v"))
                .withColumn("notes", F.lit("n/a")))


@query("melt_wide")
def q_melt_wide(spark, sf):
    from ..operators.reshape import melt_wide
    zm = Catalog.of(spark, sf).zip_market
    return melt_wide(pivot_wide(zm, ZIP_IDS, "zhvi_sfr"), ZIP_IDS, "zhvi_sfr")


@query("align_outer")
def q_align_outer(spark, sf):
    zm = Catalog.of(spark, sf).zip_market
    keys = [*ZIP_IDS, "date"]
    parts = [zm.select(*keys, v).where(F.col(v).isNotNull())
             for v in ("zhvi_sfr", "zhvi_sfrcondo", "zori_rent")]
    return align_outer(parts, keys)


@query("zip_market_build")
def q_zip_market_build(spark, sf):
    zm = Catalog.of(spark, sf).zip_market
    raw_ids = {"zip_code": "RegionName", "city": "City", "state": "State", "metro_area": "Metro"}
    raws = {}
    for v in ("zhvi_sfr", "zhvi_sfrcondo", "zori_rent"):
        wide = pivot_wide(zm.where(F.col(v).isNotNull()), ZIP_IDS, v)
        raws[v] = wide.withColumnsRenamed(raw_ids).withColumn(
            "RegionName", F.col("RegionName").cast("int").cast("string"))
    return etl.build_zip_market(raws)


@query("metro_market_build")
def q_metro_market_build(spark, sf):
    mm = Catalog.of(spark, sf).metro_market
    raws = {v: pivot_wide(mm, ("metro_area", "state"), v)
            .withColumnsRenamed({"metro_area": "RegionName", "state": "StateName"})
            for v in etl.METRO_VALUE_NAMES}
    return etl.build_metro_market(raws)


@query("snapshot")
def q_snapshot(spark, sf):
    return zip_snapshot(Catalog.of(spark, sf).zip_market)


@query("market_trends")
def q_market_trends(spark, sf):
    c = Catalog.of(spark, sf)
    return valuation.market_trends(c.zip_market, c.fx.fx_features_base, months=12)


@query("valuation_fallback")
def q_valuation_fallback(spark, sf):
    c = Catalog.of(spark, sf)
    return valuation.valuation_fallback(c.properties, c.features, c.zip_market)


@query("forecast")
def q_forecast(spark, sf):
    c = Catalog.of(spark, sf)
    vals = valuation.valuation_fallback(c.properties, c.features, c.zip_market)
    return valuation.forecast(vals, c.zip_market)


@query("training_data")
def q_training_data(spark, sf):
    c = Catalog.of(spark, sf)
    return build_training_data(c.zip_market, c.census, c.education, c.metro_market, c.features,
                               start=TRAINING_START)


# A bucket is one task's work in every pass over it: a panel of a million rows keeps a dozen cores busy.
PANEL_ROWS_PER_BUCKET = 65_536


@query("training_data_stored")
def q_training_data_stored(spark, sf):
    """The training set from tables in hash buckets of the zip: written, read back, joined and lagged bucket by bucket."""
    from .warehouse import training_table, write_by_zip
    c = Catalog.of(spark, sf)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/by-zip-{uuid.uuid4().hex}"
    buckets = io.bucket_count(c.zip_market.count(), PANEL_ROWS_PER_BUCKET)
    for name, df in (("zip_history", c.zip_market), ("census", c.census), ("education", c.education),
                     ("neighborhood_features", c.features)):
        write_by_zip(df, root, name, buckets)
    io.replace_table(c.metro_market, f"{root}/metro_market", schema=schemas.TABLES["metro_market"], sort_cols=["metro_area", "date"])
    return training_table(spark, root, start=TRAINING_START)


@query("comparables")
def q_comparables(spark, sf):
    return valuation.comparables(Catalog.of(spark, sf).features, k=5)


@query("recommend")
def q_recommend(spark, sf):
    from .recommend import recommend
    c = Catalog.of(spark, sf)
    return recommend(c.features, c.preferences, limit=10)


@query("recommend_filtered")
def q_recommend_filtered(spark, sf):
    from .recommend import recommend
    c = Catalog.of(spark, sf)
    return recommend(c.features, c.filtered_preferences, limit=10)


@query("recommend_unmatched")
def q_recommend_unmatched(spark, sf):
    from .recommend import without_candidates
    c = Catalog.of(spark, sf)
    return without_candidates(c.features, c.filtered_preferences)


@query("similar")
def q_similar(spark, sf):
    from .recommend import find_similar
    return find_similar(Catalog.of(spark, sf).features, k=5)


@query("similar_complete")
def q_similar_complete(spark, sf):
    """Similar zips among neighborhoods with all four descriptors known:
    every answer comes from the banded nearest-neighbour search."""
    from .recommend import find_similar
    f = Catalog.of(spark, sf).features.where(F.col("owner_occupied_pct").isNotNull())
    return find_similar(f, k=5)


# --------------------------------------------------------------- model (M1-M10, Q15)

@query("train_metrics")
def q_train_metrics(spark, sf):
    return Catalog.of(spark, sf).model[1]


@query("feature_importance")
def q_feature_importance(spark, sf):
    return Catalog.of(spark, sf).model[2]


@query("predict_ml")
def q_predict_ml(spark, sf):
    from .training import predict
    c = Catalog.of(spark, sf)
    model, metrics, _ = c.model
    return predict(c.properties, c.features, c.zip_market, model, metrics)


@query("training_stats")
def q_training_stats(spark, sf):
    from .training import feature_stats
    stats = feature_stats(Catalog.of(spark, sf).training_data)
    # engines interpolate and add up with other last bits
    rounded = [round_half_up(c, 4).alias(c) for c in ("mean", "stddev", "q1", "median", "q3")]
    return stats.select("feature", "count", "min", "max", *rounded)


@query("model_inputs")
def q_model_inputs(spark, sf):
    """The model's input rows: split, state code, and features with exact medians of the training rows."""
    from .training import FEATURE_COLS, STATE_FEATURE, prepare
    rows, model = prepare(Catalog.of(spark, sf).training_data)
    return model.inputs(rows).select(
        "zip_code", F.col("year").alias("panel_year"), F.col("month").alias("panel_month"), F.col("_split").alias("split"),
        STATE_FEATURE, *[round_half_up(f"_i_{c}", 6).alias(c) for c in FEATURE_COLS])


@query("serving_inputs")
def q_serving_inputs(spark, sf):
    """The features a valuation request is served with: the zip's values, growth and defaults."""
    from .training import FEATURE_COLS, requests, serving_inputs
    c = Catalog.of(spark, sf)
    df = requests(c.properties, c.features, c.zip_market)
    served = serving_inputs(df, explore.as_of_date(c.zip_market, None))
    return df.select("property_id", *[served[x].cast("double").alias(x) for x in FEATURE_COLS])


@query("predict_given_price")
def q_predict_given_price(spark, sf):
    """The model's whole response (adjustments, confidence, range) where the model's price is the neighborhood's value."""
    from .training import ValuationModel, predict
    from ..operators.boosting import Boosted

    class GivenPrice(ValuationModel):
        def score(self, df):
            return df.withColumn("prediction", falsy_to("zhvi_sfr", 300000.0))

    c = Catalog.of(spark, sf)
    mape = c.zip_market.select((F.countDistinct("zip_code") % 7).cast("double").alias("mape"))
    p = predict(c.properties, c.features, c.zip_market, GivenPrice([], {}, Boosted(0.0, [])), mape)
    return p.select("property_id", "zip_code", "estimated_value", "low_estimate", "high_estimate", "confidence",
                    "price_per_sqft")


@query("raw_files")
def q_raw_files(spark, sf):
    """A Latin-1 file without usable headers, written and read by position; `rows_written` is what the load counted."""
    raw = Catalog.of(spark, sf).fx.fx_amenity_raw
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    named = {**{c: F.col(c).cast("string") for c in raw.columns}, "fips_used": F.concat(F.lit("Cañón "), F.upper(F.trim("state")))}
    wide = raw.select(*[named.get(c, F.lit("0")).alias(f"c{i}") for i, c in enumerate(etl.AMENITY_COLUMNS)])
    io.write_table(wide, f"{root}/file", fmt="csv", encoding="ISO-8859-1")
    read = io.read_raw_csv(spark, f"{root}/file", encoding="ISO-8859-1")
    rows = io.replace_table(read, f"{root}/table")
    table = io.read_table(spark, f"{root}/table")
    note = F.get(F.array(*table.columns), F.lit(etl.AMENITY_COLUMNS.index("fips_used")))
    notes = table.select(F.min(note).alias("lo"), F.max(note).alias("hi"))
    return etl.amenities_by_county(table, positional=True).select(
        "*", *[notes.select(c).scalar().alias(f"note_{c}") for c in ("lo", "hi")], F.lit(rows).cast("long").alias("rows_written"))


@query("metro_zip_counts")
def q_metro_zip_counts(spark, sf):
    """Distinct zips per metro and quarter, from bitmaps kept per metro and month; the last month is added afterwards."""
    from ..operators.bitmaps import extend_numbers, group_bitmaps, merged_counts
    panel = Catalog.of(spark, sf).zip_market.where(F.col("metro_area").isNotNull())
    last = panel.select(F.max("date")).scalar()
    first, added = panel.where(F.col("date") < last), panel.where(F.col("date") == last)
    numbers = cut_lineage(extend_numbers(first, "zip_code"))
    kept = cut_lineage(group_bitmaps(first, ["metro_area", "date"], numbers, "zip_code"))
    more = group_bitmaps(added, ["metro_area", "date"], extend_numbers(added, "zip_code", numbers), "zip_code")
    return merged_counts(kept.unionByName(more), ["metro_area", F.trunc("date", "quarter").alias("quarter")], "zip_count")


@query("load_rejects")
def q_load_rejects(spark, sf):
    """A district file with lines of too many fields and scores that are no numbers: what the load accepts and rejects, and why."""
    from ..functions.numeric import to_int, to_num
    from ..sources.rejects import MALFORMED, load_checked, read_csv_lines
    raw = Catalog.of(spark, sf).fx.fx_seda_raw
    score = F.when(F.col("gys_mn_all").cast("int") % 11 == 0, F.lit("n/a")).otherwise(F.col("gys_mn_all"))
    fields = [F.concat(F.lit('"'), "sedaleaname", F.lit('"')), F.col("stateabb"), F.col("year"), score,
              F.when(F.length("sedaleaname") % 5 == 0, F.lit("left over"))]
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rejects-{uuid.uuid4().hex}"
    raw.select(F.concat_ws(",", *[f.cast("string") for f in fields])).write.text(f"{root}/file")
    lines = read_csv_lines(spark, f"{root}/file", ["sedaleaname", "stateabb", "year", "gys_mn_all"])
    accepted, rejected, counts = load_checked(lines, {
        "score is no number": to_num("gys_mn_all").isNull() & F.col("gys_mn_all").isNotNull(),
        "year is no year": to_int("year").isNull()}, root)
    return accepted.agg(F.count("*").alias("accepted"), F.sum(to_num("gys_mn_all")).alias("score_sum")).select(
        "*", rejected.select(F.count("*")).scalar().alias("rejected"),
        *[F.lit(counts[k]).cast("long").alias(n) for k, n in (("rows", "rows_read"), (MALFORMED, "malformed"),
                                                              ("score is no number", "bad_score"), ("year is no year", "bad_year"))])


@query("price_history_recent")
def q_price_history_recent(spark, sf):
    """The explorer's short history: each zip's last 6 months of the window."""
    c = Catalog.of(spark, sf)
    return explore.price_history(c.zip_market, c.fx.fx_features_base, months=24, last_n=6)


# --------------------------------------------------------------- filter variants

@query("search_quality")
def q_search_quality(spark, sf):
    return explore.search_neighborhoods(
        Catalog.of(spark, sf).features, value_tier="Fair market", min_population=1000,
        max_population=12000, min_safety=10, min_air_quality=20, sort_by="safety_index", limit=30)


@query("top_value_state")
def q_top_value_state(spark, sf):
    return explore.top_neighborhoods(Catalog.of(spark, sf).features, "value_score", state="av",
                                     limit=10)


@query("kpis_metro")
def q_kpis_metro(spark, sf):
    return dashboard.kpis(Catalog.of(spark, sf).features, metro_area="AsIa")


@query("distribution_state")
def q_distribution_state(spark, sf):
    return dashboard.value_distribution(Catalog.of(spark, sf).features, state="bw")


@query("price_trends_metro")
def q_price_trends_metro(spark, sf):
    return dashboard.price_trends(Catalog.of(spark, sf).zip_market, metro_area="europe",
                                  months=36, interval="month")


# --------------------------------------------------------------- second sources, rejects, files

def pair_scores_raw(raw: DataFrame) -> DataFrame:
    """A district file without an all-students mean: two mean columns instead."""
    score = F.col("gys_mn_all").cast("int")
    return raw.select("sedaleaname", "stateabb", "year", F.col("gys_mn_all").alias("gys_mn_ela"),
                      (F.length("sedaleaname") * 7 - score % 300).cast("string").alias("math_mean"))


@query("district_scores_pair")
def q_district_scores_pair(spark, sf):
    return etl.district_scores(pair_scores_raw(Catalog.of(spark, sf).fx.fx_seda_raw))


def named_states() -> dict[str, str]:
    """A full state name for each fixture abbreviation; the last one has no postal code."""
    codes = [a + b for a in "ABCDE" for b in "VWXYZ"]
    return dict(zip(codes, [*sorted(STATE_ABBREVIATIONS)[:24], "ATLANTIS"]))


@query("aqi_state_names")
def q_aqi_state_names(spark, sf):
    """The county table of an air-quality file with quoted headers and full state names."""
    raw = Catalog.of(spark, sf).fx.fx_aqi_raw
    names = F.create_map(*[F.lit(x) for pair in named_states().items() for x in pair])
    return etl.aqi_by_county(raw.select(
        F.initcap(names[F.col("state_abbr")]).alias('"State"'), F.col("county").alias('"County"'),
        F.col("median_aqi").alias('"Median AQI"'), F.col("good_days").alias('"Good Days"'),
        F.col("days_with_aqi").alias('"Days with AQI"')))


@query("census_two_headers")
def q_census_two_headers(spark, sf):
    """Census files that carry their label line as a row."""
    c = Catalog.of(spark, sf)

    def labelled(df):
        label = spark.range(1).select(F.lit("Geography").alias("GEO_ID"),
                                   *[F.lit("Estimate!!Total").alias(x) for x in df.columns if x != "GEO_ID"])
        return label.unionByName(df)

    return etl.build_census(labelled(c.income_raw), labelled(c.housing_raw))


@query("labels")
def q_labels(spark, sf):
    f = Catalog.of(spark, sf).features
    return f.select("zip_code", "median_aqi", aqi_label("median_aqi").alias("aqi_label"),
                    short_metro(F.concat("metro_area", F.lit(", "), "state")).alias("short_metro"))


@query("predict_fallback")
def q_predict_fallback(spark, sf):
    """Valuation requests while no model is available: the formula, with the whole response."""
    from .training import predict
    c = Catalog.of(spark, sf)
    p = predict(c.properties, c.features, c.zip_market)
    last = F.try_element_at("forecast", F.lit(-1))
    return p.select("property_id", "zip_code", "estimated_value", "low_estimate", "high_estimate", "confidence",
                    "price_per_sqft", "model_version", F.col("neighborhood_data.value_tier").alias("value_tier"),
                    F.col("neighborhood_data.zhvi_sfr").alias("zhvi_sfr"),
                    F.coalesce(F.size("forecast"), F.lit(0)).alias("forecast_rows"),
                    last["year"].alias("last_year"), last["projected_value"].alias("last_value"),
                    last["annual_rate_pct"].alias("annual_rate_pct"))


@query("unmatched_properties")
def q_unmatched_properties(spark, sf):
    """Requests for zips outside the mart of zips with known income."""
    c = Catalog.of(spark, sf)
    return valuation.unmatched(c.properties, c.features.where(F.col("median_income").isNotNull())) \
        .select("property_id", "zip_code")


@query("panel_table")
def q_panel_table(spark, sf):
    """The panel through its table: schema, month partitions, sorted files, read back by month."""
    c = Catalog.of(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/panel-{uuid.uuid4().hex}"
    schema = schemas.TABLES["zip_market"]
    panel = c.zip_market.withColumn("county", F.lit(None).cast("string"))
    io.write_table(panel, path, schema=schema, partition_by_month=True, sort_cols=["zip_code", "date"])
    table = io.read_table(spark, path)
    return table.where(explore.trailing_months(table, 24)) \
                .select("zip_code", "date", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent")
