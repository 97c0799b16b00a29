"""Training set (E7) and the valuation model (M1-M10): boosted trees over Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import falsy_to, round_half_even
from ..operators.boosting import Boosted, Params, Tree, fit
from ..operators.selection import exact_percentiles
from ..session import cut_lineage
from .explore import as_of_date
from .valuation import (FALLBACK_ADJ, FALLBACK_CONFIDENCE, FALLBACK_RANGE, ML_ADJ, adjusted_value,
                        fallback_base, forecast_fields, growth_rate, recent_trend_stats)

# Feature order of the model input vector.
FEATURE_COLS = (
    "year", "month", "median_income", "owner_occupied_pct", "total_units", "median_rooms",
    "education_index", "academic_score", "total_schools", "metro_median_price",
    "metro_days_pending", "metro_heat_index", "metro_inventory", "metro_pct_above_list",
    "price_yoy_pct", "price_3mo_pct", "zori_rent", "zhvi_sfrcondo", "safety_index",
    "air_quality_index", "natural_amenity_score",
)
STATE_FEATURE = "state_encoded"


def pct_change(cur, prev) -> F.Column:
    """SAFE_DIVIDE(cur - prev, prev) * 100."""
    return F.try_divide(cur - prev, prev) * 100.0


def build_training_data(zip_market: DataFrame, census: DataFrame, education: DataFrame,
                        metro_market: DataFrame, features: DataFrame,
                        start: str = "2018-01-01") -> DataFrame:
    """Star join of the panel with census, education, metro month and zip
    quality scores, plus 12- and 3-row LAG growth features.

    The WHERE filters run before the window (as in the SQL it mirrors), so
    lags count filtered rows. The window is per zip: its size is bounded by
    the number of months, not by the data volume. All zip joins and the LAGs
    come first, on one partitioning by zip; the metro join (one row per metro
    and month, so it adds no rows) follows. The dimension tables are broadcast
    by AQE when small.
    """
    z = zip_market.where(F.col("zhvi_sfr").isNotNull() & (F.col("date") >= F.lit(start).cast("date")))
    c = census.select("zip_code", "median_income", "owner_occupied_pct", "total_units",
                      "median_rooms")
    e = education.select("zip_code", "education_index", "academic_score", "total_schools")
    m = metro_market.select(
        "metro_area", "date", F.col("median_sale_price").alias("metro_median_price"),
        F.col("days_to_pending").alias("metro_days_pending"),
        F.col("market_heat_index").alias("metro_heat_index"),
        F.col("for_sale_inventory").alias("metro_inventory"),
        F.col("pct_sold_above_list").alias("metro_pct_above_list"))
    nf = features.select("zip_code", "safety_index", "air_quality_index", "natural_amenity_score")
    df = (z.join(c, "zip_code", "left").join(e, "zip_code", "left")
           .join(nf, "zip_code", "left").where(F.col("median_income").isNotNull()))
    w = Window.partitionBy("zip_code").orderBy("date")
    lag12 = F.lag("zhvi_sfr", 12).over(w)
    lag3 = F.lag("zhvi_sfr", 3).over(w)
    df = df.withColumns({"price_yoy_pct": pct_change(F.col("zhvi_sfr"), lag12),
                         "price_3mo_pct": pct_change(F.col("zhvi_sfr"), lag3)})
    return df.join(m, ["metro_area", "date"], "left").select(
        F.col("zhvi_sfr").alias("home_value"), "zip_code", "state", "metro_area",
        F.year("date").alias("year"), F.month("date").alias("month"),
        F.col("zhvi_sfr").alias("current_zhvi"), "zhvi_sfrcondo", "zori_rent",
        "price_yoy_pct", "price_3mo_pct",
        "median_income", "owner_occupied_pct", "total_units", "median_rooms",
        "education_index", "academic_score", "total_schools",
        "metro_median_price", "metro_days_pending", "metro_heat_index", "metro_inventory",
        "metro_pct_above_list", "safety_index", "air_quality_index", "natural_amenity_score")


# ---------------------------------------------------------------------------
# Model (M1-M10)
# ---------------------------------------------------------------------------
# Hyper-parameters of the source model, and serving defaults
# for missing neighborhood values (None: always the constant).
MODEL_PARAMS = {"rounds": 500, "depth": 8, "rate": 0.05, "rows": 0.8, "features": 0.8,
                "min_rows": 5, "l1": 0.1, "l2": 1.0, "patience": 20, "seed": 42}
TEST_PERCENT = 15
VALIDATION_PERCENT = 15
SERVING_DEFAULTS = (
    ("median_income", "median_income", 65000.0), ("owner_occupied_pct", "owner_occupied_pct", 60.0),
    ("total_units", None, 5000.0), ("median_rooms", None, 6.0),
    ("education_index", "education_index", 50.0), ("academic_score", "academic_score", 50.0),
    ("total_schools", "total_schools", 5.0), ("metro_median_price", "median_sale_price", 350000.0),
    ("metro_days_pending", "days_to_pending", 20.0), ("metro_heat_index", "market_heat_index", 50.0),
    ("metro_inventory", None, 1000.0), ("metro_pct_above_list", None, 0.3),
    ("zori_rent", "zori_rent", 1500.0), ("zhvi_sfrcondo", "zhvi_sfrcondo", 300000.0),
    ("safety_index", "safety_index", 50.0), ("air_quality_index", "air_quality_index", 65.0),
    ("natural_amenity_score", "natural_amenity_score", 50.0),
)
MODEL_VERSION = "boosted-v2"


def split_column(how: str = "row", training: DataFrame | None = None) -> F.Column:
    """Deterministic split, independent of partitioning: 'row' hashes
    (zip, year, month) like a random row split; 'zip' keeps all months of
    a zip on one side (no leakage between months of one zip); 'time' puts
    the latest months in test and the months before them in validation
    (cut points are exact percentiles of the month index over ``training``)."""
    if how == "time":
        idx = F.col("year") * 12 + F.col("month")
        shares = [1 - TEST_PERCENT / 100, 1 - (TEST_PERCENT + VALIDATION_PERCENT) / 100]
        cuts = exact_percentiles(training.select(idx.alias("i")), {"i": shares})
        test, validation = (F.lit(cuts["i", p]) for p in shares)
        return F.when(idx > test, "test").when(idx > validation, "validation").otherwise("train")
    # 32 bits of an md5, which any engine can recompute
    key = F.concat_ws("|", "zip_code") if how == "zip" else F.concat_ws("|", "zip_code", "year", "month")
    b = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100
    return (F.when(b < TEST_PERCENT, "test")
             .when(b < TEST_PERCENT + VALIDATION_PERCENT, "validation").otherwise("train"))


@dataclass
class ValuationModel:
    """State codes, medians of missing features, and the trees."""
    labels: list[str]
    medians: dict[str, float | None]
    trees: Boosted

    def state_code(self) -> F.Column:
        """The state's place among the known ones; a state not seen in training gets 0, as the source does."""
        known = F.array(*map(F.lit, self.labels)).cast("array<string>")
        return F.greatest(F.array_position(known, F.coalesce(F.col("state"), F.lit("UNKNOWN"))) - 1, F.lit(0)).cast("double")

    def inputs(self, df: DataFrame) -> DataFrame:
        """Adds `_i_<feature>` (missing values are medians, of a feature without any 0) and the state's code."""
        filled = {f"_i_{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]).cast("double"), F.lit(0.0))
                  for c in FEATURE_COLS}
        return df.withColumns({**filled, STATE_FEATURE: self.state_code()})

    @staticmethod
    def vector() -> F.Column:
        return F.array(*[F.col(f"_i_{c}") for c in FEATURE_COLS], F.col(STATE_FEATURE))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `prediction` from the inputs; trees run over Arrow batches."""
        trees = self.trees

        @F.pandas_udf("double")
        def price(x: pd.Series) -> pd.Series:
            return pd.Series(trees.predict(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return df.withColumn("prediction", price(self.vector()))


def prepare(training: DataFrame, split: str = "row") -> tuple[DataFrame, ValuationModel]:
    """Training rows with `_split`, and a model without trees: states of rows outside the test slice, medians of training rows."""
    rows = cut_lineage(training.withColumn("_split", split_column(split, training)))
    states = rows.where("_split <> 'test'").select(F.coalesce("state", F.lit("UNKNOWN")).alias("s")).distinct()
    labels = sorted(r["s"] for r in states.collect())               # one per state
    found = exact_percentiles(rows.where("_split = 'train'"), {c: [0.5] for c in FEATURE_COLS})
    return rows, ValuationModel(labels, {c: found[c, 0.5] for c in FEATURE_COLS}, Boosted(0.0, []))


def fit_valuation_model(training: DataFrame, split: str = "row", **overrides):
    """Fit state codes, exact medians and boosted trees (``operators.boosting``) with the source's parameters.

    Medians come from training rows only; patience watches a separate validation
    slice (the test slice only scores). Returns (ValuationModel, metrics DataFrame,
    feature-importance DataFrame).
    """
    rows, model = prepare(training, split)
    x = model.inputs(rows)
    fit_rows = x.where("_split <> 'test'").select(
        F.xxhash64("zip_code", "year", "month").alias("row"), (F.col("_split") == "validation").alias("held"),
        "home_value", model.vector().alias("features"))
    model.trees = fit(fit_rows, "features", "home_value", "held", "row", Params(**dict(MODEL_PARAMS, **overrides)))
    test = model.score(x.where("_split = 'test'"))
    metrics = test.agg(
        F.avg(F.abs(F.col("home_value") - F.col("prediction"))).alias("mae"),
        (F.avg(F.abs((F.col("home_value") - F.col("prediction")) / F.col("home_value"))) * 100)
        .alias("mape"),
        F.count(F.lit(1)).alias("n_test"),
        F.lit(len(model.trees.trees)).alias("n_trees"))
    names = list(FEATURE_COLS) + [STATE_FEATURE]
    imp = training.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(names, model.trees.importance())],
        "feature string, importance double")
    importance = imp.orderBy(F.col("importance").desc(), "feature").limit(10)
    return model, metrics, importance


def feature_stats(training: DataFrame) -> DataFrame:
    """A17: one row per feature: count, mean, stddev, min, exact quartiles, max."""
    cols = [F.col(c).cast("double").alias(c) for c in FEATURE_COLS]
    rows = cut_lineage(training.select(*cols))
    at = exact_percentiles(rows, {c: [0.25, 0.5, 0.75] for c in FEATURE_COLS})
    stats = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"),
                      F.min(c).alias("min"), *[F.lit(at[c, p]).cast("double").alias(n) for p, n in
                                               ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))],
                      F.max(c).alias("max")) for c in FEATURE_COLS]
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def save_model(model: ValuationModel, metrics: DataFrame, path: str) -> None:
    """Tables trees (one row per node), parts (states, medians, cuts, base) and metrics under ``path``."""
    spark = metrics.sparkSession
    nodes = [(t, int(i), int(tree.feature[i]), int(tree.cut[i]), float(tree.value[i]), float(tree.gain[i]))
             for t, tree in enumerate(model.trees.trees) for i in range(len(tree.feature))]
    spark.createDataFrame(nodes, "tree int, node int, feature int, cut int, value double, gain double") \
        .write.mode("overwrite").parquet(f"{path}/trees")
    parts = [(model.labels, [(k, v) for k, v in model.medians.items()], [c.tolist() for c in model.trees.cuts],
              model.trees.base, model.trees.errors)]
    spark.createDataFrame(parts, "labels array<string>, medians array<struct<k:string,v:double>>, cuts array<array<double>>, "
                                 "base double, errors array<double>").write.mode("overwrite").parquet(f"{path}/parts")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(spark, path: str):
    """(model, metrics) as saved."""
    p = spark.read.parquet(f"{path}/parts").first()
    nodes = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").toPandas()       # rounds x 2^(depth + 1) rows
    trees = [Tree(t.feature.to_numpy(np.int16), t.cut.to_numpy(np.int16), t.value.to_numpy(), t.gain.to_numpy())
             for _, t in nodes.groupby("tree", sort=True)]
    boosted = Boosted(p["base"], [np.array(c, np.float64) for c in p["cuts"]], trees, list(p["errors"]))
    return ValuationModel(list(p["labels"]), {m["k"]: m["v"] for m in p["medians"]}, boosted), \
        spark.read.parquet(f"{path}/metrics")


def serving_inputs(df: DataFrame, as_of: F.Column) -> dict[str, F.Column]:
    """The model's features for a request joined with its neighborhood and trend: values, defaults and growth."""
    n = F.coalesce(F.col("n_months"), F.lit(0))
    cur = falsy_to("zhvi_last", 0.0)
    ago12 = falsy_to("zhvi_12th_last", cur)
    ago3 = falsy_to("zhvi_3rd_last", cur)
    yoy = F.when((n >= 12) & (ago12 != 0), (cur - ago12) / ago12 * 100).otherwise(0.0)
    mo3 = F.when((n >= 12) & (ago3 != 0), (cur - ago3) / ago3 * 100).otherwise(0.0)
    served = {"year": F.year(as_of).cast("double"), "month": F.month(as_of).cast("double"),
              "price_yoy_pct": yoy, "price_3mo_pct": mo3}
    for name, source, default in SERVING_DEFAULTS:
        served[name] = F.lit(default) if source is None else falsy_to(F.col(source).cast("double"), default)
    return served


def neighborhoods(features: DataFrame, panel: DataFrame, as_of=None) -> DataFrame:
    """The mart's zips with their values and recent trend."""
    nb = features.select("zip_code", "city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo",
                         "zori_rent", "median_sale_price", "days_to_pending", "market_heat_index",
                         "median_income", "owner_occupied_pct", "education_index",
                         "academic_score", "total_schools", "safety_index", "air_quality_index",
                         "natural_amenity_score", "value_score", "value_tier",
                         "total_population", "pop_density_class")
    return nb.join(recent_trend_stats(panel, as_of=as_of), "zip_code", "left")


def requests(properties: DataFrame, features: DataFrame, panel: DataFrame, as_of=None) -> DataFrame:
    """Properties whose zip is in the mart, with its values and its recent trend."""
    return properties.join(neighborhoods(features, panel, as_of), "zip_code", "inner")


def predict(properties: DataFrame, features: DataFrame, panel: DataFrame, model=None,
            metrics: DataFrame | None = None, as_of=None) -> DataFrame:
    """Q15 (batch): valuation of every property whose zip is in the mart,
    with the property adjustments, confidence, range and forecast list. The
    fitted model gives the base price; without a model the formula does
    (``model_version`` says which). ``valuation.unmatched`` lists the rest."""
    as_of_c = as_of_date(panel, as_of)
    n = F.coalesce(F.col("n_months"), F.lit(0))
    if model is None:
        df = requests(properties, features, panel, as_of)
        x = df.withColumn("_est", adjusted_value(fallback_base(), FALLBACK_ADJ, F.year(as_of_c))) \
              .withColumn("_conf", F.lit(FALLBACK_CONFIDENCE))
        low, high = (F.col("_est") * f for f in FALLBACK_RANGE)
        version = "fallback"
    else:
        # the model's inputs are the neighborhood's alone: a zip is scored once, whatever the number of its properties
        near = neighborhoods(features, panel, as_of)
        served = serving_inputs(near, as_of_c)
        scored = model.score(near.select("*", *[served[c].alias(f"_i_{c}") for c in FEATURE_COLS],
                                         model.state_code().alias(STATE_FEATURE)))
        x = properties.join(scored, "zip_code", "inner")
        mape = metrics.select(F.first("mape")).scalar()
        conf = F.least(F.lit(92.0), F.greatest(F.lit(70.0), 100 - mape * 3))
        conf = conf - F.when(falsy_to("median_income", 0.0) == 0, 5).otherwise(0) \
            - F.when(falsy_to("education_index", 0.0) == 0, 3).otherwise(0) \
            - F.when(n == 0, 4).otherwise(0)
        x = x.withColumn("_conf", conf) \
             .withColumn("_est", adjusted_value(F.col("prediction"), ML_ADJ, F.year(as_of_c)))
        margin = (100 - F.col("_conf")) / 100
        low, high = F.col("_est") * (1 - margin * 1.2), F.col("_est") * (1 + margin * 1.2)
        version = MODEL_VERSION
    nd = F.struct(*[F.col(c) for c in ("zhvi_sfr", "median_income", "education_index",
                                       "owner_occupied_pct", "safety_index", "air_quality_index",
                                       "natural_amenity_score", "value_tier", "value_score",
                                       "pop_density_class", "total_population")])
    out = x.select(
        "property_id", "zip_code", "city", "state", "metro_area",
        round_half_even("_est", -2).alias("estimated_value"),
        round_half_even(low, -2).alias("low_estimate"),
        round_half_even(high, -2).alias("high_estimate"),
        round_half_even("_conf", 1).alias("confidence"),
        round_half_even(F.try_divide(F.col("_est"), F.col("sqft")), 2).alias("price_per_sqft"),
        F.lit(version).alias("model_version"), nd.alias("neighborhood_data"),
        "forecast_years", n.alias("_n"), "zhvi_last", "zhvi_12th_last",
        F.year(as_of_c).alias("_year"))
    # the response's forecast list (NULL when no years were requested), built in
    # the row; the year is a column because lambdas can't hold scalar subqueries
    base, wanted = F.col("estimated_value"), F.col("forecast_years")
    out = out.withColumn("_rate", growth_rate(F.col("_n"), F.col("zhvi_last"),
                                              F.col("zhvi_12th_last"), base))
    years = F.transform(F.sequence(F.lit(1), F.greatest(wanted, F.lit(1))), lambda yr: F.struct(
        *forecast_fields(base, F.col("_rate"), yr, F.col("_year"))))
    return out.withColumn("forecast", F.when(wanted >= 1, years)) \
              .drop("_n", "zhvi_last", "zhvi_12th_last", "_year", "_rate")
