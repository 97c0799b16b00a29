"""Recommendations by block bounds: equal to scoring every pair, admissible bounds, and few pairs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearth.plans import recommend as R


def _features(spark, n, seed):
    r = lambda k: F.abs(F.xxhash64(F.lit(seed), F.lit(k), "id")) % 10_000 / 10_000.0
    maybe = lambda k, v: F.when(r(k) > 0.06, v)
    return spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("zip_code"), maybe(1, F.lit("City")).alias("city"),
        F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("state"),
        maybe(2, F.concat(F.lit("Metro "), (F.col("id") % 40).cast("string"))).alias("metro_area"),
        maybe(3, F.round(100_000 + 900_000 * r(4) * r(5), -3)).alias("zhvi_sfr"),
        maybe(6, r(7) * 500_000).alias("zhvi_sfrcondo"), maybe(8, r(9) * 4000).alias("zori_rent"),
        maybe(10, F.round(30_000 + 150_000 * r(11), -2)).alias("median_income"), maybe(12, r(13) * 100).alias("owner_occupied_pct"),
        maybe(14, F.round(100 * r(15), 1)).alias("education_index"), maybe(16, F.round(100 * r(17), 1)).alias("academic_score"),
        F.lit(3).alias("total_schools"), F.current_date().alias("last_updated"))


def _prefs(spark, n, seed):
    rng = random.Random(seed)
    names = [*R.PRIORITY_WEIGHTS, "bogus"]
    rows = [(i, rng.choice([150e3, 300e3, 450e3, 700e3, 2e6, 50e3, 0.0, None]), rng.choice([None, 0.0, 100e3, 400e3]),
             rng.choices(names, k=rng.randint(0, 4)), rng.choice([None] * 4 + ["s1"]), rng.choice([None] * 4 + ["METRO 1"]),
             rng.choice([None] * 3 + [0.0, 80.0]), rng.choice([None] * 3 + [0.0, 120e3])) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, max_budget double, min_budget double, priorities array<string>, "
                                       "state string, metro_area string, min_education double, min_income double")


def _all_pairs(features, asked):
    asked = asked.select("*", (F.col("max_budget") * R.BUDGET_OVER).alias("_cap"),
                         F.when(F.coalesce("min_budget", F.lit(0.0)) != 0, F.col("min_budget") * R.BUDGET_UNDER).alias("_floor"))
    cand = features.where("zhvi_sfr is not null and city is not null").select(*R.RESULT_COLS)
    return asked.join(cand, R._qualify()).withColumn("match_score", R.match_score())


def test_top_k_equals_scoring_every_pair(spark):
    f, asked = _features(spark, 3000, 1), R.profiles(_prefs(spark, 80, 2))
    best = Window.partitionBy("_profile").orderBy(F.desc("match_score"), F.desc("zhvi_sfr"), "zip_code")
    want = _all_pairs(f, asked).withColumn("rank", F.row_number().over(best)).where("rank <= 7")
    cols = ["_profile", "rank", "zip_code", "match_score"]
    got = R._ranked(f, asked, 7).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(*cols).collect())) and len(got) > 200


def test_bounds_are_never_below_a_score(spark):
    f, asked = _features(spark, 1500, 3), R.profiles(_prefs(spark, 60, 4))
    zips, strata = R.zip_index(f)
    blocks = strata.select("_s", F.explode("blocks").alias("x")).select("_s", "x._b", "x")
    pairs = _all_pairs(f, asked).select("_profile", *R.PROFILE, "zip_code", "match_score") \
        .join(zips.select("_s", "_b", "zip_code"), "zip_code").join(blocks, ["_s", "_b"])
    low = pairs.where(R.score_bound(F.col("x")) + R.ROUNDING < F.col("match_score"))
    assert pairs.count() > 10_000 and low.count() == 0


def test_few_pairs_are_scored(spark):
    f, asked = _features(spark, 20_000, 5), R.profiles(_prefs(spark, 150, 6))
    pairs = R.scored_pairs(f, asked, 10)
    assert pairs.count() < 0.1 * _all_pairs(f, asked).count()
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_empty_tables(spark):
    f, p = _features(spark, 50, 1), _prefs(spark, 5, 1)
    assert R.recommend(f.where("false"), p).count() == 0 and R.recommend(f, p.where("false")).count() == 0
    assert R.without_candidates(f.where("false"), p).count() == 5
