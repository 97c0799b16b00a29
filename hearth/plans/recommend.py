"""Recommendation queries (Q12-Q14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean_round_half_up, round_half_even
from ..operators.kdtree import LEAF, near_cells, split_cells, within_reach
from ..session import cut_lineage


def top_metros_for_budget(features: DataFrame, max_budget: float, min_budget: float | None = None,
                          limit: int = 10) -> DataFrame:
    """Q14: metros with at least 3 zips priced inside the budget band,
    ranked by average education then income."""
    lo = min_budget or max_budget * 0.5
    return (features.where(F.col("zhvi_sfr").between(lo, max_budget)
                           & F.col("metro_area").isNotNull())
            .groupBy("metro_area", "state")
            .agg(F.countDistinct("zip_code").alias("zip_count"),
                 mean_round_half_up("zhvi_sfr", None, 0).alias("avg_home_value"),
                 mean_round_half_up("median_income", None, 0).alias("avg_income"),
                 mean_round_half_up("education_index", 1, 1).alias("avg_education"),
                 mean_round_half_up("owner_occupied_pct", 1, 1).alias("avg_ownership"),
                 mean_round_half_up("zori_rent", None, 0).alias("avg_rent"))
            .where(F.col("zip_count") >= 3)
            .orderBy(F.col("avg_education").desc_nulls_last(), F.col("avg_income").desc_nulls_last(),
                     "metro_area", "state")
            .limit(limit))


# ---------------------------------------------------------------------------
# Fixed values of the match score: priority -> (metric, weight) in source
# order, and the scale each metric is divided by (others: 100).
# ---------------------------------------------------------------------------
PRIORITY_WEIGHTS = {
    "schools": (("education_index", 0.5), ("academic_score", 0.3), ("zhvi_sfr", 0.2)),
    "safety": (("education_index", 0.2), ("median_income", 0.3), ("zhvi_sfr", 0.5)),
    "walkable": (("zhvi_sfr", 0.3), ("median_income", 0.3), ("education_index", 0.4)),
    "transit": (("zhvi_sfr", 0.4), ("median_income", 0.3), ("education_index", 0.3)),
    "parks": (("education_index", 0.3), ("median_income", 0.3), ("zhvi_sfr", 0.4)),
    "nightlife": (("zhvi_sfr", 0.5), ("median_income", 0.3), ("education_index", 0.2)),
    "quiet": (("education_index", 0.3), ("median_income", 0.4), ("zhvi_sfr", 0.3)),
    "appreciate": (("zhvi_sfr", 0.6), ("median_income", 0.2), ("education_index", 0.2)),
    "affordable": (("zhvi_sfr", 0.1), ("median_income", 0.5), ("education_index", 0.4)),
    "family": (("education_index", 0.5), ("median_income", 0.3), ("zhvi_sfr", 0.2)),
}
METRIC_MAX = {"zhvi_sfr": 2000000.0, "zhvi_sfrcondo": 1500000.0, "zori_rent": 5000.0,
              "median_income": 200000.0, "education_index": 100.0, "academic_score": 100.0,
              "owner_occupied_pct": 100.0}
BUDGET_OVER = 1.2            # candidates up to 20 % over the maximum
BUDGET_UNDER = 0.8           # and down to 80 % of the minimum
REASONS = ("Strong education index of ", "Median income of $", "Within your budget",
           "Slightly above budget but strong match",
           "Matches your location and lifestyle preferences")
# ---------------------------------------------------------------------------

RESULT_COLS = ("zip_code", "city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo",
               "zori_rent", "median_income", "owner_occupied_pct", "education_index",
               "academic_score", "total_schools", "last_updated")


def _metric_term(metric: str, weight: float):
    v = F.col(metric)
    return F.when(v.isNotNull(), F.least(F.lit(1.0), v / METRIC_MAX.get(metric, 100.0)) * weight) \
            .otherwise(F.lit(0.0))


def priority_sum(priorities) -> F.Column:
    """Sum over the user's priorities (duplicates and unknown names
    included) of min(1, metric / scale) * weight, added left to right in
    the source's order; an unknown priority adds nothing."""
    def terms(p):
        out = None
        for name, mw in PRIORITY_WEIGHTS.items():
            arr = F.array(*[_metric_term(m, w) for m, w in mw])
            out = F.when(p == name, arr) if out is None else out.when(p == name, arr)
        return out.otherwise(F.array().cast("array<double>"))
    flat = F.flatten(F.transform(priorities, terms))
    return F.aggregate(flat, F.lit(0.0), lambda acc, x: acc + x)


def match_score() -> F.Column:
    """N18 over a (user, candidate) row: budget fit 40, priorities 40,
    education 10, income 10, clipped to 0-100, one decimal."""
    hv = F.coalesce(F.col("zhvi_sfr"), F.lit(0.0))
    mx = F.col("max_budget")
    mn = F.coalesce(F.nullif(F.col("min_budget"), F.lit(0.0)), mx * 0.5)
    budget = (F.when((hv <= mx) & (hv >= mn),
                     F.greatest(F.lit(0.0), 1.0 - F.try_divide(F.abs(hv - mx * 0.85), mx * 0.5)) * 40)
               .when(hv < mn, F.lit(15.0))
               .otherwise(0.0 - F.try_divide(hv - mx, mx) * 30))
    n = F.size("priorities")
    s = F.when(n > 0, budget + priority_sum(F.col("priorities")) / n * 40).otherwise(budget)
    s = s + F.coalesce(F.nullif(F.col("education_index"), F.lit(0.0)), F.lit(0.0)) / 100 * 10
    inc = F.coalesce(F.nullif(F.col("median_income"), F.lit(0.0)), F.lit(0.0))
    s = F.when(inc > 50000, s + F.least(F.lit(10.0), (inc - 50000) / 20000)).otherwise(s)
    return round_half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), s)), 1)


def reason() -> F.Column:
    """N19: the first reason that applies."""
    edu, inc, hv, mx = (F.col("education_index"), F.col("median_income"), F.col("zhvi_sfr"),
                        F.col("max_budget"))
    truthy = lambda c: c.isNotNull() & (c != 0)
    return (F.when(truthy(edu) & (edu >= 60), F.concat(F.lit(REASONS[0]), edu.cast("string")))
             .when(truthy(inc) & (inc >= 80000), F.concat(F.lit(REASONS[1]), F.format_number(inc, 0)))
             .when(truthy(hv) & (hv <= mx), F.lit(REASONS[2]))
             .when(truthy(hv) & (hv <= mx * 1.1), F.lit(REASONS[3]))
             .otherwise(F.lit(REASONS[4])))


def _opt(prefs: DataFrame, name: str, dtype: str) -> F.Column:
    return F.col(name) if name in prefs.columns else F.lit(None).cast(dtype)


PROFILE = ("max_budget", "min_budget", "priorities", "u_state", "u_metro", "u_min_edu", "u_min_income")
# The index of zips: at most STRATA price strata of STRATUM zips or more, cut into blocks of
# BLOCK zips by quality; a profile's first look is at SEED_BLOCKS of each of SEED_STRATA strata.
STRATA, STRATUM, BLOCK = 256, 128, 16
SEED_STRATA, SEED_BLOCKS = 2, 2
ROUNDING = 0.0501          # half a step of the rounded score, and float noise


def recommend(features: DataFrame, prefs: DataFrame, limit: int = 10) -> DataFrame:
    """Q12 for every user at once: the ``limit`` best of all qualifying zips.

    A result depends on the preferences only, so each distinct set of
    preferences (a profile) is scored once and its users take the result.
    A profile's candidates are the zips priced at most 1.2 x max_budget and
    at least 0.8 x min_budget that pass its optional filters. Only zips that can
    be among its ``limit`` best are scored (``scored_pairs``); the top-k window keeps
    ``limit`` rows per profile before the shuffle. A profile without
    candidates gives no rows (see ``without_candidates``).
    """
    best = _ranked(features, profiles(prefs), limit)
    users = _keyed(prefs).select("user_id", "_profile")
    return users.join(best, "_profile").select("user_id", "rank", *RESULT_COLS, "match_score", "reason")


def without_candidates(features: DataFrame, prefs: DataFrame) -> DataFrame:
    """user_id of the requests that the source answers with 404: no zip qualifies."""
    users = _keyed(prefs).select("user_id", "_profile")
    found = _ranked(features, profiles(prefs), 1).select("_profile").distinct()
    return users.join(found, "_profile", "left_anti").select("user_id")


def _keyed(prefs: DataFrame) -> DataFrame:
    """Preferences under their full column set, with the text of all of them as key."""
    users = prefs.select(
        "user_id", "max_budget", "min_budget", "priorities",
        _opt(prefs, "state", "string").alias("u_state"),
        _opt(prefs, "metro_area", "string").alias("u_metro"),
        _opt(prefs, "min_education", "double").alias("u_min_edu"),
        _opt(prefs, "min_income", "double").alias("u_min_income"))
    return users.withColumn("_profile", F.to_json(F.struct(*PROFILE)))


def profiles(prefs: DataFrame) -> DataFrame:
    """One row per distinct set of preferences."""
    return _keyed(prefs).groupBy("_profile").agg(*[F.first(c).alias(c) for c in PROFILE])


def _qualify() -> F.Column:
    """Whether a zip passes a profile's price range and optional filters."""
    return ((F.col("zhvi_sfr") <= F.col("_cap"))
            & (F.col("_floor").isNull() | (F.col("zhvi_sfr") >= F.col("_floor")))
            & (F.col("u_state").isNull() | (F.upper("state") == F.upper("u_state")))
            & (F.col("u_metro").isNull()
               | F.lower("metro_area").contains(F.lower(F.coalesce("u_metro", F.lit("")))))
            & (F.col("u_min_edu").isNull() | (F.col("u_min_edu") == 0)
               | (F.col("education_index") >= F.col("u_min_edu")))
            & (F.col("u_min_income").isNull() | (F.col("u_min_income") == 0)
               | (F.col("median_income") >= F.col("u_min_income"))))


def zip_index(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The zips by price stratum and block (_s, _b), and one row per stratum with the extremes of it and its blocks.

    Strata are runs of the order by price, so prices within one are close; a
    stratum's zips are cut into blocks by quality (education and income). Extremes: the
    price range, the largest sum of each priority's terms, education and income, and, for a
    block, its states and metros.
    """
    from ..operators.positions import with_positions
    cand = features.where(F.col("zhvi_sfr").isNotNull() & F.col("city").isNotNull()).select(*RESULT_COLS)
    width = max(STRATUM, -(-cand.count() // STRATA))
    placed = with_positions(cand, [F.col("zhvi_sfr").desc(), F.col("zip_code").asc()]) \
        .withColumn("_s", F.floor(F.col("_pos") / width))
    quality = F.coalesce(F.col("education_index"), F.lit(0.0)) / METRIC_MAX["education_index"] \
        + F.coalesce(F.col("median_income"), F.lit(0.0)) / METRIC_MAX["median_income"]
    inside = Window.partitionBy("_s").orderBy(quality.desc(), "zip_code")
    placed = cut_lineage(placed.withColumn("_b", F.floor((F.row_number().over(inside) - 1) / BLOCK)).drop("_pos"))
    terms = [sum((_metric_term(m, w) for m, w in mw[1:]), _metric_term(*mw[0])) for mw in PRIORITY_WEIGHTS.values()]
    blocks = placed.groupBy("_s", "_b").agg(
        F.min("zhvi_sfr").alias("lo"), F.max("zhvi_sfr").alias("hi"), F.array(*[F.max(t) for t in terms]).alias("terms"),
        F.max("education_index").alias("edu"), F.max("median_income").alias("inc"),
        F.collect_set(F.upper("state")).alias("states"), F.collect_set(F.lower("metro_area")).alias("metros"))
    strata = blocks.groupBy("_s").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array(*[F.max(F.col("terms")[i]) for i in range(len(terms))]).alias("terms"),
        F.max("edu").alias("edu"), F.max("inc").alias("inc"),
        F.collect_list(F.struct("_b", "lo", "hi", "terms", "edu", "inc", "states", "metros")).alias("blocks"))
    return placed, cut_lineage(strata)


def score_bound(x) -> F.Column:
    """At least the score of every zip among those whose extremes are ``x``; not rounded."""
    mx = F.col("max_budget")
    mn = F.coalesce(F.nullif(F.col("min_budget"), F.lit(0.0)), mx * 0.5)
    best = mx * 0.85
    nearest = F.greatest(F.greatest(x["lo"], mn), F.least(F.least(x["hi"], mx), best))
    within = F.when((x["hi"] >= mn) & (x["lo"] <= mx) & (mn <= mx),
                    F.greatest(F.lit(0.0), 1.0 - F.abs(nearest - best) / (mx * 0.5)) * 40)
    below = F.when(x["lo"] < mn, F.lit(15.0))
    above = F.when(x["hi"] > mx, 0.0 - (F.greatest(x["lo"], mx) - mx) / mx * 30)
    budget = F.greatest(within, below, above, F.lit(-1000.0))

    def most(p):
        out = None
        for i, name in enumerate(PRIORITY_WEIGHTS):
            out = F.when(p == name, x["terms"][i]) if out is None else out.when(p == name, x["terms"][i])
        return out.otherwise(F.lit(0.0))

    n = F.size("priorities")
    wishes = F.aggregate(F.transform("priorities", most), F.lit(0.0), lambda a, b: a + b) / n * 40
    s = F.when(n > 0, budget + wishes).otherwise(budget) \
        + F.greatest(F.coalesce(x["edu"], F.lit(0.0)), F.lit(0.0)) / 100 * 10 \
        + F.greatest(F.lit(0.0), F.least(F.lit(10.0), (F.coalesce(x["inc"], F.lit(0.0)) - 50000) / 20000))
    return F.when(mx > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), s))).otherwise(F.lit(100.0))


def _may_qualify(x, names: bool) -> F.Column:
    wanted = lambda value, least: least.isNull() | (least == 0) | (value >= least)
    ok = ((x["lo"] <= F.col("_cap")) & (F.col("_floor").isNull() | (x["hi"] >= F.col("_floor")))
          & wanted(x["edu"], F.col("u_min_edu")) & wanted(x["inc"], F.col("u_min_income")))
    if names:
        metro = F.lower(F.coalesce("u_metro", F.lit("")))
        ok = ok & (F.col("u_state").isNull() | F.array_contains(x["states"], F.upper("u_state"))) \
            & (F.col("u_metro").isNull() | F.exists(x["metros"], lambda m: m.contains(metro)))
    return F.coalesce(ok, F.lit(False))


def _blocks_of(looks: DataFrame, strata: DataFrame, pick) -> DataFrame:
    """Profiles with the blocks (_s, _b) of their strata that ``pick`` keeps of the qualifying (bound, _b), best first."""
    x = F.filter("blocks", lambda b: _may_qualify(b, True))
    bounds = F.sort_array(F.transform(x, lambda b: F.struct(score_bound(b).alias("bound"), b["_b"].alias("_b"))), asc=False)
    return looks.join(strata.select("_s", "blocks"), "_s").withColumn("_bounds", bounds) \
        .drop("blocks").withColumn("_b", F.explode(pick(F.col("_bounds")))).withColumn("_b", F.col("_b._b")).drop("_bounds")


def scored_pairs(features: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(profile, zip) pairs with match_score, among them each profile's ``limit`` best.

    Block-max search: a profile bounds its score in each price stratum by the
    stratum's extremes, looks into the best few blocks of its best strata, and takes its k-th
    score there as the threshold; then it meets the blocks whose bound reaches
    the threshold, ties included, and no other. The list of strata (at most STRATA) is handed to
    every profile; blocks and zips come by joins on their numbers.
    """
    zips, strata = zip_index(features)
    asked = asked.select(
        "*", (F.col("max_budget") * BUDGET_OVER).alias("_cap"),
        F.when(F.coalesce(F.col("min_budget"), F.lit(0.0)) != 0,
               F.col("min_budget") * BUDGET_UNDER).alias("_floor"))
    listed = strata.select(F.collect_list(F.struct("_s", "lo", "hi", "terms", "edu", "inc"))).scalar()
    near = F.filter("_all", lambda x: _may_qualify(x, False))
    looks = asked.withColumn("_all", listed).withColumn("_near", F.sort_array(
        F.transform(near, lambda x: F.struct(score_bound(x).alias("bound"), x["_s"].alias("_s"))), asc=False)).drop("_all")
    looks = cut_lineage(looks.where(F.size("_near") > 0))

    first = looks.select("*", F.explode(F.slice("_near", 1, SEED_STRATA)).alias("_n")).drop("_near") \
        .withColumn("_s", F.col("_n._s")).drop("_n")
    seeds = _blocks_of(first, strata, lambda b: F.slice(b, 1, SEED_BLOCKS)).join(zips, ["_s", "_b"]).where(_qualify()) \
        .select("_profile", match_score().alias("score"))
    # at most SEED_STRATA * SEED_BLOCKS * BLOCK scores a profile
    kth = seeds.groupBy("_profile").agg(
        F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(limit)).alias("kth"))
    rest = looks.join(kth, "_profile", "left").withColumn("_least", F.coalesce("kth", F.lit(-1.0)) - ROUNDING).drop("kth")
    rest = rest.withColumn("_n", F.explode(F.filter("_near", lambda x: x["bound"] >= F.col("_least")))).drop("_near") \
        .withColumn("_s", F.col("_n._s")).drop("_n")
    met = _blocks_of(rest, strata, lambda b: F.filter(b, lambda x: x["bound"] >= F.col("_least")))
    return met.join(zips, ["_s", "_b"]).where(_qualify()).withColumn("match_score", match_score())


def _ranked(features: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    scored = scored_pairs(features, asked, limit).withColumn("reason", reason())
    best = Window.partitionBy("_profile").orderBy(F.col("match_score").desc(),
                                                  F.col("zhvi_sfr").desc(), F.col("zip_code").asc())
    return (scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
                  .select("_profile", "rank", *RESULT_COLS, "match_score", "reason"))


# Reference values used when the target's own value is missing or 0.
SIMILAR_DEFAULTS = (("zhvi_sfr", 400000.0), ("median_income", 65000.0),
                    ("education_index", 50.0), ("owner_occupied_pct", 60.0))
SIMILAR_COLS = ("zip_code", "city", "state", "metro_area", "zhvi_sfr", "median_income",
                "education_index", "owner_occupied_pct")
TINY = 1e-9           # values at or below this are one value to the splits


def _distance() -> F.Column:
    """Relative Euclidean distance to the target's reference values
    (NULL when the candidate lacks any of the four values)."""
    total = None
    for metric, _ in SIMILAR_DEFAULTS:
        ref = F.col(f"r_{metric}")
        term = F.pow((F.col(metric) - ref) / ref, 2)
        total = term if total is None else total + term
    return F.sqrt(total)


def find_similar(features: DataFrame, k: int = 5, state: str | None = None,
                 targets: DataFrame | None = None, leaf: int | None = None) -> DataFrame:
    """Q13 for many target zips at once: the k most similar other zips.

    Order is distance ascending with NULL distances first (the warehouse's
    ASC default) and zip code as tie-break. NULL distances come from
    candidates without an owner share; they are the same for every target,
    so the k+1 smallest such zips are one bounded array handed to every
    target by a scalar subquery.

    Targets still short of k take an exact nearest-neighbour search instead of all
    pairs (``operators.kdtree``): candidates are cut into cells of at most ``leaf`` zips
    by their values on a log scale, and a target goes down the cells, leaving those
    whose box is farther away than its k-th neighbour can be. Crowded values are cut finer
    and a far target skips empty space. Exact copies of one value vector are first cut to their k+1
    smallest zips, which cannot change any answer.
    """
    from .explore import state_is
    cand = features.where(F.col("zhvi_sfr").isNotNull() & F.col("median_income").isNotNull()
                          & F.col("education_index").isNotNull())
    if state:
        cand = cand.where(state_is(state))
    cand = cand.select(*SIMILAR_COLS)
    tg = features if targets is None else features.join(targets.select("zip_code"), "zip_code",
                                                        "left_semi")
    dims = [m for m, _ in SIMILAR_DEFAULTS]
    tg = tg.select(F.col("zip_code").alias("target_zip"),
                   *[F.coalesce(F.nullif(F.col(m), F.lit(0.0)), F.lit(d)).alias(f"r_{m}")
                     for m, d in SIMILAR_DEFAULTS])

    # ranked items are (distance, zip) only; attributes are joined back for
    # the final k rows per target, so bands and shuffles carry numbers
    item = lambda d: F.struct(d.alias("d"), F.col("zip_code"))
    heads = cand.where(F.col("owner_occupied_pct").isNull()).orderBy("zip_code").limit(k + 1)
    null_arr = heads.select(F.sort_array(F.collect_list(item(F.lit(None).cast("double"))))).scalar()
    # (projected first: a subquery may not sit inside a higher-order function)
    tg = tg.withColumn("_head", null_arr)
    tg = tg.withColumn("_nulls", F.slice(F.filter("_head", lambda x: x["zip_code"] != F.col("target_zip")),
                                         1, k)).drop("_head")
    tg = tg.withColumn("_need", F.lit(k) - F.size("_nulls"))

    scored = cand.where(F.col("owner_occupied_pct").isNotNull()).select("zip_code", *dims)
    need = cut_lineage(tg.where(F.col("_need") > 0))
    if need.isEmpty():          # the NULL-distance head already answers everyone
        return _similar_output(tg, None, cand)
    # exact copies beyond the k+1 smallest zips of one value vector can never be
    # chosen (at most one of them is the target itself)
    copies = Window.partitionBy(*dims).orderBy("zip_code")
    pts = scored.withColumn("_g", F.row_number().over(copies)).where(F.col("_g") <= k + 1).drop("_g")
    coords = [f"_u{i}" for i in range(len(dims))]
    logs = [F.log(F.greatest(F.col(m), F.lit(TINY))).alias(u) for m, u in zip(dims, coords)]
    pts, rounds = split_cells(pts.select("zip_code", *dims, *logs), coords, leaf or LEAF)
    # a target whose zip comes in several rows meets itself as often: so many more points must be within its reach
    again = pts.groupBy(F.col("zip_code").alias("target_zip")).agg((F.count("*") - 1).cast("int").alias("_again")).where("_again > 0")
    todo = need.select("target_zip", "_need", *[f"r_{m}" for m in dims]).join(again, "target_zip", "left") \
        .withColumn("_ask", F.col("_need") + F.coalesce("_again", F.lit(0))).drop("_again")
    cells = near_cells(todo, pts, rounds, dims, "target_zip", "_ask")
    pairs = cells.join(pts.select("zip_code", *dims, F.col(f"_c{rounds}").alias("_n")), "_n") \
        .where(F.col("zip_code") != F.col("target_zip")) \
        .where(F.col("_reach").isNull() | within_reach(F.pow(_distance(), 2)))
    near = (pairs.select("target_zip", "_need", "zip_code", item(_distance()).alias("_it"))
            .withColumn("_rk", F.row_number().over(
                Window.partitionBy("target_zip").orderBy(F.col("_it.d"), F.col("zip_code"))))
            .where(F.col("_rk") <= k)
            .groupBy("target_zip", "_need").agg(F.sort_array(F.collect_list("_it")).alias("_all"))
            .select("target_zip", F.slice("_all", 1, F.col("_need")).alias("_best")))
    return _similar_output(tg, near, cand)


def _similar_output(tg: DataFrame, near: DataFrame | None, cand: DataFrame) -> DataFrame:
    """NULL-distance picks first, then the nearest; one row per pick, with
    the candidate's attributes joined back (one row per zip)."""
    if near is None:
        res = tg.select("target_zip", F.col("_nulls").alias("_res"))
    else:
        res = (tg.join(near, "target_zip", "left")
                 .select("target_zip", F.concat(F.col("_nulls"),
                                                F.coalesce(F.col("_best"), F.array())).alias("_res")))
    out = res.select("target_zip", F.posexplode("_res").alias("_i", "_r"))
    score = round_half_even(F.greatest(F.lit(0.0),
                                       100 - F.coalesce(F.nullif(F.col("_r.d"), F.lit(0.0)),
                                                        F.lit(1.0)) * 50), 1)
    picks = out.select("target_zip", (F.col("_i") + 1).alias("rank"),
                       F.col("_r.zip_code").alias("zip_code"), score.alias("similarity_score"))
    return picks.join(cand.select(*SIMILAR_COLS), "zip_code") \
                .select("target_zip", "rank", *SIMILAR_COLS, "similarity_score")
