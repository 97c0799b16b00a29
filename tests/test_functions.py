"""Unit tests of the column expressions against the traps of SURVEY §2.12."""

from pyspark.sql import functions as F

from hearth.functions import clean, indices as ix, numeric as nm


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_to_num_is_strict(spark):
    got = col_values(spark, ["", "NaN", "1,000", "1d", " 12 ", "-3.5e2", None, "n/a"], nm.to_num)
    assert got == [None, None, None, None, 12.0, -350.0, None, None]


def test_zip_forms(spark):
    got = col_values(spark, ["860Z200US01001", "1001", "01001", "123456"], clean.extract_zip)
    assert got == ["01001", "01001", "01001", "23456"]       # no 'US': last five characters
    assert col_values(spark, ["1001", "01001", "123456"], clean.zfill5) == ["01001", "01001", "123456"]


def test_county_presets(spark):
    names = ["Sitka City and Borough", "James City County", "Baltimore City", "Travis County",
             "X District County", None]
    xw = col_values(spark, names, lambda c: clean.clean_county(c, clean.COUNTY_SUFFIXES_CROSSWALK))
    q = col_values(spark, names, lambda c: clean.clean_county(c, clean.COUNTY_SUFFIXES_QUALITY))
    assert xw == ["SITKA CITY AND", "JAMES CITY", "BALTIMORE CITY", "TRAVIS", "X", None]
    assert q == ["SITKA CITY AND", "JAMES", "BALTIMORE", "TRAVIS", "X", None]
    fixed = col_values(spark, names[:1], lambda c: clean.clean_county(
        c, clean.COUNTY_SUFFIXES_CROSSWALK, longest_first=True))
    assert fixed == ["SITKA"]


def test_state_parts(spark):
    assert col_values(spark, ["Travis County, TX", "Nowhere"], clean.state_from_county_name) == ["TX", None]
    assert col_values(spark, ["texas", " New York ", "Atlantis"], clean.state_abbreviation) == ["TX", "NY", None]


def test_rounding_rules(spark):
    assert col_values(spark, [0.25, 0.15, 2.5, 3.5], lambda c: nm.round_half_even(c, 1), "double") == \
        [0.2, 0.2, 2.5, 3.5]
    assert col_values(spark, [250.0, 350.0], lambda c: nm.round_half_even(c, -2), "double") == [200.0, 400.0]
    assert col_values(spark, [0.15, -2.5, 2.5], lambda c: nm.round_half_up(c, 0), "double") == \
        [0.0, -3.0, 3.0]
    assert col_values(spark, [0.15], lambda c: nm.round_half_up(c, 1), "double") == [0.2]


def test_percentile_is_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert abs(df.select(F.percentile("x", 0.95)).first()[0] - 8.95) < 1e-9


def test_clip_keeps_null(spark):
    assert col_values(spark, [None, -1.0, 5.0, 20.0], lambda c: nm.clip(c, 0.0, 10.0), "double") == \
        [None, 0.0, 5.0, 10.0]


def test_value_tiers(spark):
    rows = [(2.9, 55.0), (2.9, 50.0), (2.9, 40.0), (7.9, None), (11.9, None), (12.0, None), (None, None)]
    df = spark.createDataFrame(rows, "pti double, edu double")
    got = [r[0] for r in df.select(ix.value_tier("pti", "edu")).collect()]
    assert got == ["Hidden gem", "Great value", "Fair market", "Fair market", "Premium",
                   "Overpriced", "Unknown"]


def test_density_and_scores_bounds(spark):
    df = spark.createDataFrame([(9000.0, 1.0), (3000.0, 25.0), (900.0, 3.0), (10.0, None), (None, 0.5)],
                               "pop double, pti double")
    out = df.select(ix.density_class("pop").alias("c"), ix.affordability_score("pti").alias("a")).collect()
    assert [r.c for r in out] == ["urban", "suburban", "small_town", "rural", None]
    assert all(r.a is None or 0 <= r.a <= 100 for r in out)


def test_ui_helpers(spark):
    assert col_values(spark, [40.0, 100.0, 101.0, None], clean.aqi_label, "double") == \
        ["Good", "Moderate", "Unhealthy", None]
    assert col_values(spark, ["Austin, TX", "Nowhere"], clean.short_metro) == ["Austin", "Nowhere"]


def test_unseen_state_encodes_to_zero(spark):
    from hearth.operators.boosting import Boosted
    from hearth.plans.training import ValuationModel
    model = ValuationModel(["CA", "NY", "TX"], {}, Boosted(0.0, []))
    serve = spark.createDataFrame([("CA",), ("NY",), ("TX",), ("ZZ",)], "state string")
    got = [r[0] for r in serve.select(model.state_code()).collect()]
    assert got == [0.0, 1.0, 2.0, 0.0]


def test_positional_rename(spark):
    df = spark.createDataFrame([("01", "TX", "Travis", "x")], "a string, b string, c string, d string")
    out = clean.rename_positional(df, ["fips_code", "fips_used", "state", "county", "more", "names"])
    assert out.columns == ["fips_code", "fips_used", "state", "county"]
    assert clean.first_col(out, ["nope", "state"]) == "state"
    assert clean.first_col(out, [], contains="cou") == "county"


def test_rounding_matches_numpy_property(spark):
    """Property: half-even rounding equals numpy's (what pandas .round does),
    bit for bit, over many generated values."""
    import numpy as np
    from hypothesis import given, settings, strategies as st

    values = []

    @settings(max_examples=300, deadline=None)
    @given(st.floats(min_value=-1e7, max_value=1e7, allow_nan=False, allow_infinity=False))
    def collect(x):
        values.append(x)

    collect()
    values += [0.25, 0.15, 2.675, -0.05, 1234.5, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", nm.round_half_even("x", 1).alias("r1"),
                    nm.round_half_even("x", -2).alias("r2")).collect()
    for r in got:
        assert r.r1 == np.round(r.x, 1), r.x
        assert r.r2 == float(np.rint(r.x / 100.0) * 100.0), r.x


def test_to_num_property(spark):
    import re
    from hypothesis import given, settings, strategies as st
    texts = []

    @settings(max_examples=200, deadline=None)
    @given(st.one_of(st.text(alphabet=" +-.eE0123456789,dNa", max_size=8),
                     st.floats(allow_nan=False, allow_infinity=False).map(repr)))
    def collect(t):
        texts.append(t)

    collect()
    pat = re.compile(nm.NUMERIC_PATTERN)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", nm.to_num("t").alias("v")).collect():
        expect = float(r.t.strip()) if pat.search(r.t) else None
        assert r.v == expect, repr(r.t)
