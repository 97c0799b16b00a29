"""Valuation model: fit, metrics, importances, persistence, batch scoring."""

import tempfile

from pyspark.sql import functions as F

from hearth.plans.training import FEATURE_COLS, fit_valuation_model, load_model, predict, save_model
from hearth.plans.valuation import unmatched


def test_fit_save_load_predict(spark, catalog):
    training = catalog.training_data
    model, metrics, importance = fit_valuation_model(training, rounds=3, depth=3)
    m = metrics.first()
    assert m.n_test > 0 and m.mae >= 0 and m.mape >= 0
    imp = importance.collect()
    assert 0 < len(imp) <= 10
    assert all(r.feature in FEATURE_COLS or r.feature == "state_encoded" for r in imp)
    path = tempfile.mkdtemp(prefix="hearth-model-")
    save_model(model, metrics, path)
    model2, metrics2 = load_model(spark, path)
    props = catalog.properties
    a = predict(props, catalog.features, catalog.zip_market, model, metrics)
    b = predict(props, catalog.features, catalog.zip_market, model2, metrics2)
    ka = sorted((r.property_id, r.estimated_value) for r in a.select("property_id", "estimated_value").collect())
    kb = sorted((r.property_id, r.estimated_value) for r in b.select("property_id", "estimated_value").collect())
    assert ka == kb and len(ka) == props.join(catalog.features, "zip_code", "left_semi").count()
    row = a.first()
    assert 70 - 12 <= row.confidence <= 92
    assert row.low_estimate <= row.estimated_value <= row.high_estimate


def test_unmatched_requests(spark, catalog):
    props = catalog.properties.limit(3).unionByName(
        catalog.properties.limit(1).withColumn("zip_code", F.lit("99999")))
    assert [r.zip_code for r in unmatched(props, catalog.features).collect()] == ["99999"]


def test_splits_are_deterministic_and_disjoint(spark, catalog):
    from hearth.plans.training import split_column
    t = catalog.training_data
    for how in ("row", "zip", "time"):
        a = t.select("zip_code", "year", "month", split_column(how, t).alias("s"))
        counts = {r.s: r["count"] for r in a.groupBy("s").count().collect()}
        assert set(counts) <= {"train", "validation", "test"} and counts.get("train", 0) > 0
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(5).collect()))
    z = t.select("zip_code", split_column("zip", t).alias("s")).distinct()
    assert z.count() == z.select("zip_code").distinct().count()     # a zip never straddles
    tm = t.select("year", "month", split_column("time", t).alias("s")).distinct().toPandas()
    idx = tm.year * 12 + tm.month
    assert idx[tm.s == "test"].min() > idx[tm.s != "test"].max()


def test_predict_carries_forecast_list(spark, catalog):
    model, metrics, _ = catalog.model
    out = predict(catalog.properties, catalog.features, catalog.zip_market, model, metrics)
    rows = out.select("forecast_years", "forecast").collect()
    for r in rows:
        if r.forecast_years >= 1:
            assert [f.year for f in r.forecast] == sorted(f.year for f in r.forecast)
            assert len(r.forecast) == r.forecast_years
        else:
            assert r.forecast is None
    # the list in the row equals the forecast operator's rows
    from hearth.plans.valuation import forecast
    apart = forecast(out.drop("forecast"), catalog.zip_market)
    inline = out.select("property_id", F.explode("forecast").alias("f")).select("property_id", "f.*")
    assert sorted(map(tuple, inline.collect())) == sorted(map(tuple, apart.collect()))
    assert inline.count() > 0
    # one pass: the trees are applied once, the mart and the trends joined once
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Join ") == 2 and "Generate" not in plan


def test_a_zip_is_scored_once_whatever_its_properties(spark, catalog):
    model, metrics, _ = fit_valuation_model(catalog.training_data, rounds=2, depth=3)
    out = predict(catalog.properties, catalog.features, catalog.zip_market, model, metrics)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    scored = next(i for i, line in enumerate(plan) if "ArrowEvalPython" in line)
    depth = len(plan[scored]) - len(plan[scored].lstrip(" :+-"))
    below = [line for line in plan[scored + 1:] if len(line) - len(line.lstrip(" :+-")) > depth]
    assert below and not any("o_orderkey" in line for line in below)
