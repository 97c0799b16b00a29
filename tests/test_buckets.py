"""Tables dealt by zip: no exchange before the LAGs, declared anew by other sessions, one file a bucket."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearth.plans.warehouse import training_table, write_by_zip
from hearth.sources import io
from hearth.sources.schemas import TABLES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucket_count():
    assert [io.bucket_count(n, 10) for n in (0, 1, 10, 11, 20, 21, 40, 41)] == [1, 1, 1, 2, 2, 4, 4, 8]
    assert io.bucket_count(10 ** 13) == 1 << 16


def test_stored_training_set_has_a_bucket_a_core():
    from hearth.plans.registry import PANEL_ROWS_PER_BUCKET
    assert io.bucket_count(840_000, PANEL_ROWS_PER_BUCKET) >= 12         # the panel of 1 GB of tables


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_training_set_joins_and_lags_without_exchange(spark, catalog, tmp_path, no_broadcast):
    root = str(tmp_path)
    for name, df in (("zip_history", catalog.zip_market), ("census", catalog.census), ("education", catalog.education),
                     ("neighborhood_features", catalog.features)):
        write_by_zip(df, root, name, 4)
    io.replace_table(catalog.metro_market, f"{root}/metro_market", schema=TABLES["metro_market"])
    df = training_table(spark, root, start="1998-01-01")
    plan = _plan(df)
    assert "hashpartitioning(zip_code" not in plan and "Bucketed: true" in plan and "Window" in plan
    # the one exchange left is that of the metro join, behind the LAGs
    assert plan.count("Exchange hashpartitioning(metro_area") == plan.count("Exchange ") == 2
    from hearth.plans.training import build_training_data
    flat = build_training_data(catalog.zip_market, catalog.census, catalog.education, catalog.metro_market, catalog.features,
                               start="1998-01-01")
    assert "hashpartitioning(zip_code" in _plan(flat)
    assert sorted(map(str, df.collect())) == sorted(map(str, flat.collect())) != []


def test_versions_sessions_and_files(spark, tmp_path):
    path = f"{tmp_path}/it's"
    rows = spark.range(0, 1000, 1, 50).select((F.col("id") % 100).cast("string").alias("zip"), F.col("id").alias("at"))
    layout = {"bucket_by": "zip", "buckets": 4, "sort_cols": ["zip", "at"]}
    assert io.replace_table(rows, path, **layout) == 1000
    table = io.read_table(spark, path)
    assert len(table.inputFiles()) == 4                   # from 50 tasks
    # a session that did not write the table declares its layout again
    name = io._table_name(table.inputFiles()[0].rsplit("/", 1)[0].replace("file:///", "/").replace("%27", "'"))
    assert spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE {name}")
    again = io.read_table(spark, path)
    assert spark.catalog.tableExists(name) and sorted(again.collect()) == sorted(rows.collect())
    lag = again.withColumn("before", F.lag("at").over(Window.partitionBy("zip").orderBy("at")))
    assert "Exchange" not in _plan(lag)
    # a plain version may follow a bucketed one; an old version keeps its layout
    assert io.replace_table(rows.limit(10), path) == 10
    assert io.read_table(spark, path).count() == 10
    assert io.read_table(spark, path, version=1).count() == 1000
    # an empty table has no files and no rows
    assert io.replace_table(rows.where("false"), path, **layout) == 0
    assert io.read_table(spark, path).count() == 0 and io.read_table(spark, path).columns == ["zip", "at"]


def test_a_failed_bucketed_load_leaves_the_old_version(spark, tmp_path):
    path, layout = f"{tmp_path}/t", {"bucket_by": "zip", "buckets": 2}
    good = spark.createDataFrame([("1",), ("2",)], "zip string")
    io.replace_table(good, path, **layout)
    bad = good.select(F.when(F.col("zip") == "2", F.raise_error(F.lit("lost"))).otherwise(F.col("zip")).cast("string").alias("zip"))
    with pytest.raises(Exception, match="lost"):
        io.replace_table(bad, path, **layout)
    assert io.read_table(spark, path).count() == 2
    with pytest.raises(ValueError, match="absolute"):
        io.write_table(good, "relative/path", **layout)
    with pytest.raises(ValueError, match="bucketed"):
        io.write_table(good, path, partition_by_month=True, **layout)
