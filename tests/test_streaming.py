"""Streaming panel ingest and snapshot agree with the batch builders."""

import tempfile

from pyspark.sql import functions as F

from hearth.plans.features import zip_snapshot
from hearth.streaming import ingest_panel_files, latest_snapshot_stream


def test_stream_snapshot_matches_batch(spark, catalog):
    panel = catalog.zip_market
    src = tempfile.mkdtemp(prefix="hearth-stream-src-")
    text = panel.select(*[F.col(c).cast("string").alias(c) for c in panel.columns])
    # land the panel as several files, one batch of months at a time
    for year in (1995, 1997, 1999, 2001):
        (text.where(F.year(F.col("date").cast("date")).between(year, year + 1))
             .write.mode("append").option("header", True).csv(src))
    stream = ingest_panel_files(spark, src, fmt="csv", max_files_per_trigger=2)
    q = (latest_snapshot_stream(stream).writeStream.format("memory").queryName("snap_test")
         .outputMode("complete").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("snap_test").collect()))
    expect = sorted(map(tuple, zip_snapshot(panel).select(
        "zip_code", "city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent",
        "last_updated").collect()))
    assert got == expect


def test_stream_panel_to_partitioned_table(spark, catalog):
    from hearth.streaming.panel import write_panel
    panel = catalog.zip_market
    src = tempfile.mkdtemp(prefix="hearth-stream-src2-")
    out = tempfile.mkdtemp(prefix="hearth-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="hearth-stream-ckpt-")
    text = panel.select(*[F.col(c).cast("string").alias(c) for c in panel.columns])
    text.write.mode("overwrite").option("header", True).csv(src)
    q = write_panel(ingest_panel_files(spark, src), out, ckpt)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(out)
    assert "month" in got.columns
    cols = ["zip_code", "city", "state", "metro_area", "date", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent"]
    assert got.select(*cols).exceptAll(panel.select(*cols)).count() == 0
    assert got.count() == panel.count()
