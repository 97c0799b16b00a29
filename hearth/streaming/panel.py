"""Streaming ingestion of long-format panel files and the latest snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.clean import zfill5
from ..functions.numeric import to_num

PANEL_FILE_SCHEMA = StructType([StructField(c, StringType()) for c in (
    "zip_code", "city", "state", "metro_area", "date", "zhvi_sfr", "zhvi_sfrcondo", "zori_rent")])


def clean_panel_rows(df: DataFrame) -> DataFrame:
    """The E1 cleaning for long rows: padded zip, typed date, strict
    numbers; rows without a date or without any value are dropped."""
    out = df.select(zfill5("zip_code").alias("zip_code"), "city", "state", "metro_area",
                    F.try_to_date(F.col("date"), "yyyy-MM-dd").alias("date"),
                    *[to_num(c).alias(c) for c in ("zhvi_sfr", "zhvi_sfrcondo", "zori_rent")])
    return out.where(F.col("date").isNotNull() & F.coalesce("zhvi_sfr", "zhvi_sfrcondo",
                                                             "zori_rent").isNotNull())


def ingest_panel_files(spark: SparkSession, source_dir: str, fmt: str = "csv",
                       max_files_per_trigger: int = 64) -> DataFrame:
    """A streaming DataFrame of cleaned panel rows from files landing in
    ``source_dir`` (all columns read as text, schema fixed up front)."""
    reader = (spark.readStream.schema(PANEL_FILE_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger))
    if fmt == "csv":
        reader = reader.option("header", True)
    return clean_panel_rows(reader.format(fmt).load(source_dir))


def write_panel(stream: DataFrame, table_dir: str, checkpoint_dir: str):
    """Append to the month-partitioned panel table; the file sink with a
    checkpoint gives exactly-once output across restarts."""
    return (stream.withColumn("month", F.date_format("date", "yyyy-MM"))
                  .writeStream.format("parquet").partitionBy("month")
                  .option("checkpointLocation", checkpoint_dir)
                  .outputMode("append").start(table_dir))


def latest_snapshot_stream(stream: DataFrame) -> DataFrame:
    """Latest row per zip (W5) as a stateful streaming aggregate; the
    state holds one row per zip, whatever the number of months."""
    packed = F.max_by(F.struct("date", "city", "state", "metro_area", "zhvi_sfr",
                               "zhvi_sfrcondo", "zori_rent"), "date")
    agg = stream.groupBy("zip_code").agg(packed.alias("_l"))
    return agg.select("zip_code", *[F.col(f"_l.{c}").alias(c) for c in
                                    ("city", "state", "metro_area", "zhvi_sfr", "zhvi_sfrcondo",
                                     "zori_rent")],
                      F.col("_l.date").alias("last_updated"))
