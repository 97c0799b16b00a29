"""Loads that keep what they can't use: malformed lines and values that don't convert, with reason and file.

Raw rows are read once. Each row is tested against named rules; rows that break one go to
the rejected side of the staged table with all their reasons and the file they came
from, the others to the accepted side. Counts per reason are observed by the same write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
MALFORMED = "malformed line"


def read_csv_lines(spark: SparkSession, path: str, columns: list[str], header: bool = False,
                   encoding: str = "UTF-8") -> DataFrame:
    """A CSV as text columns by position, and `_corrupt_record`: the line, where it has more or fewer fields than ``columns``."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    return spark.read.schema(schema).option("header", header).option("encoding", encoding).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_checked_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header as text columns of its names, and `_corrupt_record` as in ``read_csv_lines``."""
    names = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path).columns
    return read_csv_lines(spark, path, names, header=True, encoding=encoding)


def load_checked(raw: DataFrame, rules: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted rows, rejected rows with `_reasons` and `_file`, counts by reason and of all `rows`).

    ``rules``: reason -> condition that rejects (null: does not). A malformed line is rejected
    for that alone, as its fields can't be trusted. ``path`` gets a new folder of staged rows.
    """
    if CORRUPT in raw.columns:
        whole = F.col(CORRUPT).isNull()
        rules = {MALFORMED: ~whole, **{k: whole & c for k, c in rules.items()}}
    broken = {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]), lambda r: r.isNotNull())
    staged = raw.select("*", F.input_file_name().alias("_file"), reasons.alias("_reasons")) \
        .withColumn("_rejected", F.size("_reasons") > 0)
    seen = Observation()
    folder = f"{path}/checked-{uuid.uuid4().hex}"
    staged.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count(F.when(F.array_contains("_reasons", k), 1)).alias(k) for k in broken]) \
        .write.partitionBy("_rejected").parquet(folder)
    back = raw.sparkSession.read.schema(staged.schema).parquet(folder)
    accepted = back.where(~F.col("_rejected")).select(*[c for c in raw.columns if c != CORRUPT])
    return accepted, back.where("_rejected").drop("_rejected"), dict(seen.get)
