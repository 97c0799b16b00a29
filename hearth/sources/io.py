"""Readers and writers (S1-S8).

Raw files are read with every column as text (``inferSchema`` is what
drops leading zeros of zip codes); typing happens in the builders. Tables
are written as parquet, optionally partitioned by month so that trailing
window filters prune whole directories.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import enforce_schema


def read_raw_csv(spark: SparkSession, path: str, encoding: str = "UTF-8",
                 columns=None) -> DataFrame:
    """Header CSV, all strings. ``columns`` prunes to the needed columns
    (the scan then reads nothing else); ``encoding`` e.g. 'ISO-8859-1'."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("encoding", encoding).option("multiLine", False).csv(path))
    return df.select(*columns) if columns else df


def drop_repeated_header(df: DataFrame, column: str, label: str) -> DataFrame:
    """Drop a second header line by content (files are split across tasks,
    so 'skip row 1' has no meaning)."""
    return df.where(F.col(column).isNull() | (F.col(column) != label))


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn("month", F.date_format(F.col(date_col), "yyyy-MM"))


def write_table(df: DataFrame, path: str, schema: StructType | None = None,
                partition_by_month: bool = False, sort_cols=None, mode: str = "overwrite",
                fmt: str = "parquet", encoding: str | None = None, seen: Observation | None = None,
                bucket_by: str | None = None, buckets: int = 0) -> None:
    """Truncate-and-load a table: enforce the schema, optionally add the
    month partition column, sort rows inside each file (no global sort),
    and write. Month partitions are clustered first: rows are dealt by ranges of month and
    the sort columns, so a task holds few months, a month few files, and a file a narrow
    range of keys, however many tasks the rows come from. ``seen`` observes the rows written.
    ``bucket_by``: one file per hash bucket of that column, sorted inside (see ``bucketed_table``)."""
    if schema is not None:
        df = enforce_schema(df, schema)
    if bucket_by:
        if partition_by_month or fmt != "parquet" or buckets < 1:
            raise ValueError("a bucketed table is parquet, has a number of buckets, and no month partitions")
    writer_df = with_month(df) if partition_by_month else df
    order = [*(["month"] if partition_by_month else []), *(sort_cols or [])]
    if partition_by_month:
        # the number of ranges is left to Spark, which joins small ones at run time
        writer_df = writer_df.repartitionByRange(*order)
    if bucket_by:
        # the hash that deals rows to buckets deals them to tasks, so a bucket is one file of one task
        writer_df = writer_df.repartition(buckets, bucket_by)
    if seen is not None:
        # behind the exchange: the pass that samples its ranges would count rows again
        writer_df = writer_df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if bucket_by:
        writer_df.write.mode(mode).format(fmt).bucketBy(buckets, bucket_by).sortBy(*(sort_cols or [bucket_by])) \
            .option("path", path).saveAsTable(_table_name(path))
        return
    if order:
        writer_df = writer_df.sortWithinPartitions(*order)
    w = writer_df.write.mode(mode).format(fmt)
    if partition_by_month:
        w = w.partitionBy("month")
    if fmt == "csv":
        w = w.option("header", True)
    if encoding:
        w = w.option("encoding", encoding)
    w.save(path)


def bucket_count(rows: int, rows_per_bucket: int = 1_000_000) -> int:
    """Buckets for a table of ``rows``: the next power of two (Spark joins tables whose bucket numbers divide
    each other without dealing both anew), within the 65,536 that leave room below Spark's own limit of 100,000."""
    return min(1 << max(0, -(-rows // rows_per_bucket) - 1).bit_length(), 1 << 16)


def _table_name(folder: str) -> str:
    """The catalog name of a bucketed folder: its layout is known to Spark only through a table."""
    if not folder.startswith("/") and "://" not in folder and ":/" not in folder:
        raise ValueError(f"{folder}: a bucketed table needs an absolute path")
    return f"bucketed_{hashlib.sha256(folder.encode()).hexdigest()[:32]}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucketed_table(spark: SparkSession, folder: str, ddl: str, key: str, buckets: int, sort_cols) -> DataFrame:
    """A bucketed folder as a table that Spark knows to be dealt by ``key``.

    Joins and windows on the key then read bucket by bucket and exchange nothing. The layout
    is declared to the session's catalog (a session that did not write the folder
    declares it anew); the files stay where they are.
    """
    name = _table_name(folder)
    if not spark.catalog.tableExists(name):
        at = folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({_quoted(key)}) "
                  f"SORTED BY ({', '.join(map(_quoted, sort_cols))}) INTO {int(buckets)} BUCKETS LOCATION '{at}'")
    return spark.table(name)


LOG_SCHEMA = "version long, folder string, rows long, fields string, ddl string, bucket_by string, buckets int, sorted_by array<string>"


def _log(spark: SparkSession, path: str):
    """The last committed version of a table that ``replace_table`` wrote, or None."""
    try:
        # the schema is given, so only the log's few small files are read
        return spark.read.schema(LOG_SCHEMA).json(f"{path}/log/*").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def replace_table(df: DataFrame, path: str, schema: StructType | None = None, expect_rows: int | None = None, **options) -> int:
    """Load a table in place of its last version, all or nothing; returns the rows written.

    Rows go to a new folder under ``path``/versions. Its files are read back, and rows (against those
    that the write saw, and ``expect_rows``) and columns checked; then one small file
    under ``path``/log names it. Readers (``read_table``) follow the newest entry, so a job that
    fails before leaves the old version in place, and one that reads meanwhile keeps its files.
    Of two writers of one version the later fails.
    """
    spark = df.sparkSession
    last = _log(spark, path)
    version = last["version"] + 1 if last else 1
    folder, seen = f"versions/{version:08d}-{uuid.uuid4().hex}", Observation()
    write_table(df, f"{path}/{folder}", schema, seen=seen, **options)
    key = options.get("bucket_by")
    # a bucketed table without rows has no file that could tell its columns
    written = spark.table(_table_name(f"{path}/{folder}")) if key else spark.read.parquet(f"{path}/{folder}")
    rows = seen.get["rows"]
    names = [f.name for f in schema.fields] if schema is not None else df.columns
    if written.count() != rows or (expect_rows is not None and rows != expect_rows):
        raise ValueError(f"{path}: {rows} rows seen, {written.count()} in files, {expect_rows} expected; the table stays as it was")
    if [c for c in written.columns if c in names] != [c for c in names if c in written.columns] or set(names) - set(written.columns):
        raise ValueError(f"{path}: columns {written.columns} written, {names} expected; the table stays as it was")
    ddl = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in written.schema)
    layout = (ddl, *((key, options["buckets"], list(options.get("sort_cols") or [key])) if key else (None, None, None)))
    entry = spark.createDataFrame([(version, folder, rows, ",".join(written.columns), *layout)], LOG_SCHEMA)
    entry.coalesce(1).write.mode("error").json(f"{path}/log/{version:08d}")
    return rows


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """A table's last version (or the one asked for), or the plain files under ``path``."""
    entry = _log(spark, path) if fmt == "parquet" else None
    if entry is None:
        return spark.read.format(fmt).load(path)
    if version is not None:
        entry = spark.read.schema(LOG_SCHEMA).json(f"{path}/log/*").where(F.col("version") == version).first()
        if entry is None:
            raise ValueError(f"{path} has no version {version}")
    folder = f"{path}/{entry['folder']}"
    if entry["bucket_by"]:
        return bucketed_table(spark, folder, entry["ddl"], entry["bucket_by"], entry["buckets"], entry["sorted_by"])
    return spark.read.parquet(folder)


def month_range_filter(start, end=None) -> F.Column:
    """Predicate on both ``date`` and the ``month`` partition column, so the
    scan prunes directories as well as rows."""
    cond = (F.col("date") >= F.lit(start).cast("date")) & \
           (F.col("month") >= F.date_format(F.lit(start).cast("date"), "yyyy-MM"))
    if end is not None:
        cond = cond & (F.col("date") <= F.lit(end).cast("date")) & \
               (F.col("month") <= F.date_format(F.lit(end).cast("date"), "yyyy-MM"))
    return cond
