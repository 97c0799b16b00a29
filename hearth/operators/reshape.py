"""Wide -> long reshaping and multi-table outer alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_num


def melt_wide(df: DataFrame, id_cols, value_name: str, date_col: str = "date",
              date_format: str = "yyyy-MM-dd") -> DataFrame:
    """One column per month -> one row per (ids, month).

    Every non-id column is a date header. Headers that are not dates and
    values that are not numbers are dropped right after the unpivot, so the
    x(#months) row blow-up never reaches a shuffle.
    """
    id_cols = list(id_cols)
    value_cols = [c for c in df.columns if c not in id_cols]
    long = df.select(*id_cols, *[F.col(f"`{c}`").cast("string").alias(c) for c in value_cols]) \
             .unpivot(id_cols, value_cols, "_header", "_raw")
    return (long
            .withColumn(date_col, F.try_to_date(F.col("_header"), date_format))
            .withColumn(value_name, to_num("_raw"))
            .where(F.col(date_col).isNotNull() & F.col(value_name).isNotNull())
            .drop("_header", "_raw"))


def align_outer(frames, keys, value_cols=None) -> DataFrame:
    """n-way full outer join on ``keys`` as union + group-by.

    One shuffle on the keys instead of n-1 chained full joins, and NULL
    keys group together (a chained join on NULL keys would split them).
    Each input contributes its own value columns; duplicates within one
    input keep the max.
    """
    frames = list(frames)
    keys = list(keys)
    if value_cols is None:
        value_cols = [c for f in frames for c in f.columns if c not in keys]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                   [f.select(*keys, *[c for c in f.columns if c not in keys]) for f in frames])
    return union.groupBy(*keys).agg(*[F.max(c).alias(c) for c in value_cols])
