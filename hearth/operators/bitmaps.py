"""Exact distinct counts that merge: bitmaps over numbered keys, kept per group.

Each key value has a number of its own for good (``extend_numbers`` gives new values the
next ones), a group keeps one bitmap of up to 4 KB per 32,768 numbers, and the distinct
count of any union of groups is the count of bits in the OR of their bitmaps. A month
more only adds that month's bitmaps; nothing is expanded or counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import POS, with_positions


def extend_numbers(values: DataFrame, key: str, numbers: DataFrame | None = None) -> DataFrame:
    """(key, n): numbers from 1 for all values of ``key``; those in ``numbers`` keep theirs."""
    new = values.select(key).where(F.col(key).isNotNull()).distinct()
    start = F.lit(0)
    if numbers is not None:
        new = new.join(numbers, key, "left_anti")
        start = F.coalesce(numbers.select(F.max("n")).scalar(), F.lit(0))
    fresh = with_positions(new, [key]).select(key, (F.col(POS) + 1 + start).cast("long").alias("n"))
    return fresh if numbers is None else numbers.select(key, "n").unionByName(fresh)


def group_bitmaps(rows: DataFrame, groups: list, numbers: DataFrame, key: str) -> DataFrame:
    """groups, bucket, bits: the ``key`` values of each group. ``groups``: columns or names."""
    groups = [F.col(g) if isinstance(g, str) else g for g in groups]
    named = rows.select(*groups, F.col(key))
    names = [c for c in named.columns if c != key]
    return named.join(numbers, key).groupBy(*names, F.bitmap_bucket_number("n").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merged_counts(bitmaps: DataFrame, groups: list, name: str) -> DataFrame:
    """groups, ``name``: distinct values over all bitmaps of each coarser group."""
    groups = [F.col(g) if isinstance(g, str) else g for g in groups]
    by = bitmaps.select(*groups, "bucket", "bits")
    names = [c for c in by.columns if c not in ("bucket", "bits")]
    merged = by.groupBy(*names, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).alias(name))
