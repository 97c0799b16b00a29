"""Joining county-level metrics onto zip codes through the crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import fuzzy_key


def keep_first(df: DataFrame, key: str, order_cols) -> DataFrame:
    """One row per key: the smallest by ``order_cols`` (ascending, NULLs
    first), an explicit tie-break where the source kept whichever row came
    first. A ``min`` over a struct is a partial (map-side) aggregate, so a
    hot key is combined before the shuffle instead of sorted in one task.
    """
    order_cols = list(order_cols)
    rest = [c for c in df.columns if c != key and c not in order_cols]
    packed = F.min(F.struct(*order_cols, *rest)).alias("_first")
    return df.groupBy(key).agg(packed).select(key, *[F.col("_first")[c].alias(c)
                                                     for c in order_cols + rest])


def join_county_metrics(crosswalk: DataFrame, county: DataFrame, metric_cols,
                        county_state_col: str = "state_abbr", match: str = "exact") -> DataFrame:
    """Crosswalk (zip, state, county_clean) x county metrics.

    ``match="exact"`` joins on (county_clean, state). ``match="fuzzy"`` also
    accepts equal alphanumeric-only county keys where a zip has no exact
    match; a zip's result depends on its own rows only, never on how many
    other rows match.

    Exact equality implies equal alphanumeric keys, so ONE equi-join on
    (alphanumeric key, state) yields both match sets: exact pairs are the
    ones whose names are also equal, and sort first. The county side is one
    row per county; AQE broadcasts it when its runtime size allows.
    """
    if match not in ("exact", "fuzzy"):
        raise ValueError(f"match is exact or fuzzy, not {match!r}")
    metric_cols = list(metric_cols)
    xw = crosswalk.select("zip_code", "state", "county_clean")
    cm = county.select(F.col("county_clean").alias("_c"), F.col(county_state_col).alias("_s"),
                       *metric_cols)
    on = (xw.county_clean == cm._c) if match == "exact" else \
        (fuzzy_key(xw.county_clean) == fuzzy_key(cm._c))
    pairs = (xw.join(cm, on & (xw.state == cm._s), "inner")
               .select("zip_code", "county_clean", "state", *metric_cols,
                       (F.col("county_clean") != F.col("_c")).alias("_inexact")))
    order = ["_inexact", "county_clean", "state", *metric_cols]
    return keep_first(pairs, "zip_code", order).select("zip_code", *metric_cols)
