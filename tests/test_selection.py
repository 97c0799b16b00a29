"""Exact percentiles against ``percentile``: ties, nulls, narrowing rounds, columns without values."""

import pytest
from pyspark.sql import functions as F

from hearth.operators.selection import exact_percentiles

SHARES = [0.0, 0.05, 0.5, 0.95, 1.0]


def _table(spark, n):
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    return spark.range(n, numPartitions=5).select(
        (h / 7).alias("spread"), F.when(F.col("id") % 10 > 0, F.lit(5.0)).otherwise(h).alias("hot"),
        F.when(F.col("id") % 3 == 0, h % 11).alias("ties_nulls"), F.lit(None).cast("double").alias("nothing"),
        F.exp(h / 2_000).alias("wide"), (F.col("id") % 4).cast("int").alias("whole"))


@pytest.mark.parametrize("n, limit, accuracy", [(0, 10, 100), (1, 10, 100), (2, 10, 100), (7, 100, 1000),
                                                (30_000, 100_000, 10_000), (30_000, 200, 100), (30_000, 5, 10)])
def test_equal_to_percentile(spark, n, limit, accuracy):
    df = _table(spark, n)
    got = exact_percentiles(df, {c: SHARES for c in df.columns}, limit, accuracy)
    want = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, SHARES))).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert [got[c, p] for p in SHARES] == ([None] * len(SHARES) if want[c] is None else want[c]), c


def test_no_task_gathers_the_column(spark):
    """Narrowing leaves few values to order, whatever the number of distinct ones."""
    from hearth.operators import selection
    df, marks = _table(spark, 50_000), []
    real = selection._narrow
    selection._narrow = lambda d, m, a: (real(d, m, a), marks.extend(x["inside"] for x in m))
    try:
        exact_percentiles(df, {"spread": [0.5]}, limit=500, accuracy=200)
    finally:
        selection._narrow = real
    assert marks and marks[-1] <= 500
