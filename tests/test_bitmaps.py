"""Distinct counts from kept bitmaps equal counting again, also after more rows and beyond one bucket."""

from pyspark.sql import functions as F

from hearth.operators.bitmaps import extend_numbers, group_bitmaps, merged_counts


def _rows(spark, lo, hi):
    return spark.range(lo, hi).select((F.col("id") * 7919 % 70_000).cast("string").alias("k"),
                                      (F.col("id") % 12).alias("month"), (F.col("id") % 3).alias("g"))


def _counts(df, *by):
    return sorted(map(tuple, df.select(*by, "n").collect()))


def test_counts_merge_and_grow(spark):
    old, new = _rows(spark, 0, 60_000), _rows(spark, 50_000, 90_000)
    numbers = extend_numbers(old, "k").cache()
    kept = group_bitmaps(old, ["g", "month"], numbers, "k")
    assert _counts(merged_counts(kept, ["g"], "n"), "g") == _counts(old.groupBy("g").agg(F.countDistinct("k").alias("n")), "g")
    grown = extend_numbers(new, "k", numbers).cache()
    assert grown.count() == grown.select("n").distinct().count() == old.unionByName(new).select("k").distinct().count()
    assert grown.join(numbers, ["k", "n"]).count() == numbers.count()          # old numbers stay
    both = kept.unionByName(group_bitmaps(new, ["g", "month"], grown, "k"))
    want = old.unionByName(new)
    for by in (["g"], ["month"], ["g", "month"]):
        assert _counts(merged_counts(both, by, "n"), *by) == _counts(want.groupBy(*by).agg(F.countDistinct("k").alias("n")), *by)
    assert merged_counts(both, ["g"], "n")._jdf.queryExecution().toString().count("Expand") == 0


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1)], "k string, g int")
    numbers = extend_numbers(rows, "k")
    assert _counts(merged_counts(group_bitmaps(rows, ["g"], numbers, "k"), ["g"], "n"), "g") == [(1, 1)]
    empty = rows.where("false")
    assert merged_counts(group_bitmaps(empty, ["g"], extend_numbers(empty, "k"), "k"), ["g"], "n").count() == 0
