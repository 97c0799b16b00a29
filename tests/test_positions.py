"""Global positions, band joins and insertion points vs plain Python."""

import random

from pyspark.sql import functions as F

from hearth.operators.positions import band_join, insertion_points, with_positions


def _rows(n, hot_share=1 / 3, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        v = 5.0 if rnd.random() < hot_share else float(rnd.randint(0, 50))   # a hot value
        out.append((f"z{i:05d}", v))
    return out


def test_positions_are_a_dense_total_order(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r._pos for r in with_positions(df, [F.col("v").desc(), F.col("k")], partitions=13).collect()}
    expect = {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == expect


def test_band_join_pairs(spark):
    probe = spark.createDataFrame([(0, 0), (1, 10), (2, 29)], "id int, p long")
    build = spark.range(30).select(F.col("id").alias("q"))
    got = sorted((r.id, r.q) for r in band_join(probe, build, "p", "q", -2, 3, block=5).collect())
    expect = sorted((i, q) for i, p in ((0, 0), (1, 10), (2, 29)) for q in range(30) if p - 2 <= q <= p + 3)
    assert got == expect


def test_insertion_points(spark):
    items = _rows(500)
    marks = [(f"u{i}", float(x)) for i, x in enumerate([-1, 5, 5.5, 20, 60, 5])]
    it = spark.createDataFrame(items, "zip string, key double")
    mk = spark.createDataFrame(marks, "uid string, key double")
    asc = {r.uid: r._start for r in insertion_points(mk, it, "key", "uid", item_tie="zip").collect()}
    assert asc == {u: sum(1 for _, v in items if v < x) for u, x in marks}
    desc = {r.uid: r._start for r in insertion_points(mk, it, "key", "uid", descending=True,
                                                       item_tie="zip").collect()}
    assert desc == {u: sum(1 for _, v in items if v > x) for u, x in marks}
