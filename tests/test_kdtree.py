"""Cells of bounded size and exact neighbours, on crowded, tied and far-off values."""

import math

import pytest
from pyspark.sql import functions as F

from hearth.operators.kdtree import near_cells, split_cells
from hearth.plans.recommend import SIMILAR_DEFAULTS, find_similar

DIMS = [m for m, _ in SIMILAR_DEFAULTS]


def _r(k):
    return F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(100_003)) / 100_003.0


def _near_equal(spark, n):
    """Nearly equal zips, with a tenth spread widely."""
    spread = F.when(F.col("id") % 10 == 0, F.lit(5.0)).otherwise(F.lit(1e-6))
    return spark.range(n).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("zip_code"),
                                 *[(F.lit(x) * F.exp(spread * (_r(i) - 0.5))).alias(m) for i, (m, x) in enumerate(SIMILAR_DEFAULTS)])


def test_cells_are_bounded_among_near_equal_zips(spark):
    pts = _near_equal(spark, 100_000).select("zip_code", *[F.log(m).alias(f"u{i}") for i, m in enumerate(DIMS)])
    cells, rounds = split_cells(pts, ["u0", "u1", "u2", "u3"], leaf=64)
    sizes = cells.groupBy(f"_c{rounds}").count()
    assert cells.count() == 100_000 and sizes.agg(F.max("count")).first()[0] <= 64 and rounds <= 5


@pytest.mark.parametrize("shape", ["hot value", "one vector", "far"])
def test_ties_and_far_points_split(spark, shape):
    x = {"hot value": F.when(F.col("id") % 20 > 0, F.lit(3.0)).otherwise(_r(1)), "one vector": F.lit(2.0),
         "far": F.pow(F.lit(2.0), F.col("id") % 900)}[shape]
    pts = spark.range(4000).select(x.alias("a"), (_r(2) if shape != "one vector" else F.lit(1.0)).alias("b"))
    cells, rounds = split_cells(pts, ["a", "b"], leaf=50)
    largest = cells.groupBy(f"_c{rounds}").count().agg(F.max("count")).first()[0]
    assert largest <= 50 if shape != "one vector" else (largest == 4000 and rounds == 0)


def test_neighbours_match_brute_force_and_few_points_are_measured(spark):
    n, k = 6000, 5
    f = _near_equal(spark, n).select("*", F.lit("c").alias("city"), F.lit("s").alias("state"), F.lit("m").alias("metro_area"))
    targets = f.where("id_ % 300 = 0") if "id_" in f.columns else f.where(F.col("zip_code").cast("int") % 300 == 0)
    got = {}
    for r in find_similar(f, k=k, targets=targets, leaf=16).collect():
        got.setdefault(r.target_zip, {})[r["rank"]] = r.zip_code
    rows = [tuple(r) for r in f.select("zip_code", *DIMS).collect()]
    for t in rows[::300]:
        near = sorted((math.sqrt(sum(((x - y) / y) ** 2 for x, y in zip(c[1:], t[1:]))), c[0]) for c in rows if c[0] != t[0])[:k]
        assert [got[t[0]][i + 1] for i in range(k)] == [z for _, z in near]
    pts = f.select("zip_code", *DIMS, *[F.log(m).alias(f"u{i}") for i, m in enumerate(DIMS)])
    cells, rounds = split_cells(pts, ["u0", "u1", "u2", "u3"], leaf=16)
    todo = targets.select(F.col("zip_code").alias("t"), F.lit(k).alias("need"), *[F.col(m).alias(f"r_{m}") for m in DIMS])
    met = near_cells(todo, cells, rounds, DIMS, "t", "need").join(cells.select(F.col(f"_c{rounds}").alias("_n")), "_n").count()
    assert met < 0.2 * n * targets.count()


def test_reach_holds_enough_points_and_cells_are_few(spark):
    need = 5
    pts = spark.range(4000).select("id", *[(_r(i) + 1).alias(d) for i, d in enumerate("abc")])
    cells, rounds = split_cells(pts, ["a", "b", "c"], leaf=32)
    targets = pts.where("id % 40 = 0").select("id", F.lit(need).alias("need"), *[F.col(d).alias(f"r_{d}") for d in "abc"])
    met = near_cells(targets, cells, rounds, ["a", "b", "c"], "id", "need")
    reach = {r.id: r._reach for r in met.select("id", "_reach").distinct().collect()}
    rows = [tuple(r) for r in pts.collect()]
    for t in rows[::400]:
        near = sorted(sum(((x - y) / y) ** 2 for x, y in zip(c[1:], t[1:])) for c in rows if c[0] != t[0])
        assert near[need - 1] <= reach[t[0]] * (1 + 1e-9) < near[400]
    assert len(reach) == 100 and met.count() < 25 * 100


def test_repeated_rows_of_a_zip_do_not_shorten_its_list(spark):
    n, k = 600, 5
    f = _near_equal(spark, n).select("*", F.lit("c").alias("city"), F.lit("s").alias("state"), F.lit("m").alias("metro_area"))
    out = find_similar(f.unionByName(f), k=k, leaf=16).groupBy("target_zip").agg(F.max("rank").alias("most"), F.count("*").alias("n"))
    # five picks for each of the target's two rows, each with the attributes of the pick's two
    assert [tuple(r) for r in out.select("most", "n").distinct().collect()] == [(k, 4 * k)] and out.count() == n
