"""Cells of bounded size by repeated splits, and exact nearest neighbours over them.

``split_cells`` cuts points into boxes: a cell with more than ``leaf`` points is split at
quantiles of its widest coordinate, all cells of a round at once, until none is too
large. A value that many points share gets a cell of its own, which the other coordinates
then split, so crowded places are cut finer and empty space is not cut at all.

``near_cells`` first takes every target down to one cell, the nearest at each step, as one row, and
measures the points there: the distance within which enough of them lie is the target's reach. Then targets
go down again, one join a round, into the cells whose box is within reach. Only
points of the cells left at the end are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LEAF = 32
CUTS = 15                     # quantiles per split: at most 2 * CUTS + 1 children
FAN = 32
SAFE = 1e-9


def split_cells(points: DataFrame, coords: list[str], leaf: int = LEAF) -> tuple[DataFrame, int]:
    """``points`` with a cell number per round (_c1 .. _cN; _c0 is 0), and N. A cell's parent is its number div FAN."""
    cur, rounds = points.withColumn("_c0", F.lit(0).cast("long")), 0
    shares = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    while True:
        here = f"_c{rounds}"
        widths = [F.max(c) - F.min(c) for c in coords]
        stats = cur.groupBy(here).agg(F.count("*").alias("n"), F.array(*widths).alias("w"),
                                      F.array(*[F.percentile_approx(c, shares, 1000) for c in coords]).alias("q"))
        # no more cuts than leave some leaf / 2 points between two of them
        step = F.lit((CUTS + 1) // 2)
        for parts in (4, 8, CUTS + 1):
            step = F.when(F.col("n") >= parts * max(leaf // 2, 1), (CUTS + 1) // parts).otherwise(step)
        wide = stats.where((F.col("n") > leaf) & (F.array_max("w") > 0)) \
            .select(here, "n", (F.array_position("w", F.array_max("w")) - 1).cast("int").alias("_axis"), "q") \
            .withColumn("_step", step).withColumn("q", F.get("q", F.col("_axis"))) \
            .select(here, "_axis", F.array_distinct(F.filter("q", lambda _, i: (i + 1) % F.col("_step") == 0)).alias("_cuts"),
                    F.array_distinct(F.filter("q", lambda c, i: (i > 0) & (F.get("q", i - 1) == c))).alias("_hot"))
        wide = cut_lineage(wide)
        if wide.isEmpty():
            return cur, rounds
        rounds += 1
        x = F.get(F.array(*coords), F.col("_axis"))
        # a value at several quantiles has a cell of its own, apart from the ones between cuts
        above = lambda c: F.when(F.array_contains("_hot", c), (c < x).cast("int")).otherwise((c <= x).cast("int"))
        child = F.aggregate("_cuts", F.lit(0), lambda n, c: n + above(c) + (c <= x).cast("int"))
        cur = cut_lineage(cur.join(wide, here, "left")
                          .withColumn(f"_c{rounds}", F.col(here) * FAN + F.coalesce(child, F.lit(FAN - 1)))
                          .drop("_axis", "_cuts", "_hot"))


def _boxes(points: DataFrame, level: int, dims: list[str]) -> DataFrame:
    return points.groupBy(F.col(f"_c{level}").alias("_n")).agg(
        F.count("*").alias("_points"), *[f(d).alias(f"_{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]) \
        .withColumn("_parent", F.expr(f"_n div {FAN}"))


def _square(dims: list[str], pick) -> Column:
    """Sum over dims of the squared difference to the target, relative to it."""
    total = None
    for d in dims:
        term = F.pow((pick(d) - F.col(f"r_{d}")) / F.col(f"r_{d}"), 2)
        total = term if total is None else total + term
    return total


def _low(dims: list[str], edge) -> Column:
    return _square(dims, lambda d: F.least(F.greatest(F.col(f"r_{d}"), edge(f"_lo_{d}")), edge(f"_hi_{d}")))


def _high(dims: list[str], edge) -> Column:
    total = F.lit(0.0)
    for d in dims:
        total = total + F.greatest(*[F.pow((edge(f"_{k}_{d}") - F.col(f"r_{d}")) / F.col(f"r_{d}"), 2) for k in ("lo", "hi")])
    return total


def _few(df: DataFrame, level: int) -> DataFrame:
    """``df`` with at most FAN ** ``level`` rows: broadcast while that is few."""
    return F.broadcast(df) if level <= 2 else df


def _with_reach(targets: DataFrame, points: DataFrame, boxes: list[DataFrame], dims: list[str], need: str) -> DataFrame:
    """Adds _reach: a squared distance within which ``need`` other points lie (null: there are not that many)."""
    cur = targets.withColumn("_n", F.lit(0).cast("long")).withColumn("_cap", F.lit(None).cast("double"))
    edges = [f"_{k}_{d}" for d in dims for k in ("lo", "hi")]
    for level, box in enumerate(boxes, 1):
        kids = box.groupBy("_parent").agg(F.collect_list(F.struct("_n", "_points", *edges)).alias("_kids"))      # at most FAN
        best = F.array_min(F.transform("_kids", lambda b: F.struct(
            _low(dims, lambda e: b[e]).alias("low"), (-b["_points"]).alias("less"), _high(dims, lambda e: b[e]).alias("high"),
            b["_n"].alias("n"))))
        cur = cur.withColumnRenamed("_n", "_parent").join(_few(kids, level - 1), "_parent").drop("_parent") \
            .withColumn("_best", best).drop("_kids")
        # one of the points may be the target itself
        cur = cur.withColumn("_cap", F.when(-F.col("_best.less") > F.col(need), F.least("_cap", "_best.high")).otherwise(F.col("_cap"))) \
            .withColumn("_n", F.col("_best.n")).drop("_best")
    there = points.groupBy(F.col(f"_c{len(boxes)}").alias("_n")).agg(F.collect_list(F.struct(*dims)).alias("_there"))
    near = F.sort_array(F.transform("_there", lambda p: _square(dims, lambda d: p[d])))
    return cur.join(there, "_n").withColumn("_reach", F.least("_cap", F.get(near, F.col(need)))).drop("_n", "_cap", "_there")


def near_cells(targets: DataFrame, points: DataFrame, rounds: int, dims: list[str], key: str, need: str) -> DataFrame:
    """Targets with the cells (_n, of the last round) that can hold one of their ``need`` nearest other points, and _reach,
    a squared distance that none of these passes.

    ``targets`` has ``key``, ``need`` and r_<dim> of each of ``dims``; distances are relative to r.
    """
    boxes = [cut_lineage(_boxes(points, level, dims)) for level in range(1, rounds + 1)]
    front = _with_reach(targets, points, boxes, dims, need).withColumn("_n", F.lit(0).cast("long"))
    for level, box in enumerate(boxes, 1):
        met = front.withColumnRenamed("_n", "_parent").join(_few(box, level), "_parent").drop("_parent")
        front = met.where(F.col("_reach").isNull() | within_reach(_low(dims, F.col))).select(*targets.columns, "_reach", "_n")
    return front


def within_reach(square: Column) -> Column:
    """Whether a squared distance is within the reach, up to rounding."""
    return square * (1 - SAFE) <= F.col("_reach") * (1 + SAFE)
