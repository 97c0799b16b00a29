"""Exact percentiles without gathering a column's distinct values in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer. Here
each wanted rank is closed in between two values first: mergeable sketches of bounded size give
a narrow interval around it, an exact count says how many values lie below and inside, and the
step is repeated inside the interval until it holds at most ``limit`` values. Only those are
grouped and ordered. Intervals whose counts show that the sketch missed the rank are widened, so
the result does not depend on the sketch's error. Each step is one pass for all columns.

Nulls do not count; a column without values has no percentiles (None). Values that repeat are
counted, not listed, so an interval of one value is done however often it occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 100_000
ACCURACY = 10_000
#: Half the width, in ranks, of the interval asked of a sketch.
MARGIN = 3.0 / ACCURACY


def _inside(mark: dict):
    c, cond = F.col(mark["column"]), F.col(mark["column"]).isNotNull()
    if mark["lo"] is not None:
        cond = cond & (c >= mark["lo"])
    if mark["hi"] is not None:
        cond = cond & (c <= mark["hi"])
    return F.when(cond, c)


def _sketch(df: DataFrame, marks: list[dict], margin: float, accuracy: int) -> list[tuple]:
    """Values next to the wanted ranks of each mark, inside its interval."""
    aggs = []
    for m in marks:
        at = [(m["rank"] - m["below"]) / max(1, m["inside"] - 1), (m["next"] - m["below"]) / max(1, m["inside"] - 1)]
        around = [max(0.0, at[0] - margin), min(1.0, at[1] + margin)]
        aggs.append(F.percentile_approx(_inside(m), F.array(*map(F.lit, around)), accuracy))
    return [tuple(x) for x in df.agg(*[a.alias(f"m{i}") for i, a in enumerate(aggs)]).first()]


def _narrow(df: DataFrame, marks: list[dict], accuracy: int) -> None:
    """One narrowing of every mark; a mark whose interval can't be narrowed is single-valued."""
    margin, todo = 3.0 / accuracy, marks
    while todo:
        found = _sketch(df, todo, margin, accuracy)
        tried = [dict(m, lo=lo, hi=hi) for m, (lo, hi) in zip(todo, found)]
        counts = df.agg(*[F.count(F.when(F.col(m["column"]) < m["lo"], 1)) for m in tried],
                        *[F.count(_inside(m)) for m in tried]).first()
        again = []
        for i, (m, t) in enumerate(zip(todo, tried)):
            below, inside = counts[i], counts[len(tried) + i]
            if below <= m["rank"] and m["next"] < below + inside:
                m.update(lo=t["lo"], hi=t["hi"], below=below, inside=inside)
            else:
                again.append(m)
        todo, margin = again, margin * 4


def exact_percentiles(df: DataFrame, wanted: dict[str, list[float]], limit: int = LIMIT,
                      accuracy: int = ACCURACY) -> dict[tuple[str, float], float | None]:
    """{(column, p): value}, equal to ``percentile(column, p)`` (interpolated between neighbours)."""
    df = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    sizes = df.agg(*[F.count(c).alias(c) for c in wanted]).first().asDict()
    marks = []
    for c, shares in wanted.items():
        for p in shares if sizes[c] else ():
            at = (sizes[c] - 1) * p
            marks.append({"column": c, "p": p, "at": at, "rank": math.floor(at), "next": math.ceil(at),
                          "below": 0, "inside": sizes[c], "lo": None, "hi": None})
    while wide := [m for m in marks if m["inside"] > limit and (m["lo"] is None or m["lo"] != m["hi"])]:
        held = [m["inside"] for m in wide]
        _narrow(df, wide, accuracy)
        if held == [m["inside"] for m in wide]:      # values that no sketch parts: group them as they are
            break
    out: dict[tuple[str, float], float | None] = {(c, p): None for c, shares in wanted.items() for p in shares}
    if not marks:
        return out
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _inside(m).alias("v")) for i, m in enumerate(marks)]))
                     .alias("x")).select("x.i", "x.v").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    # at most ``limit`` rows a mark
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    need = F.array(*[F.lit(m["rank"] - m["below"]) for m in marks])
    after = F.array(*[F.lit(m["next"] - m["below"]) for m in marks])
    found = rows.withColumn("_upto", upto).groupBy("i").agg(
        F.min(F.when(F.col("_upto") > F.get(need, F.col("i")), F.col("v"))).alias("a"),
        F.min(F.when(F.col("_upto") > F.get(after, F.col("i")), F.col("v"))).alias("b")).collect()
    for r in found:
        m = marks[r["i"]]
        a, b = r["a"], r["b"]
        out[m["column"], m["p"]] = a if a == b else (m["next"] - m["at"]) * a + (m["at"] - m["rank"]) * b
    return out
