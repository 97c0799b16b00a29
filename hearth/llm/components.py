"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, release, store

#: A node with more than this share of a partition's rows is a hub.
HUB_SHARE = 4


def _with_least(sides: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``sides`` (a, b) with the minimum m of each a's neighbourhood.

    Nodes with over n / (HUB_SHARE * partitions) of the ``n`` rows are hubs: at most
    HUB_SHARE * partitions of them, so that their list may be broadcast. A hub's rows are dealt over as many
    salts as they are that many rows, and its minimum is repeated for each.
    """
    limit = max(16, n // (HUB_SHARE * partitions(sides.sparkSession)))
    hubs = least.where(F.col("n") > limit).select("a", F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    salted = sides.join(F.broadcast(hubs), "a", "left") \
        .select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    salts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / limit).cast("int"), F.lit(1)) - 1)
    dealt = least.select("a", "m", F.explode(F.when(F.col("n") > limit, salts).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(dealt, ["a", "salt"])


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Hang neighbours on the smallest node of each neighbourhood; ``n`` is at least the number of edges.

    Large star moves the larger neighbours of a node, small star the smaller
    ones and the node itself. The minimum is an aggregate with a map-side part.
    """
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count("*").alias("n"))
    joined = _with_least(sides, least, 2 * n if large else n)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.where("a <> m").select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a long, b long); root is the component's smallest node.

    Each round is written to the shared folder; rounds stop when the edges
    (all hanging on roots by then) no longer change.
    """
    edges = store(edges.where("a <> b").distinct(), name)
    release(edges.sparkSession)          # what the edges were found by may be large
    mark, n = None, edges.count()
    while True:
        # a star gives at most one edge per row it reads, so n bounds both rounds
        edges = store(_star(_star(edges, True, n), False, n), name)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark, n = now, now["n"]
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
