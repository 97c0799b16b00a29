"""Global positions in a total order, and joins on position bands.

``with_positions`` numbers rows 0..n-1 in a total order without a
single-partition window: rows are range-partitioned (Spark samples the
boundaries, so one hot key value is spread by the unique tie-break
column), sorted inside each partition, tagged with per-partition ids, and
shifted by a prefix sum of the partition sizes. The prefix-sum table has
one row per partition, so broadcasting it is size-bounded by the partition
count. The tagged rows are checkpointed to the shared checkpoint folder so
that a recomputation after an executor loss cannot renumber them.

``band_join`` pairs each probe row with the rows whose position lies
within a radius, by exploding the probe into the (at most three) position
blocks the band overlaps and equi-joining on the block id. Output per
probe is bounded by about three blocks, whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

POS = "_pos"


def with_positions(df: DataFrame, order_cols, partitions: int | None = None,
                   checkpoint: bool = True) -> DataFrame:
    """Add ``_pos``: the row's 0-based rank in ``order_cols`` (which must
    end with a unique tie-break so the order is total)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(df.columns)
    tagged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        tagged = cut_lineage(tagged)
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
                    .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .select(*cols, (F.col("_off") + F.col("_local")).alias(POS)))


def band_join(probe: DataFrame, build: DataFrame, probe_pos: str, build_pos: str,
              lo_offset, hi_offset, block: int) -> DataFrame:
    """Pairs with ``probe_pos + lo_offset <= build_pos <= probe_pos + hi_offset``.

    ``block`` should be about the band width so each probe touches at most
    three blocks. Column names of the two sides must not collide.
    """
    lo = F.col(probe_pos) + (lo_offset if isinstance(lo_offset, Column) else F.lit(lo_offset))
    hi = F.col(probe_pos) + (hi_offset if isinstance(hi_offset, Column) else F.lit(hi_offset))
    p = probe.withColumn("_blk", F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))))
    b = build.withColumn("_blk", F.floor(F.col(build_pos) / block))
    return (p.join(b, "_blk")
             .where((F.col(build_pos) >= lo) & (F.col(build_pos) <= hi))
             .drop("_blk"))


def merged_positions(markers: DataFrame, items: DataFrame, marker_key: str, item_key: str,
                     marker_tie: str, item_tie: str, descending: bool = False,
                     marker_first: bool = True, partitions: int | None = None):
    """One pass that numbers ``items`` in (key, tie) order and tells each
    marker where it falls in that order.

    Markers and items are merged into one range-partitioned, sorted
    sequence ordered by (key, kind, tie), markers before items of equal key
    when ``marker_first``. Inside each range partition a running count of
    item rows (a window over the partition's own rows, one balanced group
    per partition) plus the item totals of the earlier partitions (one row
    per partition, broadcast) gives every row the number of items before
    it: an item's position, or a marker's scan start.

    Returns (items + ``_pos``, markers + ``_start``).
    """
    spark = items.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind_m, kind_i = (0, 1) if marker_first else (1, 0)
    m = markers.select("*", F.col(marker_key).alias("_key"), F.lit(kind_m).alias("_kind"),
                       F.col(marker_tie).cast("string").alias("_tie"))
    i = items.select("*", F.col(item_key).alias("_key"), F.lit(kind_i).alias("_kind"),
                     F.col(item_tie).cast("string").alias("_tie"))
    k = F.col("_key").desc() if descending else F.col("_key").asc()
    order = [k, F.col("_kind").asc(), F.col("_tie").asc()]
    tagged = cut_lineage(m.unionByName(i, allowMissingColumns=True)
                         .repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
                    .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
                    .withColumn("_item", (F.col("_kind") == kind_i).cast("long")))
    inside = Window.partitionBy("_pid").orderBy("_local") \
        .rowsBetween(Window.unboundedPreceding, -1)
    tagged = tagged.withColumn("_before", F.coalesce(F.sum("_item").over(inside), F.lit(0)))
    counts = tagged.groupBy("_pid").agg(F.sum("_item").alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    res = cut_lineage(tagged.join(F.broadcast(offsets), "_pid")
                            .withColumn("_p", F.col("_off") + F.col("_before")))
    items_out = res.where(F.col("_kind") == kind_i).select(*items.columns, F.col("_p").alias(POS))
    markers_out = res.where(F.col("_kind") == kind_m).select(*markers.columns,
                                                             F.col("_p").alias("_start"))
    return items_out, markers_out


def insertion_points(markers: DataFrame, items: DataFrame, key: str, tie: str,
                     descending: bool = False, marker_first: bool = True,
                     item_tie: str | None = None) -> DataFrame:
    """For each marker (identified by ``tie``), the number of ``items``
    that precede it in the items' order on ``key`` (``_start``)."""
    _, marks = merged_positions(markers.select(tie, key), items.select(item_tie or tie, key),
                                key, key, tie, item_tie or tie, descending, marker_first)
    return marks.select(F.col(tie).cast("string").alias(tie), "_start")
