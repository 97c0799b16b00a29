"""The mixing draw: one row per copy, numbered block by block in the order of the keys."""

from pyspark.sql import functions as F

from hearth.llm import mixing


def test_positions_follow_the_order_keys(spark):
    docs = spark.range(500).select((F.col("id")).alias("doc_id"), F.when(F.col("id") % 9 > 0, F.lit("big")).otherwise(F.lit("small"))
                                   .alias("source"), F.lit("one two three").alias("text"))
    drawn = mixing.mix_sources(docs, block_tokens=100)
    copies = drawn.agg(F.sum("copies")).first()[0]
    rows = mixing.positioned(mixing.realise(drawn)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(copies))
    at = [(r.order_key, r.doc_id) for r in mixing.in_order(mixing.realise(drawn)).collect()]
    assert [(r.order_key, r.doc_id) for r in rows] == at
    # a block's copies stand together, and each epoch has an order of its own
    runs = [k for i, k in enumerate(r.order_key for r in rows) if i == 0 or rows[i - 1].order_key != k]
    assert len(runs) == len(set(runs)) == len({(r.epoch, r.source, r.block) for r in rows})
    first, second = ([r.block for r in rows if r.source == "small" and r.epoch == e] for e in (1, 2))
    assert sorted(set(second)) == sorted(set(first)) and list(dict.fromkeys(first)) != list(dict.fromkeys(second))
    assert mixing.positioned(mixing.realise(drawn.where("false"))).count() == 0
