"""Benchmark decontamination, in DataFrame functions only.

Every run of ``n`` words of a benchmark item is a window (an item of fewer
words is one window of its own). The windows' 64-bit hashes are a broadcast
hash set; each document makes the hashes of its own windows by doubling (words,
pairs, fours, eights, joined to any length), one row per window is looked up in
the set, and a hit is verified by comparing the words themselves. Words inside
a verified window are hit; hit words next to each other are a span, and
``decontaminate`` removes spans from texts or whole documents.

The set's size is measured before it is broadcast: beyond ``set_bytes`` it is
dealt by hash into blocks of that size and the documents are scanned once per
block. Documents are never shuffled, however many share a passage: only their
counts and hits are, by document.

Cases: null and empty texts have no words and no hits; a null or empty item has
no window; items repeated with one id are one item, and rows without an item_id
mark words but count as no item; rows repeated with one doc_id and text stay and
have equal results; an empty benchmark leaves every document clean; an empty
table gives none. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import documents, store

WINDOW = 10
SET_BYTES = 64 << 20
#: Rough size of a window's row in the broadcast table besides its text and items.
ROW_BYTES = 96
OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In front of a document's hashes, so that each document gives one row without a hit.
MARK = 0x5EED


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; `lower` does the same on ASCII texts and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"[^{OTHER}]+"), 0)


def with_hashes(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Add `_h<m>` for each length m: at i the hash of the m words from i (garbage past the last window)."""
    keep = list(df.columns)
    df = df.withColumn("_p1", F.transform(words, lambda w: F.xxhash64(w)))

    def join(left: str, right: str, shift: int) -> Column:
        later = F.slice(right, F.lit(shift + 1), F.greatest(F.size(right) - shift, F.lit(0)))
        return F.zip_with(left, later, lambda x, y: F.xxhash64(x, y))

    power = 1
    while 2 * power <= max(lengths, default=1):
        df = df.withColumn(f"_p{2 * power}", join(f"_p{power}", f"_p{power}", power))
        power *= 2
    for m in lengths:
        parts = [1 << b for b in range(m.bit_length() - 1, -1, -1) if m >> b & 1]
        df, done = df.withColumn(f"_h{m}", F.col(f"_p{parts[0]}")), parts[0]
        for p in parts[1:]:
            df, done = df.withColumn(f"_h{m}", join(f"_h{m}", f"_p{p}", done)), done + p
    return df.select(*keep, *[f"_h{m}" for m in lengths])


def benchmark_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, m, window (its words, space-joined), items (ids of the items that hold it)."""
    worded = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("_w")) \
        .withColumn("m", F.least(F.size("_w"), F.lit(n))).where("m > 0")
    lengths = sorted(r["m"] for r in worded.select("m").distinct().collect())       # at most n values
    parts = []
    for m in lengths or [n]:
        at = F.sequence(F.lit(1), F.size("_w") - m + 1)
        rows = with_hashes(worded.where(F.col("m") == m), "_w", [m]).select(
            "item_id", "m", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("_w", i, m), " "))), f"_h{m}")
        parts.append(rows.select(F.get(f"_h{m}", F.col("pos")).alias("hash"), "m", F.col("col").alias("window"), "item_id"))
    return reduce(DataFrame.unionByName, parts).groupBy("hash", "m", "window").agg(F.collect_set("item_id").alias("items"))


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 set_bytes: int = SET_BYTES) -> DataFrame:
    """_id, _row, doc_id, n_words, and per verified hit start (from 0), m, items; one row per document has null start.

    (_id, _row) names a document: its id as text ('' for none) and a hash of id and text.
    """
    size = windows.agg(F.sum(F.octet_length("window") + ROW_BYTES + 16 * F.size("items")).alias("b")).first()["b"] or 0
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())      # at most n values
    blocks = max(1, ceil(size / set_bytes))
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("_row"),
                        words_of(F.col(text_col)).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))
    hashed = with_hashes(split, "_w", lengths)
    all_hashes = F.concat(F.array(F.lit(MARK).cast("long")), *[f"_h{m}" for m in lengths])
    exploded = hashed.select("doc_id", "_row", "n_words", "_w", F.posexplode(all_hashes).alias("_pos", "hash"))
    mark = docs.sparkSession.range(1).select(F.lit(MARK).cast("long").alias("hash"), F.lit(0).alias("m"),
                                             F.lit(None).cast("string").alias("window"),
                                             F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    kind = F.element_at(F.array(*[F.lit(m) for m in lengths]), (F.expr("(_pos - 1) div n_words") + 1).cast("int")) \
        if lengths else F.lit(0)
    start = F.expr("(_pos - 1) % n_words").cast("int")
    found = []
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == b)
        # at most set_bytes, measured above
        hits = exploded.join(F.broadcast(block.unionByName(mark)), "hash")
        hits = hits.where(F.when(F.col("_pos") == 0, F.col("window").isNull())
                          .otherwise((F.col("m") == kind)
                                     & (F.array_join(F.slice("_w", start + 1, F.col("m")), " ") == F.col("window"))))
        hits = hits.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "_row", "doc_id", "n_words",
                           F.when(F.col("_pos") > 0, start).alias("start"), "m", "items")
        found.append(hits if b == 0 else hits.where("start is not null"))
    return store(reduce(DataFrame.unionByName, found), "decontam-hits")


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per document: _id, _row, doc_id, n_words, n_hit, spans (start, end in words), items (sorted ids)."""
    windows = store(benchmark_windows(items, n, item_col, item_text_col), "decontam-windows")
    found = find_windows(docs, windows, id_col, text_col, set_bytes)
    key = ["_id", "_row"]
    hits = found.where("start is not null").select(*key, "start", (F.col("start") + F.col("m")).alias("end")).distinct()
    by_start = Window.partitionBy(*key).orderBy("start", "end")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")) \
        .withColumn("_span", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = hits.groupBy(*key, "_span").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
                           F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    held = found.where("start is not null").select(*key, F.explode("items").alias("item")).distinct() \
        .groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = found.where("start is null").select(*key, "doc_id", "n_words")
    return rows.join(spans, key, "left").join(held, key, "left").select(
        *key, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast(held.schema["items"].dataType)).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit spans cut out of the text.

    A span goes from the marks before its first word to the end of its last word.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    marks = contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0") \
        .select("_id", "_row", F.col("n_words").alias("_n"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_row"])
    columns = list(docs.columns)
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                        F.xxhash64(id_col, text_col).alias("_row"))
    if remove == "documents":
        return keyed.join(marks, ["_id", "_row"], "left_anti").select(*columns)
    joined = keyed.join(marks, ["_id", "_row"], "left") \
        .withColumn("_pieces", F.when(F.col("_spans").isNotNull(),
                                      F.regexp_extract_all(F.col(text_col), F.lit(f"[{OTHER}]*[^{OTHER}]+"), 0)))
    ends = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end"]))
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.col("_n").cast("int")))
    rest = F.array_join(F.zip_with(ends, starts, lambda e, s: F.array_join(F.slice("_pieces", e + 1, s - e), "")), "")
    tail = F.expr(f"substring(`{text_col}`, length(array_join(_pieces, '')) + 1)")
    cut = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.concat(rest, tail))
    return joined.withColumn("_cut", cut).select(*[F.col("_cut").alias(c) if c == text_col else c for c in columns])


def op12(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document: hit words, items, and whether there are any."""
    got = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP12 = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bm as (select item_id, w, least(len(w), 10) as m from b where len(w) > 0),
win as (select distinct item_id, m, unnest(list_transform(range(0, len(w) - m + 1), lambda i: array_to_string(w[i + 1:i + m], ' '))) as t
        from bm),
dm as (select r, w, m from d, (select distinct m from win) where len(w) >= m),
dw as (select r, m, unnest(range(0, len(w) - m + 1)) as i,
              unnest(list_transform(range(0, len(w) - m + 1), lambda i: array_to_string(w[i + 1:i + m], ' '))) as t from dm),
hits as (select dw.r, dw.i, dw.m, win.item_id from dw join win on dw.m = win.m and dw.t = win.t),
hit_words as (select r, count(distinct p) as n from (select r, unnest(range(i, i + m)) as p from hits) group by r),
held as (select r, count(*) as n, string_agg(id, ',' order by id) as ids
         from (select distinct r, item_id::varchar as id from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hit_words.n, 0)::bigint as n_hit, coalesce(held.n, 0)::bigint as n_items,
       sha256(coalesce(held.ids, '')) as items_sha256, coalesce(hit_words.n, 0) > 0 as contaminated
from d left join hit_words using (r) left join held using (r)
"""
