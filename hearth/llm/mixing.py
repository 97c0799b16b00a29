"""Temperature mixing of sources, in DataFrame functions only.

Source s with token share p_s gets weight w_s = p_s^a / sum(p^a). The
exponent a in [0, 1] (1: as they are, 0: all alike) is bisected: the flattest
mix in which no source repeats more than ``max_repeats`` times, or the least
flat one whose entropy reaches ``target_entropy`` (a share of the largest
possible); with both, the repetition limit wins. A budget of B tokens then
gives source s floor(B * w_s) tokens: whole passes over its documents, and one
partial pass cut to the budget.

Documents of a source are in random order by a seeded hash; the order is cut
into blocks of about ``block_tokens`` (at most ``max_blocks`` a source), so the
running sums that cut the partial pass are windows over a source's blocks and
over one block's documents, never over a whole source. Each pass visits the
blocks in an order of its own (``order_key``).

The covering mix (``cover``) takes, for each exponent, the smallest budget with
which the largest source is read once; every source gets its whole passes and
its partial one, so a document has at least one copy.

Cases: a null source is a source of its own; null and empty texts have one
token (the end); repeated rows are separate documents; one source gets the
whole budget; an empty table gives no rows; a budget above ``max_repeats``
times all tokens can't be met, the mix then stays proportional (a = 1).
Columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import POS, with_positions
from .common import documents, store

MAX_REPEATS = 4.0
BLOCK_TOKENS = 16_384
MAX_BLOCKS = 4096
SEED = "mix-1"
STEPS = 50
TOKENS = r"regexp_count(coalesce(_text, ''), '[^\\x20\\x09-\\x0D]+') + 1"


def _bisect(holds) -> Column:
    """The end of [0, 1] next to which ``holds(a)`` turns true, after STEPS halvings of (lo, hi]."""
    state = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        ok = holds(mid)
        return F.struct(F.when(ok, s["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, halve, lambda s: s["hi"])


def mixing_weights(shares: DataFrame, budget: Column | None = None, max_repeats: float | None = MAX_REPEATS,
                   target_entropy: float | None = None, cover: bool = False) -> DataFrame:
    """(source, tokens) -> source, tokens, exponent, weight, budget, passes, rest.

    ``budget``: a column over one row with `total` (all tokens) and `t`
    (tokens by source); by default all tokens. One row holds all sources.
    ``cover``: the smallest budget with which every source is read once, in
    place of ``budget``.
    """
    if cover and budget is not None:
        raise ValueError("cover sets the budget itself")
    one = shares.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("k"), "source",
                                                          F.col("tokens")))).alias("s"))
    one = one.withColumn("t", F.transform("s", lambda x: x["tokens"].cast("double")))
    one = one.withColumn("total", F.aggregate("t", F.lit(0.0), lambda a, b: a + b))
    if not cover:
        one = one.withColumn("b", (budget if budget is not None else F.col("total")).cast("double"))
    add = lambda a, b: a + b

    def norm(a):
        return F.aggregate(F.transform("t", lambda x: F.pow(x / F.col("total"), a)), F.lit(0.0), add)

    def repeats_ok(a):
        most = F.array_max(F.transform("t", lambda x: F.pow(x / F.col("total"), a) / x))
        return (covering(a) if cover else F.col("b")) * most <= max_repeats * norm(a)

    def covering(a):
        return F.array_max(F.transform("t", lambda x: x / F.pow(x / F.col("total"), a))) * norm(a)

    def entropy(a):
        z = norm(a)
        parts = F.transform("t", lambda x: F.pow(x / F.col("total"), a) * a * F.log(x / F.col("total")))
        return F.log(z) - F.aggregate(parts, F.lit(0.0), add) / z

    limits = []
    if max_repeats is not None:
        limits.append(F.when(repeats_ok(F.lit(0.0)), 0.0).otherwise(_bisect(repeats_ok)))
    if target_entropy is not None:
        goal = target_entropy * F.log(F.size("t").cast("double"))
        limits.append(F.when(entropy(F.lit(1.0)) >= goal, 1.0)
                      .otherwise(1 - _bisect(lambda c: entropy(1 - c) >= goal)))
    a = limits[0] if len(limits) == 1 else F.greatest(*limits) if limits else F.lit(1.0)
    one = one.withColumn("exponent", F.round(a, 9)).withColumn("z", norm(F.col("exponent")))
    if cover:
        one = one.withColumn("b", covering(F.col("exponent")))
    out = one.select("exponent", "b", "z", "total", F.explode("s").alias("x")).select(
        F.col("x.source").alias("source"), F.col("x.tokens").alias("tokens"), "exponent",
        (F.pow(F.col("x.tokens") / F.col("total"), F.col("exponent")) / F.col("z")).alias("weight"), "b")
    out = out.withColumn("budget", F.floor(F.round(F.col("b") * F.col("weight"), 3)).cast("long"))
    if cover:          # rounding drops no document and repeats none too often
        out = out.withColumn("budget", F.greatest("budget", "tokens"))
        if max_repeats is not None:
            out = out.withColumn("budget", F.least("budget", F.floor(F.col("tokens") * max_repeats).cast("long")))
    return out.select("source", "tokens", "exponent", "weight", "budget",
                      F.expr("budget div tokens").alias("passes"), F.expr("budget % tokens").alias("rest"))


def place(id_col: str, seed: str = SEED) -> Column:
    """Where a document stands in its source's order: 32 bits of a seeded md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                keep: tuple[str, ...] = (), seed: str = SEED, block_tokens: int = BLOCK_TOKENS,
                max_blocks: int = MAX_BLOCKS, cover: bool = False, **limits) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight, exponent, block, copies (0: not drawn), ``keep``.

    ``cover``: take the smallest budget with which every source is seen at
    least once, so the mix only repeats documents and drops none.
    ``limits``: budget, max_repeats, target_entropy of ``mixing_weights``.
    With ``keep`` (texts, say) the running sums are made without those
    columns, and each source's last drawn document is looked up.
    """
    staged = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *keep,
                         F.col(text_col).alias("_text")).withColumn("n_tokens", F.expr(TOKENS).cast("long"))
    if text_col not in keep:
        staged = staged.drop("_text")
    shares = staged.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = mixing_weights(shares, cover=cover, **limits)
    weights = weights.withColumn(
        "n_blocks", F.least(F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)), F.lit(max_blocks)))
    placed = staged.withColumn("_u", place("doc_id", seed)) \
        .join(F.broadcast(weights.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s") \
        .withColumn("block", F.floor(F.col("_u") * F.col("n_blocks") / (1 << 32)).cast("int")) \
        .withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")))
    narrow = placed.drop(*[c for c in (*keep, "_text") if c not in ("doc_id", "source")]) if keep else placed
    blocks = narrow.groupBy("_k", "block").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("_k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    # equal ids of a source are drawn together, as in SQL's default frame
    inside = Window.partitionBy("_k", "block").orderBy("_u", "doc_id").rangeBetween(Window.unboundedPreceding, 0)
    summed = narrow.join(blocks, ["_k", "block"]) \
        .withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    again = F.col("_upto") <= F.col("rest")
    if keep:
        at = F.struct("block", "_u", "doc_id")
        last = summed.where(again).groupBy("_k").agg(F.max(at).alias("_last"))
        summed = placed.join(F.broadcast(last), "_k", "left")
        again = F.coalesce(at <= F.col("_last"), F.lit(False))
    return summed.withColumn("copies", F.col("passes") + again.cast("long")) \
        .select("doc_id", "source", *keep, "n_tokens", "exponent", "weight", "block", "copies")


def realise(drawn: DataFrame, seed: str = SEED) -> DataFrame:
    """Copies as rows with `epoch` and `order_key`: sorting by it visits every source's blocks in random turns."""
    return drawn.where("copies > 0").withColumn("epoch", F.explode(F.expr("sequence(1L, copies)"))) \
        .withColumn("order_key", F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce("source", F.lit("")), "block")))


def in_order(realised: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows sorted as they are to be visited: blocks by ``order_key``, a block's documents in their source's order."""
    return realised.orderBy("order_key", place("doc_id", seed), "doc_id")


def positioned(realised: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds `position`, the row's number (from 0) in the order of ``in_order``; rows repeated with one id in any order."""
    return with_positions(realised.withColumn("_u", place("doc_id", seed)), ["order_key", "_u", "doc_id"]) \
        .drop("_u").withColumnRenamed(POS, "position")


def op10(spark, sf_dir: str) -> DataFrame:
    """The draw of the flattest mix of as many tokens that repeats no source over 4 times: one row per copy."""
    out = mix_sources(documents(spark, sf_dir))
    out = out.select("doc_id", "source", "n_tokens", F.round("exponent", 6).alias("exponent"),
                     F.round("weight", 9).alias("weight"), "block", "copies")
    return positioned(store(realise(out), "mix-draw"))


ORACLE_OP10 = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 as n_tokens,
         ('0x' || substr(md5('mix-1|' || doc_id), 1, 8))::ubigint::bigint as u from documents),
s as (select source, sum(n_tokens)::bigint as t from d group by source),
tot as (select sum(t)::double as total from s),
bis as (
  select 0 as i, 0.0::double as lo, 1.0::double as hi
  union all
  select i + 1, case when ok then lo else (lo + hi) / 2 end, case when ok then (lo + hi) / 2 else hi end
  from (select i, lo, hi, (select any_value(total) * max(pow(t / total, (lo + hi) / 2) / t) <= 4.0 * sum(pow(t / total, (lo + hi) / 2))
                           from s, tot) as ok from bis where i < 50)),
ex as (select round(case when (select any_value(total) * max(1.0 / t) <= 4.0 * count(*) from s, tot) then 0.0
              else (select hi from bis where i = 50) end, 9) as a),
z as (select sum(pow(t / total, a)) as z from s, tot, ex),
w as (select source, t, a, pow(t / total, a) / z as weight,
             floor(round(total * (pow(t / total, a) / z), 3))::bigint as budget,
             least(greatest(ceil(t / 16384.0), 1), 4096)::bigint as nb from s, tot, ex, z),
p as (select d.*, w.a, w.weight, budget // t as passes, budget % t as rest,
             floor(u * nb / 4294967296.0)::int as block from d join w using (source)),
q as (select *, sum(n_tokens) over (partition by source order by u, doc_id) as upto from p),
c as (select doc_id, source, n_tokens::bigint as n_tokens, round(a, 6) as exponent, round(weight, 9) as weight, block, u,
             (passes + (upto <= rest)::bigint)::bigint as copies from q),
r as (select *, unnest(range(1, copies + 1)) as epoch from c),
k as (select *, md5(concat_ws('|', 'mix-1', epoch, coalesce(source, ''), block)) as order_key from r)
select doc_id, source, n_tokens, exponent, weight, block, copies, epoch, order_key,
       row_number() over (order by order_key, u, doc_id) - 1 as position from k
"""
