"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a figure of a text that grows as the text gets worse. Per
stratum (language) and rule a fixed grid of cutoffs is tested from lenient
to strict on the labelled rows: n good rows, k of them at or beyond the
cutoff. A cutoff is certified if the exact binomial tail
P(Bin(n, a) <= k) <= d, where a = ``max_false_rejection`` / rules, so that all
rules of a stratum together stay within ``max_false_rejection``, and
d = ``delta`` / (strata * rules) (Bonferroni over the chains). Within a chain
the tail only grows as cutoffs tighten, so testing lenient to strict and
stopping at the first failure (fixed-sequence testing) needs no further
correction. Hence with probability 1 - ``delta`` no stratum loses more than
``max_false_rejection`` of its good texts. Of the certified cutoffs the one
with the largest (bad rejected - good rejected) is used, the most lenient of
equals; a rule without a useful certified cutoff rejects nothing.

Cases: a null text counts as empty (no word, fails the base rule); a null
language is the stratum `und`; null or absent labels don't count; a doc_id
with several labels is good only if none of them is 0; with no labels only the
base rule decides. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import documents, store

MAX_FALSE_REJECTION = 0.05
DELTA = 0.1
WINDOW = 8
GRID = [round(2.0 ** (-k / 2), 6) for k in range(15)]       # 1 down to 1/128
#: rule -> (figure, cutoffs from lenient to strict)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [4 * c for c in GRID]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", GRID),
    "repeat_words": ("n_repeat_words / n_words", GRID),
    "upper": ("n_upper / word_chars", GRID),
    "exclaims": ("n_exclaims / n_words", [4 * c for c in GRID]),
}


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Word, symbol and repetition counts of every whole text.

    Window hashes come from three doubling steps (2, 4, 8 words), each an
    element-wise pass over an array; only texts in which some window
    occurs twice sort their windows.
    """
    blank = r"[ \x09-\x0D]+"
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_t"))
    out = out.withColumn("_w", F.array_remove(F.split("_t", blank), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    out = out.select(
        "doc_id", *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.expr(r"regexp_count(_t, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("regexp_count(_t, '[A-Z]')").cast("long").alias("n_upper"),
        F.expr("regexp_count(_t, '[!?]')").cast("long").alias("n_exclaims"),
        lines.alias("_l"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h1"))
    out = out.withColumns({"n_lines": F.size("_l").cast("long"),
                           "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")}).drop("_l")
    step, have = 1, "_h1"
    while step < WINDOW:
        n = F.size(have) - step
        both = F.zip_with(F.slice(have, F.lit(1), F.greatest(n, F.lit(0))),
                          F.slice(have, F.lit(step + 1), F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        out, have, step = out.withColumn(f"_h{2 * step}", both).drop(have), f"_h{2 * step}", 2 * step
    twice = F.size(F.array_distinct(have)) < F.size(have)
    out = out.withColumn("_p", F.when(twice, F.array_sort(F.transform(have, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    out = out.drop(have)
    # places whose window hash equals a neighbour's in sorted order, back in text order
    out = out.withColumn("_p", F.array_sort(F.filter(
        F.zip_with(F.zip_with("_p", F.slice(F.col("_p"), F.lit(2), F.size("_p")),
                              lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), (a["h"] == b["h"]).alias("next"))),
                   F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("_p")),
                   lambda a, b: F.when(a["next"] | (a["h"] == b["h"]), a["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
        lambda s: s["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def _ln_factorial(x: Column) -> Column:
    y = F.greatest(x.cast("double"), F.lit(16.0))
    series = (y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y)
              - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y))
    return F.when(x < 16, F.log(F.factorial(F.least(x, F.lit(16)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, a: float) -> Column:
    """P(Bin(n, a) <= k): the k-th term from logarithms, the terms below it by their ratios.

    1 where k is at or above the mean (never of use as a bound).
    """
    n, k = n.cast("long"), k.cast("long")
    top = (_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
           + k * math.log(a) + (n - k) * math.log1p(-a))
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), k.alias("i"), n.alias("n"))

    def down(s, _):
        term = s["term"] * s["i"] * (1 - a) / ((s["n"] - s["i"] + 1) * a)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"), (s["i"] - 1).alias("i"), s["n"].alias("n"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, state, down, lambda s: s["total"])
    return F.when(k < n * a, F.least(F.exp(top + F.log(total)), F.lit(1.0))).otherwise(1.0)


def _figures(rules) -> Column:
    """Array of (rule, cutoffs reached) of a row; a rule without a figure (no words) reaches none."""
    def reached(figure: str, grid: list[float]) -> Column:
        value = F.expr(f"if(n_words > 0, {figure}, -1)")
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c <= value))

    return F.array(*[F.struct(F.lit(name).alias("rule"), reached(*rule).alias("reached"))
                     for name, rule in rules.items()])


def select_cutoffs(figures: DataFrame, labels: DataFrame, rules=RULES, alpha: float = MAX_FALSE_REJECTION,
                   delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff_no, n_good, good_rejected, bad_rejected, tail): the cutoff in force per chain.

    ``cutoff_no`` counts from 1, the strictest: a text is rejected if it reaches that many cutoffs.
    What is aggregated is one row per stratum, rule and cutoff, whatever the number of labels.
    """
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    rows = figures.join(good, "doc_id").where("not base_failed") \
        .select("stratum", "good", F.explode(_figures(rules)).alias("f")) \
        .groupBy("stratum", "f.rule", F.col("f.reached").alias("reached")) \
        .agg(F.sum(F.expr("if(good = 1, 1L, 0L)")).alias("good"), F.sum(F.expr("if(good = 1, 0L, 1L)")).alias("bad"))
    chains = rows.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good")) \
        .withColumn("strata", F.size(F.collect_set("stratum").over(Window.partitionBy(F.lit(0))))) \
        .withColumn("cutoff_no", F.explode(F.expr(
            "sequence(1, case rule " + " ".join(f"when '{r}' then {len(g)}" for r, (_, g) in rules.items()) + " end)")))
    at = rows.withColumnRenamed("reached", "cutoff_no")
    beyond = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff_no"))
    tested = chains.join(at, ["stratum", "rule", "cutoff_no"], "left") \
        .withColumn("good_rejected", F.sum(F.coalesce("good", F.lit(0))).over(beyond)) \
        .withColumn("bad_rejected", F.sum(F.coalesce("bad", F.lit(0))).over(beyond)) \
        .withColumn("tail", binomial_tail(F.col("n_good"), F.col("good_rejected"), alpha / len(rules)))
    certified = tested.where((F.col("tail") <= delta / (F.col("strata") * len(rules)))
                             & (F.col("bad_rejected") > F.col("good_rejected")))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc(F.expr("bad_rejected - good_rejected")), F.desc("cutoff_no"))
    return certified.withColumn("_r", F.row_number().over(best)).where("_r = 1") \
        .select("stratum", "rule", "cutoff_no", "n_good", "good_rejected", "bad_rejected", "tail")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stratum_col: str = "lang", rules=RULES, alpha: float = MAX_FALSE_REJECTION,
                delta: float = DELTA) -> DataFrame:
    """Figures, base verdict, `failed_rules` and `kept` for every row."""
    staged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.coalesce(F.col(stratum_col), F.lit("und")).alias("stratum"))
    figures = base_figures(staged, keep=("stratum",)).withColumn(
        "base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    figures = store(figures, "quality-figures")
    cutoffs = select_cutoffs(figures, labels, rules, alpha, delta) \
        .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff_no"))).alias("_cut"))
    failed = F.transform(F.filter(_figures(rules), lambda f: f["reached"] >= F.element_at(F.col("_cut"), f["rule"])),
                         lambda f: f["rule"])
    return figures.join(cutoffs, "stratum", "left") \
        .withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>"))) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cut")


def op4(spark, sf_dir: str) -> DataFrame:
    """Base counts and risk-controlled verdict of every document."""
    out = apply_rules(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _oracle(rules=RULES, alpha: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> str:
    reached = " union all ".join(
        f"select r, doc_id, stratum, base_failed, {i} as o, '{name}' as rule, {len(grid)} as cutoffs, "
        f"len(list_filter([{', '.join(f'cast({c!r} as double)' for c in grid)}], "
        f"lambda c: c <= (case when n_words > 0 then ({figure}) else -1 end))) as reached from f"
        for i, (name, (figure, grid)) in enumerate(rules.items()))
    a = f"cast({alpha / len(rules)!r} as double)"
    return rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) as lines from documents),
win as (select r, unnest(range(0, len(w) - {WINDOW - 1})) as i,
               unnest(list_transform(range(0, len(w) - {WINDOW - 1}), lambda i: array_to_string(w[i + 1:i + {WINDOW}], ' '))) as s
        from d where len(w) >= {WINDOW}),
twice as (select r, i from (select r, i, count(*) over (partition by r, s) as n from win) where n > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from twice) group by r),
g as (
  select r, doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(regexp_extract_all(t, '[A-Z]'))::bigint as n_upper,
         len(regexp_extract_all(t, '[!?]'))::bigint as n_exclaims, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d left join rep using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from g),
reach as ({reached}),
good as (select doc_id, min(quality) as good from labels where quality is not null group by doc_id),
bins as (
  select stratum, rule, cutoffs, reached, count(*) filter (good = 1) as good, count(*) filter (good <> 1) as bad
  from reach join good using (doc_id) where not base_failed group by all),
chains as (select stratum, rule, cutoffs, sum(good)::bigint as n_good from bins group by all),
tested as (
  select c.stratum, c.rule, c.n_good, j as cutoff_no, sum(coalesce(b.good, 0))::bigint as k, sum(coalesce(b.bad, 0))::bigint as bad
  from (select *, unnest(range(1, cutoffs + 1)) as j from chains) c
  left join bins b on b.stratum = c.stratum and b.rule = c.rule and b.reached >= j group by all),
tails as (
  select *, case when k >= n_good * {a} then 1.0 else (
           select sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({a}) + (n_good - i) * ln(1 - {a})))
           from (select unnest(range(0, k + 1)) as i)) end as tail from tested),
best as (
  select stratum, rule, cutoff_no, row_number() over (partition by stratum, rule order by bad - k desc, cutoff_no desc) as o
  from tails where bad > k and tail <= {delta!r} / ((select count(distinct stratum) from chains) * {len(rules)})),
failed as (
  select r, string_agg(x.rule, ',' order by x.o) as rules
  from reach x join best on best.o = 1 and best.stratum = x.stratum and best.rule = x.rule and x.reached >= best.cutoff_no
  group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and failed.rules is null as kept, coalesce(failed.rules, '') as failed_rules
from f left join failed using (r)
"""


ORACLE_OP4 = _oracle()
