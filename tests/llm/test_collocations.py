"""Collocations against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from hearth.llm import collocations
from hearth.llm.collocations import Bits, gram_codes

DOCS = "doc_id long, text string, lang string, phrase string, n long, w1 string"


def _rows(n_docs=150, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["É", "\x00x", "a-b", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    phrases = [" ".join(rng.choices(vocab + ["Rare", "odd", "Pair", "four"], k=rng.randint(2, 6))) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 30)):
            words.append(rng.choice(phrases) if rng.random() < 0.3 else rng.choices(vocab, weights)[0])
            words.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! ", "\r\x0b"]))
        rows.append((i, "".join(words), rng.choice(["en", "en", "de", None, "und", "x"])))
    rows += [(900, None, "en"), (901, "", None), (902, " .,", "zz"), (903, "a b " * 4000, "en"), (5, rows[5][1], rows[5][2])]
    return rows


def _brute(rows, top=2000, least=30):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    dropped = set()
    for (lang, *z), b in cand.items():
        for m in range(2, len(z)):
            for i in range(len(z) - m + 1):
                x = (lang, *z[i:i + m])
                if 100 * b >= 80 * cand[x]:
                    dropped.add(x)
    for x, a in cand.items():
        if x not in dropped:
            lang, *w = x
            cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, rank, p.decode(), -a, left, r, total[lang], -s)
                  for lang, found in out.items() for rank, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1))


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("top, least, levels", [(2000, 30, None), (8, 5, {"en": 400_000, "de": 800_000, "x": 700}), (3, 2, None)])
def test_against_brute_force(spark, monkeypatch, top, least, levels):
    rows = _rows(1500 if least == 30 else 150)
    docs = _frame(spark, rows)
    monkeypatch.setattr(collocations, "documents", lambda s, d: docs)
    monkeypatch.setattr(collocations, "CHUNK", 1000)
    monkeypatch.setattr(collocations, "HELD_WORDS", 20)
    got = collocations.op11(spark, "") if top == 2000 else \
        collocations.collocations(docs, top=top, min_count=least, levels=levels)
    want = _brute(rows, top, least)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 8


def test_a_frontier_taken_in_batches_gives_the_same(spark):
    """Every starting level, so that bounds, late batches and late extensions all decide."""
    rows = _rows(80, 7)
    docs = _frame(spark, rows)
    want = _brute(rows, 12, 4)
    for level in (800_000, 100_000, 3_000):
        got = collocations.collocations(docs, top=12, min_count=4, levels={x: level for x in ("en", "de", "x", "und")})
        assert sorted(map(tuple, got.collect())) == want


def test_a_saturated_filter_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 15)
    rows = _rows(60, 9)
    got = collocations.collocations(_frame(spark, rows), top=10, min_count=3, levels={"en": 200_000})
    assert sorted(map(tuple, got.collect())) == _brute(rows, 10, 3)


def test_empty_and_short_tables(spark):
    assert collocations.collocations(_frame(spark, [])).collect() == []
    assert collocations.collocations(_frame(spark, [(1, None, "en"), (2, "a b", None), (3, "", None)]), min_count=2).collect() == []


def test_bitmaps_match_their_rows(spark):
    rng = np.random.default_rng(0)
    rows = rng.integers(-2**63, 2**63 - 1, (500, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rows], "w1 long, w2 long")
    from pyspark.sql import functions as F
    got = collocations.bitmaps(df, 2, {"all": F.lit(True), "half": F.col("w1") > 0})
    codes = gram_codes([rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64)])
    assert got["all"](codes).all() and got["half"](codes[rows[:, 0] > 0]).all()
    assert np.unpackbits(got["all"].bits).sum() == len(np.unique(codes >> np.uint64(64 - collocations.FILTER_BITS)))
    assert not Bits(20)(codes).any()


def test_counts_are_shuffled_as_tasks_combined_them(spark):
    stream = spark.createDataFrame([([5, 6, 5, 6, 0, 7],)], "tokens array<long>")
    counted = collocations.count_grams(stream, 2, 1)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    # one exchange, with no aggregate between it and the tasks' own counts
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, counted.collect())) == [(5, 6, 2), (6, 5, 1)]


def test_a_plan_is_as_small_in_the_last_batch_as_in_the_first(spark, monkeypatch):
    """The driver holds every join and scan of a plan: their number is fixed, however many batches there are."""
    plans, store = [], collocations.store

    def seen(df, name, *args, **options):
        if name == "phrases-survivors":
            text = df._jdf.queryExecution().executedPlan().toString()
            plans.append((text.count("Join ["), text.count("FileScan parquet")))
        return store(df, name, *args, **options)

    monkeypatch.setattr(collocations, "store", seen)
    rows = _rows(80, 7)
    got = collocations.collocations(_frame(spark, rows), top=12, min_count=4, levels={x: 800_000 for x in ("en", "de", "x", "und")})
    assert sorted(map(tuple, got.collect())) == _brute(rows, 12, 4)
    # four words with three at either side, all with the levels and with what drops them
    assert plans == [(4, 9)] * len(plans) and len(plans) > 1
    # one join with the words for all places of a phrase, one with the totals
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
