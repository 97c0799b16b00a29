"""Ranked search against brute force; bounds of the ball tree."""

import collections
import math
import random
import re

import numpy as np
import pytest

from hearth.llm import ball_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, terms string, score long"
ITEMS = "item_id long, text string, rank int"


def _terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in WORD.findall(text or "")]


def _tables():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdéÉXY日9", k=rng.randint(1, 3))) for _ in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    say = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(vocab, weights, k=n))
    docs = [(i, say(rng.choice([3, 20, 60]))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(15)] + [(7, docs[7][1]), (None, docs[3][1]), (None, None), (901, ""), (902, " .-"),
                                                          (903, say(5000))]
    items = [(i, say(rng.choice([1, 4, 12]))) for i in range(25)]
    items += [(3, "extra É"), (None, vocab[0]), (40, None), (41, "nowhere"), (42, "..."), (43, docs[3][1])]
    return docs, items


def _brute(docs, items, k=10):
    counts = [(i, collections.Counter(_terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in queries.items():
        rows = []
        for doc_id, c in counts:
            size = sum(c.values())
            if size:
                m = 10 + 90 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                            for t in terms if t in c)
                if score > 0:
                    rows.append((-score, doc_id is not None, doc_id or 0))
        for rank, (s, there, doc_id) in enumerate(sorted(rows)[:k], 1):
            out.append((item, rank, doc_id if there else None, -s))
    return sorted(out, key=repr)


def _frames(spark, docs, items):
    return (spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS).repartition(3),
            spark.createDataFrame([(*r, 1) for r in items], ITEMS))


@pytest.mark.parametrize("pairs, tree", [(16384, 4096), (30, 100)])
def test_against_brute_force(spark, monkeypatch, pairs, tree):
    monkeypatch.setattr(ball_search, "TREE_DOCS", tree)
    docs, items = _tables()
    d, i = _frames(spark, docs, items)
    monkeypatch.setattr(ball_search, "documents", lambda s, p: d)
    monkeypatch.setattr(ball_search, "read_table", lambda s, p, t: i)
    got = ball_search.op13(spark, "") if pairs == 16384 else ball_search.search(d, i, block_pairs=pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(docs, items)


@pytest.mark.parametrize("no_docs, no_items", [(True, False), (False, True), (True, True)])
def test_empty_tables(spark, no_docs, no_items):
    docs, items = _tables()
    d, i = _frames(spark, [] if no_docs else docs, [] if no_items else items)
    assert ball_search.search(d, i).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    width, n = 300, 1000
    topic = rng.integers(0, 10, n)                                  # documents of a topic share their terms
    rows = [np.unique(np.concatenate([rng.integers(0, 20, 5), 20 + 28 * t + rng.integers(0, 28, 12)])) for t in topic]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    idx = np.concatenate(rows)
    val = rng.integers(1, 1_000_000, len(idx))
    weight = rng.integers(0, 20_000, width)
    terms = [np.unique(np.concatenate([rng.integers(0, 20, 3), 20 + 28 * t + rng.integers(0, 28, 9)])) for t in range(10)]
    queries = ball_search.Queries(terms, weight)
    tree = ball_search.BallTree(ends, idx, val, queries, leaf=16)
    assert sorted(tree.order) == list(range(n)) and len(tree.ranges) == len(tree.centroid)
    ids = [(True, i) for i in range(n)]
    for q, t in enumerate(terms):
        dense = np.zeros(width, np.int64)
        dense[t] = weight[t]
        scores = np.add.reduceat(val * dense[idx], ends[:-1])
        for node, (lo, hi) in enumerate(tree.ranges):
            assert tree.bounds(queries, q)[node] >= scores[tree.order[lo:hi]].max()
        best = []
        tree.search(queries, q, dense, best, 5, ids)
        assert best == sorted((-int(s), (True, i)) for i, s in enumerate(scores))[:5]
    leaves = len(tree.ranges) - tree.first_leaf
    assert tree.scored < 0.6 * leaves * len(terms)
