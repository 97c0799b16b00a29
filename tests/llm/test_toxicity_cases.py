"""Toxicity: one label alone, tables that turn over, and views, fit and scores recomputed plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import toxicity

TEXTS = ["a common word here", "you id-iot fool", "the w0rthless fool", "nothing to see", "i d i o t words"]


def _frames(spark, labels):
    docs = spark.createDataFrame([(i, TEXTS[i % 5]) for i in range(60)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "doc_id long, toxic int")


@pytest.mark.parametrize("label", [0, 1, None])
def test_one_label_alone_scores_nothing(spark, label):
    docs, labels = _frames(spark, [label] * 60)
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert {r.score for r in toxicity.toxicity_scores(docs, model).collect()} == {0.0}


def _kernel(s, t):
    """Common subsequences of three letters, by enumeration."""
    def all_of(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.LAMBDA ** (k - i + 1)
        return out
    a, b = all_of(s), all_of(t)
    return sum(v * b.get(x, 0) for x, v in a.items())


def test_views_match_the_kernel_by_enumeration(monkeypatch):
    landmarks = ["idiot", "worthless", "fool"]
    texts = ["An id-iot, fool!", "i d i o t", "worthles wort less", "", "zzz qqq", "foool idioots", "nothing"] * 3
    viewer = toxicity.Viewer(landmarks)
    got = viewer(texts)
    monkeypatch.setattr(toxicity, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(toxicity, "CACHE_ROWS", 2)
    assert (np.concatenate([viewer([t]) for t in texts]) == got).all()
    for text, view in zip(texts, got):
        for landmark, value in zip(landmarks, view):
            best = 0.0
            for w in toxicity.read_words(text):
                for u in toxicity.units(w):
                    norm = _kernel(u, u) * _kernel(landmark, landmark)
                    k = _kernel(u, landmark) / norm ** 0.5 if norm else 0.0
                    best = max(best, (k - toxicity.FLOOR) / (1 - toxicity.FLOOR))
            assert value == pytest.approx(best, abs=1e-5)


def test_svm_meets_its_optimality_condition():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0.4).astype(float)
    w = toxicity.fit_svm(x, y)
    sign, cost = 2 * y - 1, np.where(y > 0, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    x1 = np.hstack([x, np.ones((200, 1))])
    slack = np.maximum(0, 1 - sign * (x1 @ w))
    gradient = np.array([1, 1, 1, 1, 1e-6]) * w - x1.T @ (cost * sign * slack)
    assert np.abs(gradient).max() < 1e-6
    scale, offset = toxicity.fit_platt(x1 @ w, y)
    p = 1 / (1 + np.exp(-(scale * (x1 @ w) + offset)))
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    assert abs((p - target).sum()) < 1e-3 and abs(((p - target) * (x1 @ w)).sum()) < 1e-2 and scale > 0
