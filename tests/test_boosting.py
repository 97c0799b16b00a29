"""Boosted trees against a small brute-force fit: splits, leaf weights, regularisation, patience, both ways of growing."""

import numpy as np
import pytest

from hearth.operators import boosting as B


def _data(n=300, seed=3, k=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, k)), 2)
    y = 100 * (x[:, 0] > 0.3) + 30 * x[:, 1] * (x[:, 0] > 0.3) + rng.normal(size=n)
    return x, np.round(y, 3)


def _frame(spark, x, y, held=None):
    held = np.zeros(len(y), bool) if held is None else held
    rows = [(int(i * 2654435761 % 2**31), [float(v) for v in r], float(t), bool(h)) for i, (r, t, h) in enumerate(zip(x, y, held))]
    return spark.createDataFrame(rows, "row long, x array<double>, y double, held boolean").repartition(3)


def _brute_tree(x, g, depth, p):
    """Every cut of every feature, on the values themselves; returns predictions by row."""
    def value(i):
        total = g[i].sum()
        return -p.rate * np.sign(total) * max(abs(total) - p.l1, 0) / (len(i) + p.l2)

    def score(i):
        return max(abs(g[i].sum()) - p.l1, 0) ** 2 / (len(i) + p.l2)

    out = np.zeros(len(g))

    def split(i, d):
        best = None
        if d:
            for f in range(x.shape[1]):
                for cut in np.unique(x[i, f])[:-1]:
                    left, right = i[x[i, f] <= cut], i[x[i, f] > cut]
                    if min(len(left), len(right)) >= p.min_rows:
                        gain = score(left) + score(right) - score(i)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, left, right
        if best is None:
            out[i] = value(i)
        else:
            split(best[1], d - 1)
            split(best[2], d - 1)

    split(np.arange(len(g)), depth)
    return out


@pytest.mark.parametrize("l1, l2", [(0.0, 0.0), (0.1, 1.0), (40.0, 25.0)])
@pytest.mark.parametrize("local_rows", [0, 10**9])
def test_trees_and_leaf_weights_match_brute_force(spark, l1, l2, local_rows):
    x, y = _data(60)                                    # fewer values than bins: every cut is a candidate
    p = B.Params(rounds=2, depth=3, rate=0.5, rows=1.0, features=1.0, min_rows=5, l1=l1, l2=l2, local_rows=local_rows)
    model = B.fit(_frame(spark, x, y), "x", "y", "held", "row", p)
    pred = np.full(len(y), y.mean())
    for t in model.trees:
        g = np.rint((pred - y) * B.UNIT) / B.UNIT
        pred = pred + _brute_tree(x, g, p.depth, p)
    assert len(model.trees) == 2 and model.predict(x) == pytest.approx(pred, abs=1e-6)


def test_both_ways_of_growing_agree_and_samples_are_drawn(spark):
    x, y = _data(400, seed=8, k=6)
    df = _frame(spark, x, y, np.arange(400) % 4 == 0)
    models = [B.fit(df.repartition(n), "x", "y", "held", "row", B.Params(rounds=12, depth=4, local_rows=local))
              for n, local in ((1, 10**9), (4, 0), (3, 90))]
    for m in models[1:]:
        assert m.errors == pytest.approx(models[0].errors)
        for a, b in zip(m.trees, models[0].trees):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)
    used = [set(t.feature[t.feature >= 0]) for t in models[0].trees]
    assert all(len(u) <= 5 for u in used) and len(set().union(*used)) > 2
    share = np.mean([B.drawn(np.arange(10_000), r, B.Params()).mean() for r in range(5)])
    assert share == pytest.approx(0.8, abs=0.02)
    assert models[0].importance().sum() == pytest.approx(1) and models[0].importance().argmax() == 0


def test_patience_keeps_the_best_round(spark):
    x, y = _data(200, seed=1)
    held = np.arange(200) % 3 == 0
    y = np.where(held, y[::-1], y)                      # what is learned soon hurts the validation rows
    p = B.Params(rounds=60, depth=3, rate=0.3, rows=1.0, features=1.0, patience=6)
    model = B.fit(_frame(spark, x, y, held), "x", "y", "held", "row", p)
    best = int(np.argmin(model.errors))
    assert len(model.trees) == best + 1 and len(model.errors) == best + 1 + p.patience < p.rounds
    assert np.abs(model.predict(x[held]) - y[held]).mean() == pytest.approx(model.errors[best])


def test_no_task_gets_all_rows_and_one_of_two_siblings_is_summed(spark, monkeypatch):
    x, y = _data(400, seed=8, k=6)
    summed, local, level, finish = [], [], B._Trainer.level, B._Trainer.finish
    monkeypatch.setattr(B._Trainer, "level", lambda self, tree, nodes, *a: summed.append(list(nodes)) or level(self, tree, nodes, *a))
    monkeypatch.setattr(B._Trainer, "finish", lambda self, tree, nodes, *a: local.append(list(nodes)) or finish(self, tree, nodes, *a))
    for rows in (0, 10**9):
        B.fit(_frame(spark, x, y), "x", "y", "held", "row", B.Params(rounds=2, depth=4, local_rows=rows))
    assert local and all(0 not in nodes for nodes in local)
    assert all(len({(i - 1) // 2 for i in nodes}) == len(nodes) for nodes in summed) and max(map(len, summed)) > 1


def test_levels_read_a_rounds_rows_and_features_alone(spark, monkeypatch):
    x, y = _data(500, seed=2, k=10)
    held, seen, level = np.arange(500) % 5 == 0, [], B._Trainer.level

    def spy(self, tree, nodes, features, round_):
        if nodes != [0]:
            seen.append((self.work.map(lambda b: (b[0].shape, len(b[1]))).collect(), len(features)))
        return level(self, tree, nodes, features, round_)

    monkeypatch.setattr(B._Trainer, "level", spy)
    monkeypatch.setattr(B, "SUM_ROWS", 10)               # of the driver: the work is kept, as for many rows
    B.fit(_frame(spark, x, y, held), "x", "y", "held", "row", B.Params(rounds=2, depth=4, local_rows=0, rows=0.5, features=0.5))
    assert seen
    for blocks, k in seen:
        assert all(shape == (k, rows) for shape, rows in blocks) and k == 5
        assert 0 < sum(rows for _, rows in blocks) < 0.65 * (~held).sum()


def test_small_nodes_are_finished_apart_only_when_no_large_one_is_left(spark, monkeypatch):
    x, y = _data(600, seed=4, k=5)
    finished, finish = [], B._Trainer.finish
    monkeypatch.setattr(B._Trainer, "finish", lambda self, tree, nodes, *a: finished.append(len(nodes)) or finish(self, tree, nodes, *a))
    rounds = [B.fit(_frame(spark, x, y), "x", "y", "held", "row", B.Params(rounds=4, depth=6, local_rows=n)) for n in (0, 60)]
    assert 0 < len(finished) <= 5                       # once a round, also in the pass that only finds the last error
    for a, b in zip(*(m.trees for m in rounds)):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
@pytest.mark.parametrize("nodes", [1, 5, 64])
def test_sums_are_exact(scale, nodes):
    rng = np.random.default_rng(6)
    n = 70_000
    bins, node = rng.integers(0, B.BINS, (2, n), dtype=np.uint8), rng.integers(0, nodes, n)
    g = np.rint(rng.normal(size=n) * scale).astype(np.int64)
    total, rows = np.zeros((nodes, 2, B.BINS), np.int64), np.zeros((nodes, 2, B.BINS), np.int64)
    for i in range(2):
        np.add.at(total, (node, i, bins[i]), g)
        np.add.at(rows, (node, i, bins[i]), 1)
    got = B.sums(bins, g, node, nodes)
    assert (got[0] == total).all() and (got[1] == rows).all()


@pytest.mark.parametrize("depth", [1, 3, 6, 9])
def test_paths_lead_to_the_nodes(depth):
    rng = np.random.default_rng(depth)
    tree, bins = B.Tree.empty(depth), rng.integers(0, B.BINS, (4, 900), dtype=np.uint8)
    for node in range(2 ** depth - 1):
        if (node == 0 or tree.feature[(node - 1) // 2] >= 0) and rng.random() < 0.8:
            tree.feature[node], tree.cut[node] = rng.integers(0, 4), rng.integers(0, B.BINS - 1)
    tree.value[:] = rng.normal(size=len(tree.value))
    node = tree.node_of(bins.T)
    assert (tree.ends()[tree.path(bins, depth)] == tree.value[node]).all()
    for level in range(depth):
        here = (node >= 2 ** level - 1) & (node < 2 ** (level + 1) - 1)      # leaves of that level
        assert (tree.path(bins, level)[here] == node[here] + 1 - 2 ** level).all()
