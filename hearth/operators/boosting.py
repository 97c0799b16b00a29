"""Boosted regression trees by grouped gradient sums, with L1 and L2 terms and patience.

Rows are binned once, into blocks of numpy columns, many a partition. A tree grows level by level: every task
sums the gradients of its rows by node, feature and bin, the sums are added up, and the driver picks
splits from them. Of two siblings only the smaller one is summed; the other is what is left of their parent. When all
nodes left have at most ``local_rows`` rows, tasks finish them instead (a node's rows grouped, many nodes at
once), which saves the lower levels' passes. Both ways give the same tree: gradients are summed as
whole numbers of 1 / UNIT, so no order of rows changes a sum.

With G the sum of a node's gradients (prediction - label), N its rows, and s(G) = G shrunk towards 0 by
l1, a leaf's value is -rate * s(G) / (N + l2), and a split's gain s(G)^2 / (N + l2) of
the two sides minus that of the node. Each tree sees a share of the rows (by a hash of row
and round) and of the features. The first prediction is the mean label. After each
round the mean absolute error of the validation rows is taken, in the next round's pass; when it
has not fallen for ``patience`` rounds, or after ``rounds``, the trees up to the best round are the model.

Spark holds three tables of blocks: what never changes (row hashes, labels, bins), the predictions, which get each
round's tree once, and a round's work: the bins of its features and the gradients, of its rows only. Only the last
is read level by level. Predictions are checkpointed every REFRESH rounds, so a lost task redoes few
rounds. A pass is a small RDD job: a round has up to ``depth`` of them, whatever the number of rows. What the driver
holds is the trees and one level's sums.
"""

from __future__ import annotations

import math
import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BINS = 64
UNIT = 256
REFRESH = 25
LOCAL_ROWS = 4_096
#: Rows of a partition: at least, where cores are left over, and at most; rows of a block, and rows summed at once.
PART_ROWS = (4_096, 2_000_000)
BLOCK_ROWS = 16_384
SUM_ROWS = 65_536
#: Levels of a tree in which whole columns are compared.
MASKED = 4
#: Tables of sums are added up in tasks first where more tasks than this send one.
DIRECT = 16


@dataclass
class Params:
    rounds: int = 500
    depth: int = 8
    rate: float = 0.05
    rows: float = 0.8
    features: float = 0.8
    min_rows: int = 5
    l1: float = 0.1
    l2: float = 1.0
    patience: int = 20
    seed: int = 42
    local_rows: int = LOCAL_ROWS


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1, 2i + 2); feature -1 is a leaf; right if bin > cut."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n))

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        while len(row):
            f = self.feature[node[row]]
            row, f = row[f >= 0], f[f >= 0]
            node[row] = 2 * node[row] + 1 + (bins[row, f] > self.cut[node[row]])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node_of(bins)]

    def path(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Turns to the right (bits, the first one highest) in the first ``levels`` levels, for bins by feature and row.

        A leaf above goes on to the left. In the first levels whole columns are compared, node by node; below, each
        row's bin is looked up.
        """
        n, cut = bins.shape[1], self.cut.astype(np.uint8)        # of the bins' kind: comparing is fast
        out, masks = np.zeros(n, np.uint8), {0: np.ones(n, bool)}
        for _ in range(min(levels, MASKED)):
            out <<= 1
            below, turn = {}, np.zeros(n, bool)
            for node, mask in masks.items():
                if self.feature[node] >= 0:
                    right = bins[self.feature[node]] > cut[node]
                    right &= mask
                    turn |= right
                    below[2 * node + 1], below[2 * node + 2] = mask ^ right, right
            out |= turn.view(np.uint8)
            masks = below
        out, row, flat = out.astype(np.int64), np.arange(n), bins.ravel()
        for level in range(MASKED, levels):
            here = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            split = self.feature[here] >= 0
            at = np.where(split, self.feature[here].astype(np.int64) * n, 0).take(out)
            at += row
            right = flat.take(at) > np.where(split, cut[here], 255).astype(np.uint8).take(out)
            out <<= 1
            out += right
        return out

    def ends(self) -> np.ndarray:
        """The value by whole ``path``."""
        values = self.value.copy()
        for node in range(len(values) // 2):
            if self.feature[node] < 0:
                values[2 * node + 1] = values[node]
        return values[len(values) // 2:]

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1


@dataclass
class Boosted:
    """Trees up to the best round, over features cut at ``cuts``; ``errors``: validation error after each round tried."""
    base: float
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Number of cuts below each value."""
        return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, ends = np.full(len(x), self.base), [t.ends() for t in self.trees]
        for lo in range(0, len(x), BLOCK_ROWS):
            bins, some = np.ascontiguousarray(self.bins(x[lo:lo + BLOCK_ROWS]).T), out[lo:lo + BLOCK_ROWS]
            for t, values in zip(self.trees, ends):
                some += values[t.path(bins, t.depth)]
        return out

    def importance(self) -> np.ndarray:
        """Mean gain of each feature's splits, as a share of all features' sum."""
        total, n = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for t in self.trees:
            at = np.flatnonzero(t.feature >= 0)
            np.add.at(total, t.feature[at], t.gain[at])
            np.add.at(n, t.feature[at], 1)
        mean = total / np.maximum(n, 1)
        return mean / mean.sum() if mean.sum() else mean


def shrunk(g, p: Params):
    return np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)


def leaf_value(g: float, n: int, p: Params) -> float:
    return float(-p.rate * shrunk(g, p) / (n + p.l2))


def best_split(g: np.ndarray, n: np.ndarray, allowed: np.ndarray, p: Params):
    """(gain, feature, cut, rows left) from a node's sums (features x bins), or None; ties: the first."""
    left, rows = np.cumsum(g, 1)[:, :-1] / UNIT, np.cumsum(n, 1)[:, :-1]
    total, all_rows = g[0].sum() / UNIT, int(n[0].sum())
    gain = shrunk(left, p) ** 2 / (rows + p.l2) + shrunk(total - left, p) ** 2 / (all_rows - rows + p.l2) \
        - shrunk(total, p) ** 2 / (all_rows + p.l2)
    ok = allowed[:, None] & (rows >= p.min_rows) & (all_rows - rows >= p.min_rows)
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain))
    f, cut = divmod(at, gain.shape[1])
    return (float(gain[f, cut]), f, cut, int(rows[f, cut])) if gain[f, cut] > 1e-9 else None


def sums(bins: np.ndarray, g: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (whole numbers) and rows by node, feature and bin; ``bins`` by feature and row.

    Of as few rows as a double holds exactly, one pass sums both: 2^shift + gradient.
    """
    k, size = len(bins), nodes * BINS
    total, rows = np.zeros((k, size)), np.zeros((k, size))
    bits = int(np.abs(g).max(initial=1)).bit_length()
    part = min((51 - bits) // 2, 16)
    both = part >= 12 and 2 ** part >= 2 * size
    shift = 2.0 ** (bits + part + 1)
    step = 2 ** part if both else SUM_ROWS
    at = np.empty(min(step, len(g)), np.int64)
    for lo in range(0, len(g), step):
        weight, first = g[lo:lo + step].astype(np.float64), node[lo:lo + step] * BINS
        if both:
            weight += shift
        for i in range(k):
            here = np.add(first, bins[i, lo:lo + step], out=at[:len(first)])
            x = np.bincount(here, weight, size)
            if both:
                n = np.rint(x / shift)
                x -= n * shift
            else:
                n = np.bincount(here, minlength=size)
            total[i] += x
            rows[i] += n
    total, rows = np.rint(total).astype(np.int64), np.rint(rows).astype(np.int64)
    by_node = lambda x: x.reshape(k, nodes, BINS).swapaxes(0, 1)
    return by_node(total), by_node(rows)


def taken(bins: np.ndarray, features: np.ndarray | range, rows: np.ndarray) -> np.ndarray:
    """``bins[features][:, rows]``."""
    out = np.empty((len(features), len(rows)), bins.dtype)
    for i, f in enumerate(features):
        np.take(bins[f], rows, out=out[i], mode="clip")          # without a copy to check in
    return out


def allowed_features(k: int, round_: int, p: Params) -> np.ndarray:
    chosen = np.random.default_rng([p.seed, round_]).permutation(k)[:max(1, math.ceil(p.features * k))]
    return np.isin(np.arange(k), chosen)


def drawn(row: np.ndarray, round_: int, p: Params) -> np.ndarray:
    """Whether each row (a 64-bit hash) is in a round's sample."""
    h = row.view(np.uint64) ^ np.uint64((p.seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % 2 ** 64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(33))) <= np.uint64(min(p.rows, 1.0) * (2 ** 64 - 2 ** 12))


def grow(tree: Tree, root: int, bins: np.ndarray, g: np.ndarray, allowed: np.ndarray, p: Params) -> None:
    """Finish ``tree`` below node ``root`` with that node's rows (``bins`` by feature and row)."""
    todo = [(root, np.arange(len(g)))]
    while todo:
        node, rows = todo.pop()
        tree.value[node] = leaf_value(g[rows].sum() / UNIT, len(rows), p)
        if 2 * node + 2 >= len(tree.feature) or len(rows) < 2 * p.min_rows:
            continue
        hist, n = sums(bins[:, rows], g[rows], np.zeros(len(rows), np.int64), 1)
        found = best_split(hist[0], n[0], allowed, p)
        if found:
            tree.gain[node], tree.feature[node], tree.cut[node] = found[:3]
            right = bins[found[1], rows] > found[2]
            todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]


SCHEMA = "row long, held boolean, label double, bins binary"


def _kept(blocks: RDD) -> RDD:
    """Held by Spark, each block an item of its own, as ``zip`` needs it."""
    return blocks._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(table: DataFrame, k: int, parts: int) -> RDD:
    """(row hashes, held, labels, bins by feature and row) of some rows of a partition, as numpy columns."""
    def packed(held):
        columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
        for lo in range(0, len(columns[0]), BLOCK_ROWS):
            row, out, label, bins = (c[lo:lo + BLOCK_ROWS] for c in columns)
            block = pickle.dumps((row, out, label, np.ascontiguousarray(bins.T)), 5)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    def pack(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(),
                             np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, k)))
                rows += b.num_rows
            if rows >= 4 * BLOCK_ROWS:
                yield from packed(held)
                held, rows = [], 0
        if held:
            yield from packed(held)

    return _kept(table.repartition(parts).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])))


def _among(tree: Tree, features: np.ndarray) -> Tree:
    """``tree`` with features numbered among a round's (ascending) ones."""
    return Tree(np.where(tree.feature >= 0, np.searchsorted(features, tree.feature), -1), tree.cut, tree.value, tree.gain)


class _Trainer:
    def __init__(self, blocks: RDD, parts: int, model: Boosted, p: Params, few: bool):
        """``few``: so few rows that a pass makes a round's work again sooner than Spark keeps it."""
        self.few, self.blocks, self.parts, self.model, self.p, self.k = few, blocks, parts, model, p, len(model.cuts)
        base = model.base
        self.blocks.checkpoint()
        self.pred = _kept(self.blocks.map(lambda b: np.full(len(b[0]), base)))
        self.added, self.stale, self.work = 0, [], None

    def add(self, tree: Tree) -> None:
        """Add a tree to the predictions."""
        ends = tree.ends()
        self.stale.append(self.pred)
        self.pred = _kept(self.blocks.zip(self.pred).map(lambda x: x[1] + ends[tree.path(x[0][3], tree.depth)]))
        self.added += 1
        if self.added % REFRESH == 0:
            self.pred.checkpoint()

    def close(self) -> None:
        for blocks in (self.blocks, self.pred, *self.stale, *([] if self.few or self.work is None else [self.work])):
            blocks.unpersist()

    def start(self, features: np.ndarray, round_: int) -> None:
        """A round's rows: bins of its features and whole-number gradients; also the error and number of validation rows."""
        p = self.p

        def run(item):
            (row, held, label, bins), pred = item
            use = np.flatnonzero(~held & drawn(row, round_, p))
            g = np.rint((pred[use] - label[use]) * UNIT).astype(np.int64)
            if len(g) and np.abs(g).max() < 2 ** 31:
                g = g.astype(np.int32)
            return taken(bins, features, use), g, float(np.abs(label[held] - pred[held]).sum()), int(held.sum())

        if self.work is not None and not self.few:
            self.stale.append(self.work)
        work = self.blocks.zip(self.pred).map(run)
        self.work = work if self.few else _kept(work)

    def level(self, tree: Tree, nodes: list[int], features: np.ndarray, round_: int):
        """Gradients and rows of ``nodes`` by feature and bin, and the validation error so far."""
        want = np.array(nodes)                       # all of one level
        level = int(want[0] + 1).bit_length() - 1
        place = np.full(2 ** level, -1)
        place[want + 1 - 2 ** level] = np.arange(len(want))
        shape, tree = (len(want), len(features), BINS), _among(tree, features)

        def run(blocks):
            total_g, total_n, error, held = np.zeros(shape, np.int64), np.zeros(shape, np.int64), 0.0, 0
            some, rows = [], 0

            def add_up():
                a, b = sums(*[np.concatenate(x, -1) for x in zip(*some)], len(want))
                np.add(total_g, a, out=total_g)
                np.add(total_n, b, out=total_n)

            for bins, g, wrong, out in blocks:
                error, held = error + wrong, held + out
                at = place[tree.path(bins, level)]
                here = np.flatnonzero(at >= 0)
                some.append((bins, g, at) if len(here) == len(at) else (taken(bins, range(len(bins)), here), g[here], at[here]))
                rows += len(here)
                if rows >= SUM_ROWS:
                    add_up()
                    some, rows = [], 0
            if rows:
                add_up()
            yield total_g, total_n, error, held

        got = self.work.mapPartitions(run)
        add = lambda x, y: tuple(a + b for a, b in zip(x, y))
        if self.parts > DIRECT:
            return got.treeReduce(add, 2)
        total = None
        for one in got.collect():
            total = one if total is None else add(total, one)
        return total

    def finish(self, tree: Tree, nodes: list[int], features: np.ndarray, round_: int) -> None:
        """Grow ``nodes`` to their ends, each in one task."""
        p, want, known = self.p, np.array(sorted(nodes)), _among(tree, features)
        level = int(want[0] + 1).bit_length() - 1

        def send(blocks):
            for bins, g, _, _ in blocks:
                node = known.path(bins, level) + 2 ** level - 1
                order = np.argsort(node, kind="stable")
                node = node[order]
                for one, lo, hi in zip(want, np.searchsorted(node, want), np.searchsorted(node, want, side="right")):
                    if lo < hi:
                        yield int(one), (taken(bins, range(len(bins)), order[lo:hi]), g[order[lo:hi]])

        def one(item):
            node, rows = item
            rows, out = list(rows), Tree.empty(p.depth)
            bins, g = np.concatenate([b for b, _ in rows], 1), np.concatenate([g for _, g in rows])
            grow(out, node, bins, g, np.ones(len(features), bool), p)
            at = np.flatnonzero((out.feature >= 0) | (out.value != 0) | (out.gain != 0))
            return at, np.where(out.feature[at] >= 0, features[out.feature[at]], -1), out.cut[at], out.value[at], out.gain[at]

        found = self.work.mapPartitions(send).groupByKey(min(self.parts, len(nodes))).map(one)
        for at, *values in found.collect():          # at most 2^(depth + 1) nodes
            for column, v in zip((tree.feature, tree.cut, tree.value, tree.gain), values):
                column[at] = v

    def tree(self, round_: int) -> tuple[Tree, float, int]:
        """A round's tree, and the validation error before it."""
        p, tree = self.p, Tree.empty(self.p.depth)
        features = np.flatnonzero(allowed_features(self.k, round_, p))
        self.start(features, round_)
        g, n, error, held = self.level(tree, [0], features, round_)
        for old in self.stale:
            old.unpersist()
        self.stale = []
        have = {0: (g[0], n[0])}
        while have:
            below: list[tuple] = []
            sizes: dict[int, int] = {}
            for node, (g, n) in have.items():
                count = int(n[0].sum())
                tree.value[node] = leaf_value(g[0].sum() / UNIT, count, p)
                found = best_split(g, n, np.ones(len(features), bool), p) \
                    if 2 * node + 2 < len(tree.feature) and count >= 2 * p.min_rows else None
                if found:
                    gain, f, cut, left = found
                    tree.gain[node], tree.feature[node], tree.cut[node] = gain, features[f], cut
                    kids = {2 * node + 1: left, 2 * node + 2: count - left}
                    if 4 * node + 4 < len(tree.feature):
                        sizes.update(kids)
                        below.append((min(kids, key=kids.get), node))
                    else:                            # the last level: its sums are known from the split
                        for child, part in ((2 * node + 1, slice(None, cut + 1)), (2 * node + 2, slice(cut + 1, None))):
                            tree.value[child] = leaf_value(g[f, part].sum() / UNIT, kids[child], p)
            parents, have = have, {}
            if sizes and max(sizes.values()) <= p.local_rows:
                self.finish(tree, list(sizes), features, round_)
            elif below:
                below.sort()
                g, n, _, _ = self.level(tree, [x for x, _ in below], features, round_)
                for i, (x, parent) in enumerate(below):
                    have[x] = g[i], n[i]
                    have[4 * parent + 3 - x] = parents[parent][0] - g[i], parents[parent][1] - n[i]
        return tree, error, held


def fit(rows: DataFrame, features: str, label: str, held: str, row: str, p: Params | None = None) -> Boosted:
    """Trees for ``label`` from ``features`` (array<double> without nulls); ``held`` marks validation rows, ``row`` is a hash."""
    p = p or Params()
    spark = rows.sparkSession
    rows = rows.select(F.col(row).cast("long").alias("row"), F.col(held).alias("held"), F.col(label).cast("double").alias("label"),
                       F.col(features).alias("x")).where("label is not null and held is not null")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    train = rows.where("not held")
    first = rows.agg(F.avg(F.when(~F.col("held"), F.round("label", 6))).alias("base"), F.count(F.when(~F.col("held"), 1)).alias("n"),
                     F.max(F.size("x")).alias("k"), F.count("*").alias("rows")).first()
    if not first["n"]:
        raise ValueError("no training rows")
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = train.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"c{i}") for i in range(first["k"])]).first()
    model = Boosted(float(first["base"]), [np.unique(np.array(c, np.float64)) for c in cuts])
    plain = Boosted(model.base, model.cuts)

    def bin_rows(batches):
        for batch in batches:
            x = np.array(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            flat, k = plain.bins(x).tobytes(), len(plain.cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([flat[i:i + k] for i in range(0, len(flat), k)], pa.binary())],
                                             names=["row", "held", "label", "bins"])

    (least, most), cores = PART_ROWS, spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-first["rows"] // least))) * -(-first["rows"] // (cores * most))
    trainer = _Trainer(_blocks(rows.mapInArrow(bin_rows, SCHEMA), len(plain.cuts), parts), parts, model, p,
                       few=first["rows"] <= parts * SUM_ROWS)
    for round_ in range(p.rounds + 1):
        # the first pass of a round finds the error after the rounds before it
        tree, error, n = trainer.tree(round_)
        if round_:
            model.errors.append(error / n if n else 0.0)
            best = int(np.argmin(model.errors))
            if n and len(model.errors) - 1 - best >= p.patience:
                break
        if round_ == p.rounds:
            break
        model.trees.append(tree)
        trainer.add(tree)
    trainer.close()
    if any(model.errors):
        del model.trees[int(np.argmin(model.errors)) + 1:]
    return model
