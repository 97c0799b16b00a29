"""Ranked lexical search by exact inner products on sparse ball trees.

A document is a vector over terms, a query the weights of its terms, and the
score their inner product. Queries are handled in blocks of at most
``BLOCK_PAIRS`` (query, term) pairs (or one query, if its text is longer);
for a block every document is reduced to the block's terms, which changes no
product, and written as one narrow row. Tasks gather some thousands of such rows at a
time, build a ball tree over them, and search it for every query of the block,
carrying each query's k best from tree to tree. Only those leave a task.

A ball is a centroid with one radius for each of a few groups of terms (terms
of one query only; shared terms by weight). For a query q and any vector x of the
ball, <q, x> <= <q, c> + the sum over groups of |q_g| r_g, by Cauchy-Schwarz in every
group; one group would be the plain ball. Coordinates are scaled by the square root
of the term's weight, half of it on each side, so common terms widen a ball little.
Sums are rounded up by more than their floating-point error, so a bound
is never below a true score. Subtrees are visited best bound first until
the bound is below the k-th score; equal scores are still visited. Leaves are
scored in 64-bit integers.

Cases: a null or empty text has no terms and is found by nothing; a query
without terms, or whose terms occur nowhere, has no rows; query rows repeated with one id
are one query with all their terms, a null id is an id of its own; rows of
documents repeated with one id are documents of their own, and a null doc_id comes first
among equal scores; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import as_bytes, documents, slices, store

TOP = 10
BLOCK_PAIRS = 16_384
TREE_DOCS = 4096
TREE_PAIRS = 2_000_000
LEAF = 64
OWN_GROUPS, BANDS = 256, 16
#: Relative error allowed for a sum of products; true errors stay below 1e-11.
SAFE = 1e-9

#: ASCII other than letters and digits separates terms; A-Z are lower-cased; bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _query_terms(batches):
    for batch in batches:
        ids, terms = [], []
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            found = set(terms_of(t))
            ids += [i] * len(found)
            terms += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")) \
        .mapInArrow(_query_terms, "item_id long, term binary").distinct()


def vectors(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the whole text), terms (indexes into ``terms``, ascending), tf."""
    place = {t: i for i, t in enumerate(terms)}

    def run(batches):
        known = place.keys()
        for batch in batches:
            for lo, hi in slices(batch.column(1), 4 << 20):
                sizes, ends, idx, tf = [], [0], [], []
                for text in as_bytes(batch.column(1).slice(lo, hi - lo)):
                    words = terms_of(text)
                    counts = Counter(words)
                    here = sorted((place[t], counts[t]) for t in known & counts.keys())
                    sizes.append(len(words))
                    idx += [i for i, _ in here]
                    tf += [c for _, c in here]
                    ends.append(len(idx))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Queries:
    """A block's queries: term indexes, weights, scaled weights, and their norms by group of terms."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        self.terms, self.weight = terms, weight
        self.root = np.sqrt(weight.astype(np.float64))
        used = np.zeros(len(weight), np.int64)
        owner = np.zeros(len(weight), np.int64)
        for i, t in enumerate(terms):
            used[t] += 1
            owner[t] = i
        shared = np.flatnonzero(used != 1)
        group = owner % OWN_GROUPS
        by_weight = np.empty(len(shared), np.int64)
        by_weight[np.argsort(weight[shared], kind="stable")] = np.arange(len(shared)) * BANDS // max(1, len(shared))
        group[shared] = OWN_GROUPS + by_weight
        names, self.group = np.unique(group, return_inverse=True)
        self.n_groups = len(names)
        self.scaled = [self.root[t] for t in terms]
        self.norms = []
        for t in terms:
            g, at = np.unique(self.group[t], return_inverse=True)
            self.norms.append((g, np.sqrt(np.bincount(at, weights=weight[t]))))


class BallTree:
    """A balanced ball tree over sparse integer vectors (CSR: ``ends``, ``idx``, ``val``)."""

    def __init__(self, ends: np.ndarray, idx: np.ndarray, val: np.ndarray, queries: Queries, leaf: int = LEAF):
        n, width = len(ends) - 1, len(queries.weight)
        row = np.repeat(np.arange(n), np.diff(ends))
        x = val * queries.root[idx]
        order, bounds, level = np.arange(n), [(0, n)], 0
        while max(hi - lo for lo, hi in bounds) > leaf:
            order = self._split(order, bounds, row, idx, x, width)
            bounds = [part for lo, hi in bounds for part in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
            level += 1
        # rows in tree order
        self.order = order
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        moved = np.argsort(at[row], kind="stable")
        row, self.idx, self.val, x = at[row][moved], idx[moved], val[moved], x[moved]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        self.centroid, self.radius = [], []
        self.ranges = []
        spans = [(0, n)]
        for depth in range(level + 1):
            self._balls(spans, n, row, x, queries, width)
            spans = [part for lo, hi in spans for part in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
        self.first_leaf = (1 << level) - 1
        self.centroid, self.radius = np.concatenate(self.centroid), np.concatenate(self.radius)
        self.scored = 0

    @staticmethod
    def _node_of(spans, n):
        return np.repeat(np.arange(len(spans)), [hi - lo for lo, hi in spans])

    def _split(self, order, bounds, row, idx, x, width):
        """Rows of each node ordered from one far point towards another; the caller halves the node."""
        n, nodes = len(order), len(bounds)
        node = np.empty(n, np.int64)
        node[order] = self._node_of(bounds, n)
        count = np.bincount(node, minlength=nodes)
        start = np.array([lo for lo, _ in bounds])
        square = np.bincount(row, weights=x * x, minlength=n)
        place = node[row] * width + idx

        def farthest(point, norm):
            dist = square - 2 * np.bincount(row, weights=x * point.ravel()[place], minlength=n) + norm[node]
            by = np.lexsort([order, dist[order], node[order]])     # ties: the later row
            return order[by][start + count - 1], dist

        def dense(rows):
            out = np.zeros((nodes, width))
            of = np.full(n, -1)
            of[rows] = np.arange(nodes)
            here = of[row] >= 0
            out[of[row][here], idx[here]] = x[here]
            return out, square[rows]

        centre = np.bincount(place, weights=x, minlength=nodes * width).reshape(nodes, width) / count[:, None]
        a, _ = farthest(centre, (centre * centre).sum(1))
        b, from_a = farthest(*dense(a))
        _, from_b = farthest(*dense(b))
        return np.lexsort([np.arange(n), from_a - from_b, node])

    def _balls(self, spans, n, row, x, queries, width):
        node, nodes, groups = self._node_of(spans, n), len(spans), queries.n_groups
        count = np.maximum(1, np.array([hi - lo for lo, hi in spans]))
        place = node[row] * width + self.idx
        c = np.bincount(place, weights=x, minlength=nodes * width).reshape(nodes, width) / count[:, None]
        by_group = row * groups + queries.group[self.idx]
        square = np.bincount(by_group, weights=x * x, minlength=n * groups).reshape(n, groups)
        cross = np.bincount(by_group, weights=x * c.ravel()[place], minlength=n * groups).reshape(n, groups)
        own = np.stack([np.bincount(queries.group, weights=v, minlength=groups) for v in c * c])[node]
        dist = np.maximum(square - 2 * cross + own, 0) + SAFE * (square + own)
        self.centroid.append(c)
        self.radius.append(np.sqrt(np.maximum.reduceat(dist, [lo for lo, _ in spans], axis=0)))
        self.ranges += spans

    def bounds(self, queries: Queries, q: int) -> np.ndarray:
        """For every node, a number no score of its rows is above."""
        groups, norms = queries.norms[q]
        return (self.centroid[:, queries.terms[q]] @ queries.scaled[q] + self.radius[:, groups] @ norms) * (1 + SAFE)

    def search(self, queries: Queries, q: int, weights: np.ndarray, best: list, k: int, ids: np.ndarray) -> None:
        """Merge this tree's rows into ``best``: (-score, id) pairs, ascending, at most k."""
        bound = self.bounds(queries, q)
        heap = [(-bound[0], 0)]
        while heap:
            least = -best[-1][0] if len(best) == k else 1
            top, node = heapq.heappop(heap)
            if -top < least:
                return
            if node < self.first_leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            self.scored += 1
            lo, hi = self.ranges[node]
            a, b = self.ends[lo], self.ends[hi]
            sums = np.concatenate([[0], np.cumsum(self.val[a:b] * weights[self.idx[a:b]])])
            scores = sums[self.ends[lo + 1:hi + 1] - a] - sums[self.ends[lo:hi] - a]
            good = np.flatnonzero(scores >= least)
            if len(good):
                best += [(-int(scores[i]), ids[self.order[lo + i]]) for i in good]
                best.sort()
                del best[k:]


def _search_pass(queries: Queries, n_docs: int, n_terms: int, k: int):
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def trees(batches):
        """(ids, ends, terms, values) of some thousands of rows each."""
        held, docs, pairs = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs, pairs = docs + batch.num_rows, pairs + len(batch.column(2).flatten())
            if docs >= TREE_DOCS or pairs >= TREE_PAIRS:
                yield held
                held, docs, pairs = [], 0, 0
        if docs:
            yield held

    def run(batches):
        best: list[list] = [[] for _ in queries.terms]
        dense = np.zeros(len(queries.weight), np.int64)
        for held in trees(b for b in batches if b.num_rows):
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("terms").combine_chunks()
            # a null id sorts before all others
            ids = [(i is not None, i or 0) for i in table.column("doc_id").to_pylist()]
            idx = lists.flatten().to_numpy().astype(np.int64)
            tf = table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            m = np.array([10 + 90 * n * n_docs // n_terms for n in table.column("n").to_pylist()], np.int64)
            val = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
            tree = BallTree(ends, idx, val, queries)
            for q, terms in enumerate(queries.terms):
                dense[terms] = queries.weight[terms]
                tree.search(queries, q, dense, best[q], k, ids)
                dense[terms] = 0
        rows = [(q, i if there else None, -s) for q, found in enumerate(best) for s, (there, i) in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) \
            if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, scores above 0."""
    spark = docs.sparkSession
    pairs = store(query_terms(items, item_col, item_text_col), "search-queries")
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        terms = sorted(set(block.column("term").to_pylist()))
        place = {t: i for i, t in enumerate(terms)}
        by_item: dict = {}
        for i, t in zip(block.column("item_id").to_pylist(), block.column("term").to_pylist()):
            by_item.setdefault(i, []).append(place[t])
        rows = store(vectors(docs, terms, id_col, text_col), "search-vectors")
        total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
        if not total["l"]:
            break
        df = np.zeros(len(terms), np.int64)                        # at most the block's terms
        for t, c in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = c
        weight = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = Queries([np.array(sorted(t), np.int64) for t in by_item.values()], weight)
        found = rows.mapInArrow(_search_pass(queries, total["n"], total["l"], k), "q int, doc_id long, score long")
        names = spark.createDataFrame(list(enumerate(by_item)), "q int, item_id long")
        # one row per query of the block
        out = out.unionByName(found.join(F.broadcast(names), "q").select("item_id", "doc_id", "score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


ORACLE_OP13 = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (
  select distinct item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
tot as (select count(*) filter (len(w) > 0)::bigint as n, sum(len(w))::bigint as l from d),
tf as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) where t in (select t from q) group by r, t),
weight as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, tot group by t, n),
m as (select r, doc_id, 10 + (90 * len(w) * n) // l as m from d, tot where len(w) > 0),
scored as (select item_id, r, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
           from q join weight using (t) join tf using (t) join m using (r) group by item_id, r),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank
           from scored join m using (r) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
