"""Toxicity by a subsequence-string-kernel SVM on Nyström landmarks.

The kernel of two words counts common subsequences of three letters, each
occurrence weighted LAMBDA ** span with spans up to SPAN, so inserted and left
out letters cost little; it is normalised to 1 for equal words. Words are
letter sequences: marks inside a word are skipped ("i.d-i*o.t"), and four or
more one-character words in a row are read as one ("i d i o t").

Landmarks are words of labelled training rows that speak most for the label
(log-odds z-score), no two too similar. A text's view of a landmark is the best
kernel value among its words (above FLOOR, rescaled); multiplied by the
landmarks' kernel matrix to the power -1/2 this is the Nyström feature map on
which a linear squared-hinge SVM is trained, with Platt scaling for scores.

Fitting uses at most ``max_rows`` labelled rows (those with the smallest hash
of doc_id): a documented bound on the sample the classifier is fitted on.
Every row is scored over its whole text.

Cases: null and empty texts score as texts without any similar word; labels
that are null are ignored, of several labels of a doc_id the largest counts;
without rows of both labels every score is 0; words over LONGEST letters are
read in overlapping windows. Only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import documents, fold, slices, store

MAX_ROWS = 20_000
LANDMARKS = 96
LAMBDA = 0.8
SPAN = 6
FLOOR = 0.4
LONGEST = 24
#: Words a worker's table holds in each generation, and different views it holds.
CACHE_ENTRIES = 400_000
CACHE_ROWS = 50_000
_GAPS = [(b, c) for c in range(2, SPAN) for b in range(1, c)]      # offsets of the 2nd and 3rd letter
_OTHER = re.compile(r"[\W\d_]+")
_worker: dict = {}


def units(word: str) -> list[str]:
    """The letter sequences a lower-case word stands for."""
    if not word.isalpha():
        word = _OTHER.sub("", word)
    if len(word) <= LONGEST:
        return [word] if len(word) >= 3 else []
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def read_words(text: str) -> list[str]:
    words = text.lower().split()
    if list(map(len, words)).count(1) >= 4:
        run: list[str] = []
        for w in [*words, ""]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= 4:
                    words.append("".join(run))
                run = []
    return words


def triples(words: list[str], letters: str):
    """(word index, code, weight) of all three-letter subsequences; code is -1 if a letter is not in ``letters`` (sorted)."""
    base = len(letters) + 1
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max(initial=0)) + SPAN
    ids = np.full((len(words), width), -1, np.int64)
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    known = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
    at = np.minimum(np.searchsorted(known, cp), len(known) - 1)
    row = np.repeat(np.arange(len(words)), size)
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(words) else size
    ids[row, np.arange(len(cp)) - first[row]] = np.where(known[at] == cp, at, -2) if len(known) else -2
    where, codes, weights = [], [], []
    for b, c in _GAPS:
        x, y, z = ids[:, :width - c], ids[:, b:width - c + b], ids[:, c:]
        row, col = np.nonzero(z != -1)
        x, y, z = x[row, col], y[row, col], z[row, col]
        ok = (x >= 0) & (y >= 0) & (z >= 0)
        where.append(row)
        codes.append(np.where(ok, (x * base + y) * base + z, -1))
        weights.append(np.full(len(row), LAMBDA ** (c + 1), np.float32))
    return np.concatenate(where), np.concatenate(codes), np.concatenate(weights)


def self_kernel(words: list[str]) -> np.ndarray:
    """K(s, s) of each word."""
    letters = "".join(sorted(set("".join(words))))
    base = len(letters) + 1
    row, code, weight = triples(words, letters)
    key = row * base ** 3 + code
    order = np.argsort(key)
    key, row, weight = key[order], row[order], weight[order].astype(np.float64)
    if not len(key):
        return np.zeros(len(words))
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.bincount(row[cut], weights=np.add.reduceat(weight, cut) ** 2, minlength=len(words))


class Kernel:
    """Normalised kernel of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.letters = "".join(sorted(set("".join(landmarks))))
        self.base = len(self.letters) + 1
        row, code, weight = triples(landmarks, self.letters)
        self.codes = np.unique(code)
        table = np.zeros((len(self.codes), len(landmarks)))
        np.add.at(table, (np.searchsorted(self.codes, code), row), weight)
        norm = np.sqrt(self_kernel(landmarks))
        table = (table / np.maximum(norm, 1e-12)).astype(np.float32)
        # most triples are in few landmarks: the table's rows as lists of (landmark, value)
        at, self.column = np.nonzero(table)
        self.value = table[at, self.column].astype(np.float64)
        self.count = np.append(np.bincount(at, minlength=len(self.codes)), 0)
        self.start = np.append(np.cumsum(self.count[:-1]) - self.count[:-1], 0)
        self.place = np.full(self.base ** 3, -1, np.int32)
        self.place[self.codes] = np.arange(len(self.codes))
        self.m = len(landmarks)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.m), np.float32)
        for lo in range(0, len(words), 4096):
            part = words[lo:lo + 4096]
            row, code, weight = triples(part, self.letters)
            place = np.where(code >= 0, self.place[code], -1)
            hit = place >= 0
            row, place, weight = row[hit], place[hit], weight[hit]
            if not len(row):
                continue
            n = self.count[place]
            owner = np.repeat(np.arange(len(row)), n)
            entry = np.arange(len(owner)) + np.repeat(self.start[place] - (np.cumsum(n) - n), n)
            dense = np.bincount(row[owner] * self.m + self.column[entry], weights=weight[owner] * self.value[entry],
                                minlength=len(part) * self.m).reshape(-1, self.m)
            rows = np.flatnonzero(np.bincount(row, minlength=len(part)))
            raw = dense[rows]
            # K(s, s) is at least the sum of squared single weights: most words can't reach the floor
            size = np.array([len(part[r]) for r in rows])
            least = sum(np.maximum(size - c, 0) * LAMBDA ** (2 * c + 2) for _, c in _GAPS)
            can = np.flatnonzero(raw.max(1) >= FLOOR * np.sqrt(np.maximum(least, 1e-12)) * 0.999)
            if len(can):
                norm = np.sqrt(self_kernel([part[r] for r in rows[can]]))
                out[lo + rows[can]] = raw[can] / np.maximum(norm, 1e-12)[:, None]
        return out


class Viewer:
    """Best kernel value of a text's words for each landmark.

    Values are kept per Python worker, for words as written and for the letters they stand for, in
    tables of two generations: the older goes when the younger is full, and words still in use move over.
    """

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.letters: dict[str, int] = {}
        self.rows = [np.zeros(len(landmarks), np.float32)]
        self.place = {self.rows[0].tobytes(): 0}

    def _row(self, view: np.ndarray) -> int:
        return self.place.setdefault(view.tobytes(), len(self.place))

    def _turn(self) -> None:
        if len(self.rows) > CACHE_ROWS:
            self.known, self.older, self.letters = {}, {}, {}
            del self.rows[1:]
            self.place = {self.rows[0].tobytes(): 0}
        elif len(self.known) > CACHE_ENTRIES:
            self.known, self.older, self.letters = {}, self.known, {}

    def _learn(self, words: set[str]) -> None:
        todo, standing = [], {}
        for w in words:
            at = self.older.get(w)
            if at is None:
                found = units(w)
                standing[w] = found
                todo += [u for u in found if u not in self.letters]
            else:
                self.known[w] = at
        todo = list(dict.fromkeys(todo))
        if todo:
            values = self.kernel(todo)
            high = set(np.flatnonzero(values.max(1) >= FLOOR).tolist())
            for j, u in enumerate(todo):
                if j in high:
                    view = np.maximum(0, (values[j] - FLOOR) / (1 - FLOOR)).astype(np.float32)
                    self.letters[u] = self._row(view)
                    if self.letters[u] == len(self.rows):
                        self.rows.append(view)
                else:
                    self.letters[u] = 0
        for w, found in standing.items():
            at = {self.letters[u] for u in found}
            at.discard(0)
            if len(at) > 1:
                view = np.max([self.rows[k] for k in at], axis=0)
                k = self._row(view)
                if k == len(self.rows):
                    self.rows.append(view)
            else:
                k = at.pop() if at else 0
            self.known[w] = k

    def __call__(self, texts: list[str]) -> np.ndarray:
        self._turn()
        split = [set(read_words(t)) for t in texts]
        self._learn(set().union(*(s.difference(self.known) for s in split)))
        out = np.zeros((len(texts), self.kernel.m), np.float32)
        for i, words in enumerate(split):
            used = set(map(self.known.__getitem__, words))
            used.discard(0)
            if used:
                out[i] = np.max([self.rows[k] for k in used], axis=0)
        return out


def _viewer(landmarks: list[str]) -> Viewer:
    key = tuple(landmarks)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Viewer(landmarks)
    return _worker[key]


def _view_pass(landmarks: list[str], finish):
    def run(batches):
        viewer = _viewer(landmarks)
        for batch in batches:
            for lo, hi in slices(batch.column(0), 4 << 20):
                views = viewer([t or "" for t in batch.column(0).slice(lo, hi - lo).to_pylist()])
                yield finish(batch.slice(lo, hi - lo), views)

    return run


def choose_landmarks(sample: DataFrame, m: int = LANDMARKS) -> list[str]:
    """Words of (text, toxic) rows with the largest z-score of their log-odds, no two with a kernel over 0.85."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}]+", "")))
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, total):                          # one label alone says nothing
        return []
    counts = sample.select("toxic", F.explode(words).alias("w")).where(F.length("w").between(3, LONGEST)) \
        .groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t >= 4")
    t, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (F.lit(toxic + 1.0) - t)) - F.log(c / (F.lit(total - toxic + 1.0) - c))
    top = counts.withColumn("z", odds / F.sqrt(1 / t + 1 / c)).where("z > 3").orderBy(F.desc("z"), "w").limit(8 * m).collect()
    chosen: list[str] = []
    for r in top:
        if len(chosen) < m and (not chosen or Kernel(chosen)([r["w"]]).max() < 0.85):
            chosen.append(r["w"])
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights and bias of a squared-hinge SVM (balanced classes), by Newton steps on the primal."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    ridge = l2 * np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        active = sign * (x1 @ w) < 1
        xa, ca = x1[active], cost[active]
        new = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), xa.T @ (ca * sign[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new) if _ > 20 else new
    return w


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and offset of margins, with Platt's smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text",
                 max_rows: int = MAX_ROWS, m: int = LANDMARKS) -> dict:
    """Landmarks and weights from at most ``max_rows`` rows with a label for which ``usable`` holds."""
    chosen = labels.where(F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = store(sample, "toxicity-sample")
    landmarks = choose_landmarks(sample, m)
    if not landmarks:
        return {"landmarks": []}

    def finish(batch, views):
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(views), pa.list_(pa.float32()))],
                                          names=["toxic", "view"])

    got = sample.mapInArrow(_view_pass(landmarks, finish), "toxic int, view array<float>").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    views = np.array(got.column("view").to_pylist(), np.float64).reshape(len(y), -1)
    kernel = Kernel(landmarks)(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    # a fixed order of rows makes the sums, and so the fit, repeatable
    order = np.lexsort([*views.T, y])
    x, y = (views @ root)[order], y[order]
    w = fit_svm(x, y)
    scale, offset = fit_platt(x @ w[:-1] + w[-1], y)
    return {"landmarks": landmarks, "weights": root @ w[:-1], "bias": float(w[-1]), "scale": scale, "offset": offset}


def toxicity_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    docs = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    if not model["landmarks"]:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def finish(batch, views):
        margin = views.astype(np.float64) @ model["weights"] + model["bias"]
        score = 1 / (1 + np.exp(-np.clip(model["scale"] * margin + model["offset"], -35, 35)))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_view_pass(model["landmarks"], finish), f"doc_id {kind}, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows with crc32(doc_id) mod 5 <> 0."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity_scores(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
