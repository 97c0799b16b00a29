"""Language identification with hyperdimensional profiles.

Every letter owns a random +1/-1 vector (seeded by its code point). The
trigram abc is bound as rot2(a) * rot1(b) * c, a text's profile is the
sum (bundle) of its trigrams' vectors, a language's prototype the bundle of
its training texts (each of one weight), and a text is compared with the prototypes by cosine.
Prototypes are centred on their mean direction, which removes what all
languages share (word gaps, frequent letters) before the comparison.

Texts are lower-cased; runs of anything but letters are one gap symbol.

Cases: a null text, or one without a letter, gets `und` and score 0; null
labels and labels of folds not learned from are ignored; with no training
text at all every text is `und`; equal cosines go to the alphabetically first
language. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, slices

DIMENSIONS = 512
#: Languages times dimensions are gathered as prototypes; beyond this many languages fitting stops.
MAX_LANGUAGES = 2000
UND = "und"
UNITS = 1 << 20
#: Texts of more trigrams are scaled alone: whole units for each trigram would lose their weight.
LONG = 1 << 12
#: Text handled, and sent back, at once inside a task.
SLICE = 1 << 19
_cache: dict = {}


def _letters() -> np.ndarray:
    if "alpha" not in _cache:
        _cache["alpha"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _cache["alpha"]


def letter_vector(code_point: int, dims: int = DIMENSIONS) -> np.ndarray:
    """The random +1/-1 vector of a letter; 0 is the gap between words."""
    key = (code_point, dims)
    if key not in _cache:
        _cache[key] = np.random.default_rng([dims, code_point]).choice(np.array([-1, 1], np.int8), dims)
    return _cache[key]


class Trigrams:
    """Trigrams of some texts: per trigram its vector, per occurrence its index, per text its range."""

    def __init__(self, texts: list[str], dims: int = DIMENSIONS):
        low = [f" {t.lower()} " for t in texts]
        cp = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
        alpha = _letters()[cp]
        # of a gap only the first place stays, and the one in front of each text
        keep = alpha | np.concatenate([[True], (doc[1:] != doc[:-1]) | alpha[:-1]])[:len(cp)]
        cp, doc = np.where(alpha, cp, 0)[keep], doc[keep]
        self.has_letter = np.bincount(doc, weights=cp > 0, minlength=len(low)) > 0
        symbols, dense = np.unique(cp, return_inverse=True)
        a = len(symbols)
        same = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
        middle = (cp[1:-1] > 0) | (cp[:-2] > 0) if len(doc) > 2 else same
        same &= middle
        code = ((dense[:-2] * a + dense[1:-1]) * a + dense[2:])[same] if len(doc) > 2 else dense[:0]
        if a ** 3 <= 1 << 22:
            distinct = np.flatnonzero(np.bincount(code, minlength=a ** 3))
            place = np.zeros(a ** 3, np.int32)
            place[distinct] = np.arange(len(distinct))
            self.index = place[code]
        else:
            distinct, self.index = np.unique(code, return_inverse=True)
        self.doc = doc[:-2][same] if len(doc) > 2 else doc[:0]
        self.bounds = np.searchsorted(self.doc, np.arange(len(low) + 1))
        vec = np.stack([letter_vector(int(c), dims) for c in symbols]) if a else np.zeros((0, dims), np.int8)
        self.vectors = (np.roll(vec, 2, 1)[distinct // (a * a or 1)] * np.roll(vec, 1, 1)[distinct // (a or 1) % (a or 1)]
                        * vec[distinct % (a or 1)]).astype(np.float32)

    def bundle(self, text: int) -> np.ndarray:
        """The profile of one text."""
        counts = np.bincount(self.index[self.bounds[text]:self.bounds[text + 1]], minlength=len(self.vectors))
        used = np.flatnonzero(counts)
        return counts[used].astype(np.float32) @ self.vectors[used]


def _fit_task(dims: int):
    def add(sums: dict[str, np.ndarray], texts: list[str], langs: np.ndarray):
        grams = Trigrams(texts, dims)
        # each text has the same weight, dealt evenly to its trigrams: in whole units, or
        # for a long text by scaling its whole bundle
        size = np.diff(grams.bounds)
        weight = np.where(size > LONG, 0, UNITS // np.maximum(size, 1))[grams.doc]
        for i in np.flatnonzero(size > LONG):
            got = np.rint(grams.bundle(i) * (UNITS / float(size[i]))).astype(np.int64)
            sums[langs[i]] = sums.get(langs[i], 0) + got
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            mine = np.isin(grams.doc, own)
            counts = np.bincount(grams.index[mine], weights=weight[mine], minlength=len(grams.vectors))
            got = np.rint(counts @ grams.vectors.astype(np.float64)).astype(np.int64)
            sums[lang] = sums.get(lang, 0) + got

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang_all = batch.column(1).to_pylist()
            for lo, hi in slices(batch.column(0), SLICE):
                # a slice's trigrams go before the next slice is read
                add(sums, [t or "" for t in batch.column(0).slice(lo, hi - lo).to_pylist()], np.array(lang_all[lo:hi], object))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "bundle"])

    return run


def fit_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> bundle over all given texts (integer sums, the same in any order).

    Each task sends one vector per language; what is gathered is languages
    times ``dims`` numbers, and more than ``MAX_LANGUAGES`` labels are refused.
    """
    parts = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .mapInArrow(_fit_task(dims), "lang string, bundle array<long>")
    rows = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i") \
                .agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("b")) \
                .limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels; raise MAX_LANGUAGES if that is meant")
    return {r["lang"]: np.array([x["v"] for x in r["b"]], np.float64) for r in rows}


def _predict_task(prototypes: dict[str, np.ndarray], text_at: int, width: int, dims: int):
    """Batches of the first ``width`` columns with lang_pred and score, a slice of text each; the text is column ``text_at``."""
    langs = sorted(k for k, v in prototypes.items() if np.any(v))
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in langs]) if langs else np.zeros((0, dims))
    mean = unit.mean(0) if len(langs) > 1 else np.zeros(dims)
    centred = unit - mean
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    axis = (mean / max(np.linalg.norm(mean), 1e-12)).astype(np.float32)

    def told(texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        grams = Trigrams(texts, dims)
        for i in range(len(texts)):
            if not langs or not grams.has_letter[i]:
                names.append(UND)
                scores.append(0.0)
                continue
            profile = grams.bundle(i)
            profile = profile - (profile @ axis) * axis
            cosine = centred @ profile / max(float(np.linalg.norm(profile)), 1e-12)
            best = int(np.argmax(cosine))
            names.append(langs[best])
            scores.append(float(min(1.0, max(0.0, cosine[best]))))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi in slices(batch.column(text_at), SLICE):
                part = batch.slice(lo, hi - lo)
                names, scores = told([t or "" for t in part.column(text_at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names[:width], "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id",
                     text_col: str = "text", keep: tuple[str, ...] = (), dims: int = DIMENSIONS) -> DataFrame:
    """doc_id, ``keep`` columns, lang_pred, score (cosine with the predicted language, clipped to 0..1).

    A text that is kept goes to the task once, and comes back a slice at a time.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), *keep)
    width, own = len(kept.columns), text_col in keep
    text_at = 1 + keep.index(text_col) if own else width
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    sent = kept if own else docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    return sent.mapInArrow(_predict_task(prototypes, text_at, width, dims), f"{fields}, lang_pred string, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds crc32(doc_id) mod 3 <> 1."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang",
                                           F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    prototypes = fit_prototypes(docs.where(~F.col("held_out")))
    return predict_language(docs, prototypes, keep=("held_out",))
