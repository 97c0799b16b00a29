"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The pretrained model is a trie of byte contexts up to ORDER bytes with counts
of the byte that follows, from all training texts (each with four start marks
in front and one end symbol behind). A symbol is coded in the longest
context the trie has: with n symbols seen, d of them distinct, a seen symbol has
count / (n + d) and the escape d / (n + d) (method C). After an escape, the
symbols of the longer context are excluded from the shorter one's n and d; below
order 0 all symbols left are alike. As counts of a context are part of those
of its suffix, the excluded sums are one number per trie node.

Model and texts meet by exchange, so neither is gathered: texts are dealt into
chunks; a chunk sends its distinct (context, symbol) codes with training counts
to the owners of the contexts (by the last two context bytes, so a whole chain
of suffixes is in one place; orders 1 and 0 are a fixed table of 65,536 counts);
the owner adds the counts up to its part of the trie and replies with each
code's log probability; the chunk then sums over its texts. Word counts of the
unigram base score take the same way.

Without training texts (``train`` null or false everywhere) every symbol is
uniform. Cases: null and empty texts are scored as the end symbol alone; rows
repeated or with a null id are scored each; rows with ``train`` null are held
out; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Lookup, Words, as_bytes, documents, fold, mix, pack, partitions, slices, store, unpack

ORDER = 5
START, END = 0xFF, 0xFE            # bytes that UTF-8 never uses
SYMBOLS = 256
GRAM, WORD, LOW = 0, 1, 2          # kinds of request
END_WORD = U64(0x656E64)


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of context and symbol (the symbol in the low byte), and the text each belongs to."""
    pad, end = bytes([START]) * ORDER, bytes([END])
    buf = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    if not len(buf):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(buf != START)
    wide = buf.astype(U64)
    code = wide.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= wide[:-k] << U64(8 * k)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return code[at], np.repeat(np.arange(len(texts)), sizes)


def _weighted_unique(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]
    cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[cut], np.add.reduceat(weights, cut) if len(codes) else weights


def _count(codes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs in training texts; codes have a free top bit."""
    both = (codes << U64(1)) | train.astype(U64)
    both.sort()
    cut = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([cut, [len(both)]]))
    return _weighted_unique(both[cut] >> U64(1), np.where(both[cut] & U64(1), n, 0))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, their texts, and tokens per text."""
    w = Words(texts)
    n = len(texts)
    return (np.concatenate([w.hash, np.full(n, END_WORD)]), np.concatenate([w.doc, np.arange(n)]), w.per_doc + 1)


REQUEST = "chunk int, kind int, bucket int, codes binary, counts binary, n_train long"
_request_names = ["chunk", "kind", "bucket", "codes", "counts", "n_train"]


def _request_pass(buckets: int):
    def split(chunk, kind, codes, counts, bucket):
        order = np.argsort(bucket, kind="stable")        # codes stay sorted inside a bucket
        bucket, codes, counts = bucket[order], codes[order], counts[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cut, [*cut[1:], len(codes)]):
            yield chunk, kind, int(bucket[a]), pack(codes[a:b]), zlib.compress(counts[a:b].astype(np.int64).tobytes(), 1), 0

    def run(key, table):
        chunk = key[0].as_py()
        texts, trains = table.column("text").combine_chunks(), table.column("train").to_numpy(zero_copy_only=False)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        low, n_train = np.zeros(1 << 16, np.int64), 0
        grams: list = []
        hashes: list = []
        flags: list = []
        for lo, hi in slices(texts):
            part = as_bytes(texts.slice(lo, hi - lo))
            train = trains[lo:hi].astype(bool)
            codes, doc = gram_codes(part)
            low += np.bincount((codes[train[doc]] & U64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            grams.append(_count(codes, train[doc]))
            h, doc, n = _words(part)
            hashes.append(h)
            flags.append(train[doc])
            n_train += int(n[train].sum())
        codes, counts = _weighted_unique(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))
        owner = (mix((codes >> U64(8)) & U64(0xFFFF)) % U64(buckets)).astype(np.int64)
        rows = list(split(chunk, GRAM, codes, counts, owner))
        codes, counts = _weighted_unique(np.concatenate(hashes), np.concatenate(flags).astype(np.int64))
        rows += split(chunk, WORD, codes, counts, (codes % U64(buckets)).astype(np.int64))
        rows.append((chunk, LOW, 0, b"", zlib.compress(low.tobytes(), 1), n_train))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()])],
                        names=_request_names)

    return run


def _low_pass(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            total += np.frombuffer(zlib.decompress(blob), np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])


class Trie:
    """Contexts of one owner (orders 2 to ORDER from its grams, 0 and 1 from the low table)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, low: np.ndarray):
        known = counts > 0
        codes, counts = codes[known], counts[known]
        self.grams, self.counts, self.contexts, self.n, self.d = {}, {}, {}, {}, {}
        self.out_n = {}                                  # per context: its symbols' counts one order below
        low_codes = np.flatnonzero(low).astype(U64)
        zero = low.reshape(256, 256).sum(0)
        for k in range(ORDER, -1, -1):
            if k >= 2:
                g, c = _weighted_unique(codes & U64((1 << 8 * (k + 1)) - 1), counts)
            elif k == 1:
                g, c = low_codes, low[low_codes.astype(np.int64)]
            else:
                g = np.flatnonzero(zero).astype(U64)
                c = zero[g.astype(np.int64)]
            context = g >> U64(8)
            cut = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(g) else np.zeros(0, np.int64)
            self.grams[k], self.counts[k], self.contexts[k] = g, c, context[cut]
            self.n[k] = np.add.reduceat(c, cut) if len(g) else c
            self.d[k] = np.diff(np.concatenate([cut, [len(g)]]))
        for k in range(ORDER, 0, -1):
            g = self.grams[k]
            below = self.counts[k - 1][np.searchsorted(self.grams[k - 1], g & U64((1 << 8 * k) - 1))] if len(g) else g
            cut = np.concatenate([[0], np.cumsum(self.d[k])[:-1]]).astype(np.int64)
            self.out_n[k] = np.add.reduceat(below, cut).astype(np.int64) if len(g) else np.zeros(0, np.int64)
        self.out_n[0] = np.zeros(len(self.contexts[0]), np.int64)

    @staticmethod
    def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its context."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        gone_n, gone_d = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for k in range(ORDER, -1, -1):
            code = codes[left] & U64((1 << 8 * (k + 1)) - 1)
            at, has = self._find(self.contexts[k], code >> U64(8))
            g, seen = self._find(self.grams[k], code)
            n = np.where(has, self.n[k][at] if len(self.n[k]) else 0, 0) - gone_n[left]
            d = np.where(has, self.d[k][at] if len(self.d[k]) else 0, 0) - gone_d[left]
            hit = seen & has
            if hit.any():
                out[left[hit]] += np.log10(self.counts[k][g[hit]] / (n[hit] + d[hit]))
            escape = has & ~hit & (n > 0)
            out[left[escape]] += np.log10(d[escape] / (n[escape] + d[escape]))
            gone_n[left] = np.where(has, self.out_n[k][at] if len(self.out_n[k]) else 0, 0)
            gone_d[left] = np.where(has, self.d[k][at] if len(self.d[k]) else 0, 0)
            left = left[~hit]
        out[left] -= np.log10(np.maximum(SYMBOLS - gone_d[left], 1))
        return out


def _reply_pass(low):
    names = ["chunk", "kind", "codes", "vals", "distinct"]

    def run(key, table):
        kind = key[0].as_py()
        chunks, blobs = table.column("chunk"), table.column("codes")
        codes = [unpack(b) for b in blobs.to_pylist()]
        counts = [np.frombuffer(zlib.decompress(b), np.int64) for b in table.column("counts").to_pylist()]
        distinct, total = _weighted_unique(np.concatenate(codes), np.concatenate(counts))
        if kind == GRAM:
            values = Trie(distinct, total, low.value).log10(distinct).astype(np.float32)
        else:
            values = total
        replies = [zlib.compress(values[np.searchsorted(distinct, c)].tobytes(), 1) for c in codes]
        news = np.zeros(len(codes), np.int64)
        news[0] = int((total > 0).sum()) if kind == WORD else 0
        return pa.table([chunks, pa.array([kind] * len(codes), pa.int32()), blobs, pa.array(replies, pa.binary()),
                         pa.array(news)], names=names)

    return run


def _score_pass(key, docs, replies):
    names = ["doc_id", "train", "n_tokens", "n_known", "logs", "score"]
    tables = {}
    for kind, dtype in ((GRAM, np.float32), (WORD, np.int64)):
        own = [(c, v) for k, c, v in zip(*(replies.column(x).to_pylist() for x in ("kind", "codes", "vals"))) if k == kind]
        if own:
            codes = np.concatenate([unpack(c) for c, _ in own])
            values = np.concatenate([np.frombuffer(zlib.decompress(v), dtype) for _, v in own])
            tables[kind] = Lookup(codes), values
    texts = docs.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    out: list = [[], [], [], []]
    for lo, hi in slices(texts):
        part = as_bytes(texts.slice(lo, hi - lo))
        n = len(part)
        codes, doc = gram_codes(part)
        table, values = tables[GRAM]
        score = np.bincount(doc, weights=values[table(codes)].astype(np.float64), minlength=n)
        h, doc, tokens = _words(part)
        table, values = tables[WORD]
        c = values[table(h)]
        out[0].append(tokens)
        out[1].append(np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64))
        out[2].append(np.bincount(doc, weights=np.log10(c + 1.0), minlength=n))
        out[3].append(score)
    cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.table([docs.column("doc_id"), docs.column("train"), pa.array(cat[0], pa.int64()), pa.array(cat[1], pa.int64()),
                     pa.array(cat[2], pa.float64()), pa.array(cat[3], pa.float64())], names=names)


def ppm_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``train``: boolean column, the rows to learn from.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(p)).cast("int"))
    requests = store(rows.select("chunk", "text", "train").groupBy("chunk").applyInArrow(_request_pass(p), REQUEST),
                     "ppm-requests")
    low = np.zeros(1 << 16, np.int64)
    # at most 65,536 sums, whatever the input
    for code, n in requests.where(F.col("kind") == LOW).select("counts").mapInArrow(_low_pass, "code long, n long") \
            .groupBy("code").agg(F.sum("n")).collect():
        low[code] = n
    table = spark.sparkContext.broadcast(low)
    replies = store(requests.where(F.col("kind") != LOW).select("chunk", "kind", "bucket", "codes", "counts")
                    .groupBy("kind", "bucket")
                    .applyInArrow(_reply_pass(table), "chunk int, kind int, codes binary, vals binary, distinct long"),
                    "ppm-replies")
    n_train = requests.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    vocabulary = replies.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("chunk", "doc_id", "train", "text").groupBy("chunk").cogroup(
        replies.select("chunk", "kind", "codes", "vals").groupBy("chunk")) \
        .applyInArrow(_score_pass, f"doc_id {kind}, train boolean, n_tokens long, n_known long, logs double, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                         (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n_train + vocabulary + 1)))).alias("base_score"),
                         "score")


def op6(spark, sf_dir: str) -> DataFrame:
    """PPM and unigram scores of every document, learned from the folds crc32(doc_id) mod 7 <> 2."""
    out = ppm_scores(documents(spark, sf_dir), fold("doc_id", 7) != 2)
    return out.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")
