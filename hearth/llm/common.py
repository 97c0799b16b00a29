"""Shared pieces: written intermediate tables, Arrow batch access, word scanning, packed integers.

Word scanning works on UTF-8 bytes: the separators (space, tab to carriage
return) are single bytes that never occur inside a multi-byte character,
so byte offsets cut words exactly where code-point offsets would.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

U64 = np.uint64
WORD_CHARS = r"[^\x20\x09-\x0D]+"
#: Text handled at once inside a task; numpy temporaries are some 60 times this.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, into: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back,
    with what ``into``, if given, holds of earlier calls.

    Later plans start from the files: a lost executor re-reads them, and
    nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = into or folder(spark, name)
    df.write.mode("append").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done.

    It does so when the driver's garbage is collected, which else depends on the driver's heap,
    not on the disk that shuffles take.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``store`` that no later plan reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield start, stop
        start = stop


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The rows' UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in pc.cast(texts, pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, _INV, U64)
        up[0] = down[0] = 1
        _pow.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _pow["up"], _pow["down"]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a list of byte texts: byte spans, owning row and 64-bit hash, in text order."""

    def __init__(self, texts: list[bytes], lower: bool = True, separators: np.ndarray = _IS_SPACE):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            buf = _LOWER[buf]
        space = separators[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        up, down = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * up[:len(buf)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))
        self.buf = buf
        self.n_docs = len(texts)
        self.per_doc = np.bincount(self.doc, minlength=len(texts))


def pack(sorted_codes: np.ndarray) -> bytes:
    """Sorted 64-bit codes as compressed byte planes of their differences."""
    d = np.diff(sorted_codes.astype(U64), prepend=U64(0))
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


class Lookup:
    """Open-addressing table from distinct 64-bit codes to their index; absent codes give -1."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, U64(64 - bits)
        self.key = np.zeros(1 << bits, U64)
        self.val = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(codes), dtype=np.int32), self._home(codes)
        while len(left):
            free = self.val[at] < 0
            self.val[at[free]] = left[free]          # the last writer of a slot keeps it
            lost = self.val[at] != left
            won = ~lost
            self.key[at[won]] = codes[left[won]]
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, codes):
        return ((codes * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self._home(codes)
        val = self.val[at]
        out = np.where(self.key[at] == codes, val, np.int32(-1))
        todo = np.flatnonzero((self.key[at] != codes) & (val >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            val, hit = self.val[at], self.key[at] == codes[todo]
            ok = hit & (val >= 0)
            out[todo[ok]] = val[ok]
            go = ~hit & (val >= 0)
            todo, at = todo[go], at[go]
        return out
