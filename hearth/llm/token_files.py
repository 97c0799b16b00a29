"""Token-id files: Parquet with a list column of ids, in ascending document order.

Columns: doc_id, part (file number), offset (ids before the document in its
file), n_tokens, ids. Documents are range-partitioned by doc_id, so file k
holds smaller ids than file k + 1 and each file is sorted. `ids` is dictionary
encoded (or delta packed); the sorted metadata columns are delta packed in
data pages of version 2. Row groups and pages have set sizes and a page index,
so a filter on doc_id reads only the pages that hold it, and a read of the
metadata columns never touches the ids.

Texts are encoded by the `tokenizers` library. A text is cut at single spaces
and line ends between non-spaces, where byte-level pre-tokenisation cuts in any
case, and the pieces' ids are kept in a table of bounded bytes per Python worker; a
text with other spacing is encoded whole.

Cases: null and empty texts have the end id alone; a null doc_id comes first;
rows repeated with one doc_id stay, in no set order among themselves; the string of a
special token in a text becomes that token, as the library reads it; an
empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, documents, mix, partitions, slices, store

END_ID = 2
#: Most a worker's table of pieces takes, both generations; a task's share of Python memory besides its texts.
CACHE_BYTES = 64 << 20
#: Pieces of more bytes are encoded each time they are met in a slice of text.
KEY_BYTES = 24
#: Room for ids in the table, per piece; the count that marks a piece as not safe to cut.
IDS, UNSAFE = 4, 0xFFFF
BREAK = b"\xff"                    # a byte that UTF-8 never uses
SPACED = U64(0x80)                 # in a key: a space is in front
_ASCII = [chr(i) for i in range(128)]
_LETTERS = np.array([x.isalpha() for x in _ASCII] + [False] * 128)
_MARKS = np.array(["!" <= x <= "~" and not x.isalnum() and x != "'" for x in _ASCII] + [False] * 128)
_CUTS = np.isin(np.arange(256), [0x20, 0x0A, BREAK[0]])
# by place of the 8 bytes and size of the piece: which of them belong to it
_FIRST = np.array([[(1 << 8 * min(max(n - 8 * j, 0), 8)) - 1 for n in range(KEY_BYTES + 1)] for j in range(KEY_BYTES // 8)], U64)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64)
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
_worker: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


#: Latin letters and a tail of ASCII marks other than the apostrophe: two pre-tokens.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def piece_keys(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of four numbers that tell pieces of at most KEY_BYTES bytes apart: their bytes, and their length.

    ``buf`` has KEY_BYTES bytes behind the last piece."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))       # the 8 bytes from every place on
    keys = np.empty((len(start), 4), U64)
    for j in range(KEY_BYTES // 8):
        keys[:, j] = words[start + 8 * j] & _FIRST[j].take(size)
    keys[:, 3] = size
    return keys


class PieceTable:
    """Exact open-addressing table from pieces to their ids, looked up for many pieces at once."""

    def __init__(self, max_bytes: int):
        # a row of 4 numbers, 2 slots and room for IDS ids each
        self.capacity = 1 << max(3, (max_bytes // (32 + 8 + 4 * IDS)).bit_length() - 1)
        bits = self.capacity.bit_length()
        self.mask, self.shift = (1 << bits) - 1, U64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.rows = np.empty((self.capacity, 4), U64)     # the key; the last number also holds offset and count
        self.ids = np.empty(self.capacity * IDS, np.int32)
        self.n = self.used = 0

    @property
    def nbytes(self) -> int:
        return self.slots.nbytes + self.rows.nbytes + self.ids.nbytes

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * U64(0x9E3779B97F4A7C15) + keys[:, 1] * U64(0xC2B2AE3D27D4EB4F) + keys[:, 2] * U64(0x165667B19E3779F9)
        return (mix(h + keys[:, 3]) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each piece is known, where its ids begin, and how many there are (UNSAFE: not to be cut)."""
        at = self._home(keys)
        entry = self.slots.take(at)
        known = np.zeros(len(keys), bool)
        meta = np.zeros(len(keys), U64)
        todo = np.flatnonzero(entry >= 0)
        at, entry = at[todo], entry[todo]
        while len(todo):
            row = self.rows.take(entry, 0)
            differs = row ^ keys.take(todo, 0)
            differs[:, 3] &= U64(0xFF)
            hit = ~differs.any(1)
            known[todo[hit]] = True
            meta[todo[hit]] = row[hit, 3]
            miss = np.flatnonzero(~hit)
            todo, at = todo[miss], (at[miss] + 1) & self.mask
            entry = self.slots[at]
            used = entry >= 0
            todo, at, entry = todo[used], at[used], entry[used]
        return known, (meta >> U64(32)).astype(np.int64), ((meta >> U64(8)) & U64(UNSAFE)).astype(np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bool:
        """Take new pieces, told apart and unknown here, with their ids one after the other; False if there is no room."""
        if self.n + len(keys) > self.capacity or self.used + len(ids) > len(self.ids):
            return False
        sizes = np.where(counts == UNSAFE, 0, counts)
        offset = self.used + np.cumsum(sizes) - sizes
        entry = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.rows[entry] = keys
        self.rows[entry, 3] |= (offset.astype(U64) << U64(32)) | (counts.astype(U64) << U64(8))
        self.ids[self.used:self.used + len(ids)] = ids
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        at = self._home(keys)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]            # the last writer of a slot keeps it
            lost = self.slots[at] != entry
            entry, at = entry[lost], (at[lost] + 1) & self.mask
        return True


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class CachedEncoder:
    """Ids of texts as int32 arrays, pieces met before taken from a table.

    Pieces are what single spaces and line ends separate, and cuts between an ASCII letter and a mark
    other than the apostrophe; a line end belongs to the
    piece after it. Byte-level pre-tokenisation cuts there in any case, unless white
    space touches white space: but for an empty line, such texts are encoded
    whole, and so are texts with the string of an added (special) token, which the library
    reads as that token. A new piece of letters and a tail of marks goes pre-token by
    pre-token to the library's model, others go to its encoder together.
    Pieces of at most KEY_BYTES bytes are kept, by their very bytes. The table has two generations of
    half of ``cache_bytes`` each: when the young one is full the old one
    goes, and pieces still in use move back when they are next met.
    """

    def __init__(self, vocabulary: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenize = self.tokenizer.model.tokenize
        self.odd = ["\n\n\n", "\n\n ", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = str.maketrans({c: split(c)[0][0] for c in map(chr, range(0x80, 0x100)) if WORD.fullmatch(c)})
        self.space = split(" a")[0][0][0]
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.tails: dict[str, list[int]] = {}
        self.half = cache_bytes // 2
        self.young, self.old = PieceTable(self.half), PieceTable(0)

    def _plain(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32).tobytes() for e in got]

    def _tail(self, tail: str) -> list[int]:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {}
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]

    def _learn(self, pieces: list[str]) -> tuple[list, list[int]]:
        """Ids of pieces, each with its space, line end or mark in front, and which are not safe to cut."""
        found: list = [()] * len(pieces)
        others, unsafe = [], []
        tokenize, space = self.tokenize, self.space
        for i, p in enumerate(pieces):
            if p[0] == " " and p.isascii() and p[1:].isalpha():
                found[i] = [t.id for t in tokenize(space + p[1:])]
                continue
            word = WORD.fullmatch(p, 1)
            if word and p[0] in " \n":
                letters, tail = word.groups()
                if not letters.isascii():
                    letters = letters.translate(self.spelled)
                if p[0] == " ":
                    ids = [t.id for t in tokenize(space + letters)]
                else:
                    ids = [*self.line_end, *[t.id for t in tokenize(letters)]]
                found[i] = ids + self._tail(tail) if tail else ids
            elif p == "\n":
                found[i] = self.line_end
            else:
                body = p[1:] if p[0] in " \n" else p
                if body and not body[0].isspace() and not body[-1].isspace():      # no white space touches it
                    others.append(i)
                else:
                    unsafe.append(i)
        if others:
            for i, e in zip(others, self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)):
                found[i] = e.ids
        return found, unsafe

    def _keep(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        if not len(keys) or self.young.add(keys, counts, ids):
            return
        self.young, self.old = PieceTable(self.half), self.young
        if not self.young.add(keys, counts, ids) and len(keys) > 1:     # too many at once: half of them
            half = len(keys) // 2
            cut = int(np.where(counts[:half] == UNSAFE, 0, counts[:half]).sum())
            self._keep(keys[:half], counts[:half], ids[:cut])

    def __call__(self, texts: list[str]) -> list[bytes]:
        raw = b"".join([BREAK + t.encode() for t in texts]) + BREAK
        buf = np.frombuffer(raw + bytes(KEY_BYTES + 8), np.uint8)
        is_cut = _CUTS[buf[:len(raw)]]
        is_cut[1:] |= _MARKS[buf[1:len(raw)]] & _LETTERS[buf[:len(raw) - 1]]
        cuts = np.flatnonzero(is_cut)
        front = buf[cuts[:-1]]
        first = front == BREAK[0]
        start, end = cuts[:-1] + (first | (front == 0x20)), cuts[1:]
        doc = np.cumsum(first) - 1
        odd = [x for x in self.odd if x.encode() in raw]
        whole = np.fromiter((not t or t[0] in "\n " or t.endswith("\n\n") or any(x in t for x in odd)
                             for t in texts), bool, len(texts))
        opening = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
        whole |= np.fromiter((x[-1:].isspace() for x in opening), bool, len(texts))

        use = np.flatnonzero(~first & ~whole[doc])
        start, size, doc, spaced = start[use], (end - start)[use], doc[use], front[use] == 0x20
        short = np.flatnonzero(size <= KEY_BYTES)
        keys = np.zeros((len(use), 4), U64)
        keys[short] = piece_keys(buf, start[short], size[short])
        keys[spaced, 3] |= SPACED
        source, offset, count = (np.full(len(use), x, np.int64) for x in (2, 0, 0))
        todo, sources = short, []
        for i, table in enumerate((self.young, self.old)):
            known, o, n = table.find(keys[todo])
            at = todo[known]
            source[at], offset[at], count[at] = i, o[known], n[known]
            todo = todo[~known]
            sources.append(table.ids)
        # new pieces and long ones: each distinct one is encoded once, and kept if it is short
        new = np.flatnonzero(source == 2)
        index: dict[bytes, int] = {}
        which = np.array([index.setdefault(raw[a:b], len(index)) for a, b in
                          zip((start - spaced)[new].tolist(), (start + size)[new].tolist())], np.int64)
        got, unsafe = self._learn([p.decode() for p in index])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        counts = sizes.copy()
        counts[unsafe] = UNSAFE
        begin = np.cumsum(sizes) - sizes
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
        sources.append(ids)
        offset[new], count[new] = begin[which], counts[which]
        sample = np.zeros(len(index), np.int64)
        sample[which] = new
        fits = np.flatnonzero((size[sample] <= KEY_BYTES) & (sizes < UNSAFE))
        self._keep(keys[sample[fits]], counts[fits], ids[_ranges(begin[fits], sizes[fits])])
        again = np.flatnonzero(source == 1)
        if len(again):
            # of two pieces with one hash, one stays behind and is learned again
            one = again[np.unique(keys[again] @ _SPREAD, return_index=True)[1]]
            n = np.where(count[one] == UNSAFE, 0, count[one])
            self._keep(keys[one], count[one], sources[1][_ranges(offset[one], n)])

        whole[doc[count == UNSAFE]] = True
        count[count == UNSAFE] = 0
        last = np.cumsum(count)
        values = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for i, pool in enumerate(sources):
            at = np.flatnonzero(source == i)
            values[_ranges(last[at] - count[at], count[at])] = pool[_ranges(offset[at], count[at])]
        ends = np.concatenate([[0], last])[np.searchsorted(doc, np.arange(len(texts) + 1))]
        cut = [x for x, w in zip(opening, whole.tolist()) if not w]
        head = dict(zip(cut, self._plain(cut)))
        return [(self._plain([t])[0] if t else b"") if w else head[x] + values[a:b].tobytes()
                for t, w, x, a, b in zip(texts, whole.tolist(), opening, ends[:-1].tolist(), ends[1:].tolist())]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
           end_id: int = END_ID) -> DataFrame:
    """doc_id, part, offset, n_tokens, ids: documents in ascending doc_id order over ascending parts."""
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], np.int32).tobytes()
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext
        part, before = TaskContext.get().partitionId(), 0
        if vocabulary not in _worker:
            _worker[vocabulary] = CachedEncoder(vocabulary)
        encoder = _worker[vocabulary]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in slices(texts):
                got = encoder(texts.slice(lo, hi - lo).to_pylist())
                sizes = np.array([len(g) // 4 + 1 for g in got], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                values = np.frombuffer(b"".join(x for g in got for x in (g, end)), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(got), part, np.int32)),
                     pa.array(before + ends[:-1]), pa.array(sizes), ids],
                    names=["doc_id", "part", "offset", "n_tokens", "ids"])
                before += int(ends[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id") \
        .mapInArrow(run, "doc_id long, part int, offset long, n_tokens long, ids array<int>")


def write_token_files(encoded: DataFrame, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Write to the shared folder in the file format; returns the files' reader."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0",
               "parquet.enable.dictionary": "false", "parquet.page.size": str(page_bytes),
               "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
               "parquet.dictionary.page.size": str(4 << 20), "parquet.block.size": str(row_group_bytes),
               "parquet.page.write-checksum.enabled": "true"}
    return store(encoded, "token-files", **options)


def _digest(batches):
    for batch in batches:
        ids = batch.column(1)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(crc, pa.int64())],
                                         names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from written files.

    Starts come from the metadata columns: one sum per file, and a running
    sum over the files (one row each).
    """
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = files.select("doc_id", "ids", "part", "offset", "n_tokens") \
        .mapInArrow(_digest, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")
    # one row per file, so the small side is bounded by the number of files
    return rows.join(F.broadcast(starts), "part") \
        .select("doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op9(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, read back from the written files."""
    return read_digests(write_token_files(encode(documents(spark, sf_dir))))
