"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives Viterbi.

The automaton over all pieces reads a text once; at each position its
output links give every piece that ends there, longest first, and each relaxes
the best score of that position (score of the piece's start plus the piece's
own score). Equal sums keep the longer piece. A character that no piece covers
is spelled in byte pieces, at ``FALLBACK`` below the lowest piece score.

Spaces are written as U+2581, with one in front of a text, as the vocabulary
expects. No piece has a space after another character (checked when the
vocabulary is loaded), so the best path passes every start of a word: words
are encoded alone, each distinct one once per Python worker (bounded table).

The path maximises the sum of the file's own scores. In a unigram file these are log
probabilities, and the ids are the ones SentencePiece gives. The default file is a BPE model,
whose scores are the ranks of its merges: there the sum is no probability, `score`
only orders paths, and the ids differ from the library's, which applies merges one by one (over
the 200 documents of sf0.001 218,524 pieces here, 191,304 there). Decoding is exact either way.

Cases: null and empty texts have no piece; U+2581 in a text is spelled in
bytes, so decoding is exact for every text; long texts and words need memory
in proportion; repeated rows are encoded each; an empty table gives none.
Only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, store

SPACE = "▁"
OWN_SPACE = "\udc81"          # U+2581 of the text itself; a lone surrogate is in no valid text
FALLBACK = 10.0
CACHE_ENTRIES = 500_000
DECODE_ROWS = 500
_worker: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, byte or other (control and unknown)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        other = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        out.append((model.id_to_piece(i), model.get_score(i), "byte" if model.is_byte(i) else "other" if other else "piece"))
    return out


class PieceCoder:
    def __init__(self, pieces: list[tuple[str, float, str]], entries: int = CACHE_ENTRIES):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        scores = [s for _, s, kind in pieces if kind == "piece"]
        self.unknown = min(scores, default=0.0) - FALLBACK
        self.unk_id = next((i for i, (_, _, k) in enumerate(pieces) if k == "other"), 0)
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "piece":
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} has a space after another character")
                self.automaton.add_word(piece, (len(piece), i, score))
            elif kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
            self.bytes_of.append(piece.replace(SPACE, " ").encode() if kind == "piece"
                                 else bytes([int(piece[3:5], 16)]) if kind == "byte" else b"")
        self.automaton.make_automaton()
        self.entries, self.cache = entries, {}

    def viterbi(self, s: str) -> tuple[list[int], float]:
        """Best pieces of a word (spaces already written as U+2581) and their score."""
        worst = float("-inf")
        best, back = [worst] * (len(s) + 1), [None] * (len(s) + 1)
        best[0], settled = 0.0, 0
        for end, (size, piece, score) in self.automaton.iter(s):
            while settled < end:                 # positions that no piece ends at
                settled += 1
                if best[settled] == worst:
                    best[settled], back[settled] = best[settled - 1] + self.unknown, (1, None)
            got = best[end + 1 - size] + score
            if got > best[end + 1]:
                best[end + 1], back[end + 1] = got, (size, piece)
        while settled < len(s):
            settled += 1
            if best[settled] == worst:
                best[settled], back[settled] = best[settled - 1] + self.unknown, (1, None)
        ids, at = [], len(s)
        while at:
            size, piece = back[at]
            if piece is None:
                char = SPACE if s[at - 1] == OWN_SPACE else s[at - 1]
                ids += [self.byte_id.get(b, self.unk_id) for b in reversed(char.encode())]
            else:
                ids.append(piece)
            at -= size
        return ids[::-1], best[-1]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian 32-bit integers, and the score."""
        if not text:
            return b"", 0.0
        if SPACE in text:
            text = text.replace(SPACE, OWN_SPACE)
        words = text.split(" ")
        if "" in words:                          # several spaces in a row stay with the word after them
            merged, run = [], ""
            for w in words[:-1]:
                if w:
                    merged.append(run + w)
                    run = ""
                else:
                    run += SPACE
            words = [*merged, run + words[-1]]
        cache = self.cache
        if len(cache) > self.entries:
            cache.clear()
        try:
            got = [cache[w] for w in words]
        except KeyError:
            for w in {w for w in words if w not in cache}:
                ids, score = self.viterbi(SPACE + w)
                cache[w] = (np.array(ids, "<i4").tobytes(), score)
            got = [cache[w] for w in words]
        return b"".join([g[0] for g in got]), sum([g[1] for g in got])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def _coder(pieces, key) -> PieceCoder:
    if key not in _worker:
        _worker[key] = PieceCoder(pieces)
    return _worker[key]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                  digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, n_pieces, score and `ids`; with ``digest`` instead of ids
    their crc32 and `round_trip`, whether decoding them gives the text back.

    The pieces (a file's fixed table) travel with the function.
    """
    pieces = load_pieces(vocabulary or default_vocabulary())
    key = (vocabulary, len(pieces))

    def run(batches):
        coder = _coder(pieces, key)
        for batch in batches:
            for lo, hi in slices(batch.column(0), 4 << 20):
                texts = [t or "" for t in batch.column(0).slice(lo, hi - lo).to_pylist()]
                got = [coder.encode(t) for t in texts]
                sizes = np.array([len(g) // 4 for g, _ in got], np.int64)
                columns = [*batch.slice(lo, hi - lo).columns[1:], pa.array(sizes),
                           pa.array([s for _, s in got], pa.float64())]
                names = ["doc_id", *keep, "n_pieces", "score"]
                if digest:
                    same = [coder.decode(np.frombuffer(g, "<i4").tolist()) == t for (g, _), t in zip(got, texts)]
                    columns += [pa.array([zlib.crc32(g) for g, _ in got], pa.int64()), pa.array(same, pa.bool_())]
                    names += ["ids_crc32", "round_trip"]
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    values = np.frombuffer(b"".join(g for g, _ in got), np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    carried = docs.select(F.col(id_col).alias("doc_id"), *keep)
    last = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *keep) \
        .mapInArrow(run, f"{_fields(carried)}, n_pieces long, score double, {last}")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def decode_pieces(encoded: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, ids, text and crc32 of the ids, of rows with `ids` (null ids: empty text)."""
    pieces = load_pieces(vocabulary or default_vocabulary())
    key = (vocabulary, len(pieces))

    def run(batches):
        coder = _coder(pieces, key)
        coder.cache.clear()                      # words of an encoding before; only room is lost
        for batch in batches:
            for lo in range(0, len(batch), DECODE_ROWS):
                part = batch.slice(lo, DECODE_ROWS)
                ids = part.column(0)
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                own = [flat[a:b] if ok else flat[:0] for a, b, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], ids, pa.array([coder.decode(x.tolist()) for x in own], pa.string()),
                     pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in own], pa.int64())],
                    names=["doc_id", *keep, "ids", "text", "ids_crc32"])

    return encoded.select("ids", "doc_id", *keep) \
        .mapInArrow(run, f"{_fields(encoded.select('doc_id', *keep))}, ids array<int>, text string, ids_crc32 long")


def checked_pieces(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, n_pieces, score, ids, and of the ids as written and read again:
    their crc32 and `round_trip`, whether they decode to the text (by its length and SHA-256).
    """
    seen = lambda text: F.concat_ws(":", F.octet_length(text), F.sha2(text, 256))
    docs = docs.withColumn("_seen", seen(F.coalesce("text", F.lit(""))))
    encoded = store(encode_pieces(docs, keep=(*keep, "_seen")), "pieces")
    carried = (*keep, "n_pieces", "score")
    return decode_pieces(encoded, keep=(*carried, "_seen")) \
        .select("doc_id", *carried, "ids", "ids_crc32", (seen("text") == F.col("_seen")).alias("round_trip"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Pieces of every whole text: count, score, ids, their crc32, and whether they decode to the text."""
    return checked_pieces(documents(spark, sf_dir))
