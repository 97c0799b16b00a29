"""Collocations: phrases of 2 to 4 words that occur together more than their parts do apart.

A phrase's score is the least, over its cuts into a first part and a rest, of
``SCALE`` * a / (l + r), floored: a, l and r count the phrase and its parts. Phrases grow
word by word, best first. As a longer phrase occurs at most as often as a part p of it,
and each rest at least as often as the phrase, every phrase that begins with p scores at most
SCALE * f(p) / (f(first word) + f(p)), and every one that ends with p at most
SCALE * f(p) / (f(last word) + f(p)). The frontier is worked off in batches: with a level per
language, all phrases whose beginning or end has a bound at or above the level are
counted. Then every phrase that scores at least the level is known, with all
counts its score needs, and so are its extensions by one word to either side, which decide
whether it survives (a longer phrase around it that is frequent enough to drop it contains
such an extension that is). A language is settled when its ``top``-th survivor is at or above the
level, ties included, or the level is 0; else its level falls and the next batch of
the frontier is counted, without what is counted already.

Words travel as 64-bit tokens of language and text. The first pass counts words by their text; the
second writes each document's tokens, breaks and infrequent words as 0, and later passes read
those. Tasks combine their counts before the shuffle, and shuffles are by phrase, so a language with
most of the rows is spread. Which phrases a task counts is decided by bitmaps of ``FILTER_BITS``
bits, a fixed size: a false hit counts a phrase too many, whose score is then exact as well.
All arithmetic on counts is in decimals of 38 digits or 64-bit integers.

Cases: a null text is empty; a null lang is `und`; a language without frequent phrases has no
rows; rows repeated count each time; an empty table gives none. Only the named columns are
read. Two frequent words of one token would be an error (chance: their number squared / 2^65).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, documents, folder, mix, partitions, slices, store

MIN_COUNT = 30
TOP = 2000
LONGEST = 4
SCALE = 2_000_000
DROP_PERCENT = 80
FILTER_BITS = 25
# what a task holds at once: n-gram occurrences to combine, tokens scanned, rows per batch sent on, distinct words
CHUNK = 1 << 20
SCAN = 1 << 18
SENT = 1 << 17
HELD_WORDS = 100_000
LEVELS = [800_000, 400_000, 200_000, 100_000, 50_000, 25_000, 12_000, 6_000, 3_000, 1_500, 700, 300]
_ENDS = b".,;:!?\n\x0b\x0c\r"
_IS_END = np.zeros(256, bool)
_IS_END[list(_ENDS)] = True
_SEPARATORS = _IS_END.copy()
_SEPARATORS[[32, 9]] = True
_TO_SPACE = bytes(32 if _SEPARATORS[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = ["w1", "w2", "w3", "w4"]


def _language(lang: str | None) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b((lang or "und").encode(), digest_size=8).digest(), "little"))


def _tokens(words: Words, langs: list) -> np.ndarray:
    codes = np.array([_language(x) for x in langs], U64)
    t = mix(words.hash ^ codes[words.doc])
    t[t == 0] = 1
    return t


def _count_words(batches):
    """(lang, word, n) of words, and (lang, null, n) of all words."""
    held: dict[str, Counter] = {}
    totals: Counter = Counter()

    def rows():
        while totals:
            lang, n = totals.popitem()
            c = held.pop(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(c) + 1), pa.string()), pa.array([*c.keys(), None], pa.binary()), pa.array([*c.values(), n], pa.int64())],
                names=["lang", "word", "n"])

    for batch in batches:
        for lo, hi in slices(batch.column(1), 4 << 20):
            for lang, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), as_bytes(batch.column(1).slice(lo, hi - lo))):
                lang = "und" if lang is None else lang
                words = text.translate(_TO_SPACE).split()
                held.setdefault(lang, Counter()).update(words)
                totals[lang] += len(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from rows()
    yield from rows()


def _name_words(batches):
    """Adds the token of (lang, word)."""
    for batch in batches:
        langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        t = _tokens(Words(words, False, _SEPARATORS), langs)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t.view(np.int64))], names=["lang", "word", "n", "token"])


def count_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n, token) of frequent words; (lang, n) of all words."""
    # counts are combined in tasks already: no second table of them is built before the shuffle, and its parts stay small
    counts = docs.mapInArrow(_count_words, "lang string, word binary, n long") \
        .repartition(partitions(docs.sparkSession), "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= min_count))
    counts = store(counts, "phrases-words")
    totals = counts.where("word is null").select("lang", "n")
    words = store(counts.where("word is not null").mapInArrow(_name_words, "lang string, word binary, n long, token long"),
                  "phrases-tokens")
    if words.groupBy("token").count().where("count > 1").limit(1).count():
        raise ValueError("two frequent words have one token")
    return words, totals


class Bits:
    """A bitmap over the leading ``size`` bits of 64-bit codes."""

    def __init__(self, size: int, rows=()):
        self.bits = np.zeros(1 << (size - 3), np.uint8)
        self.shift = U64(64 - size)
        for bucket, block in rows:
            self.bits[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(block, np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> self.shift
        return (self.bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def gram_codes(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * U64(0x9E3779B97F4A7C15) + c)
    return h


def bitmaps(grams: DataFrame, n: int, marks: dict[str, Column]) -> dict[str, Bits]:
    """A bitmap of the ``n``-grams for which each of ``marks`` (name: boolean column) holds."""
    names, size = list(marks), FILTER_BITS

    def slots(batches):
        for batch in batches:
            codes = gram_codes([batch.column(i).to_numpy().view(U64) for i in range(n)])
            slot = (codes >> U64(64 - size)).astype(np.int64)
            for kind in range(len(names)):
                here = slot[batch.column(n + kind).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), kind, np.int32)), pa.array(here + 1)],
                                                 names=["kind", "at"])

    found = grams.select(*WORDS[:n], *[c.alias(f"_{k}") for k, c in marks.items()]).mapInArrow(slots, "kind int, at long") \
        .groupBy("kind", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b"))
    blocks: dict[int, list] = {}
    for r in found.collect():                    # at most 2^FILTER_BITS bits of each kind
        blocks.setdefault(r["kind"], []).append((r["bucket"], r["b"]))
    return {k: Bits(size, blocks.get(i, ())) for i, k in enumerate(names)}


def write_tokens(docs: DataFrame, frequent) -> DataFrame:
    """One row of tokens per document; 0 for breaks between pieces and infrequent words, and at the end."""
    def run(batches):
        known = frequent.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = as_bytes(batch.column(1).slice(lo, hi - lo))
                words = Words(texts, True, _SEPARATORS)
                t = _tokens(words, batch.column(0).slice(lo, hi - lo).to_pylist())
                t[~known(t)] = 0
                # a break stands before a word if a piece or text ended since the word before it
                ends = np.cumsum(_IS_END[words.buf])[words.start] + words.doc
                cut = np.flatnonzero(np.diff(ends, prepend=ends[:1]))
                last = np.cumsum(words.per_doc)
                t = np.insert(t, np.concatenate([cut, last]), 0)
                sizes = words.per_doc + np.bincount(words.doc[cut], minlength=words.n_docs) + 1
                keep = np.ones(len(t), bool)
                keep[1:] = (t[1:] != 0) | (t[:-1] != 0)
                kept = np.add.reduceat(keep.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                offsets = np.concatenate([[0], np.cumsum(kept)])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(t[keep].view(np.int64)))], names=["tokens"])

    return store(docs.mapInArrow(run, "tokens array<long>"), "phrases-stream",
                 **{"parquet.dictionary.page.size": str(8 << 20), "compression": "zstd"})


def _combine(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct rows of the columns in ``held`` (emptied) and how often each occurs."""
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    order = np.argsort(gram_codes(columns))
    first = np.zeros(len(order), bool)
    first[:1] = True
    for i, c in enumerate(columns):
        columns[i] = c = c[order]
        first[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(first)
    return [*(c[at].view(np.int64) for c in columns), np.diff(np.append(at, len(order)))]


def count_grams(stream: DataFrame, n: int, min_count: int, wanted=None) -> DataFrame:
    """w1..wn, a: n-grams that occur ``min_count`` times; ``wanted`` picks them from their columns inside tasks."""
    names = [*WORDS[:n], "a"]

    def combined(held):
        columns = _combine(held)
        for lo in range(0, len(columns[0]), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + SENT]) for c in columns], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            flat = pc.list_flatten(batch.column(0)).to_numpy().view(U64)
            for lo in range(0, len(flat), SCAN):
                t = flat[lo:lo + SCAN + n - 1]
                if len(t) < n:
                    continue
                columns = [t[i:len(t) - n + 1 + i] for i in range(n)]
                ok = reduce(np.logical_and, [c != 0 for c in columns])
                columns = [c[ok] for c in columns]
                if wanted is not None:
                    ok = wanted(columns)
                    columns = [c[ok] for c in columns]
                held.append(columns)
                size += len(columns[0])
                if size >= CHUNK:
                    yield from combined(held)
                    size = 0
        if size:
            yield from combined(held)

    schema = ", ".join(f"{x} long" for x in names)
    return stream.mapInArrow(run, schema).repartition(partitions(stream.sparkSession), *names[:n]).groupBy(*names[:n]).agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def _grow(n: int, pairs, now, before):
    """Which n-grams to count: beginning or end open now, and not open in the batches before."""
    def wanted(columns):
        frequent, here, there = pairs.value, now.value, before.value if before is not None else None
        head, tail = gram_codes(columns[:-1]), gram_codes(columns[1:])
        ok = frequent(gram_codes(columns[:2])) & frequent(gram_codes(columns[-2:]))
        done = np.zeros(len(ok), bool)
        if there is not None:
            done = there["head"](head) | there["tail"](tail)
        return ok & ~done & (here["head"](head) | here["tail"](tail))

    return wanted


def _exact(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def _score(a, l, r) -> Column:
    total = (_exact(l) + _exact(r)).cast("decimal(21,0)")
    top = (F.lit(SCALE).cast("decimal(8,0)") * _exact(a)).cast("decimal(30,0)")
    return F.call_function("div", top, total).cast("long")


def _open(a: str, word: str) -> Column:
    """Whether the bound of phrases around ``a`` occurrences beside a word reaches the level."""
    return (F.lit(SCALE).cast("decimal(8,0)") * _exact(a)) >= F.col("level").cast("decimal(8,0)") * (_exact(word) + _exact(a))


def _with_ends(grams: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Adds lang and the counts of the first and last words."""
    first = words.select(F.col("token").alias("w1"), "lang", F.col("n").alias("f_first"))
    last = words.select(F.col("token").alias(f"w{n}"), F.col("n").alias("f_last"))
    return grams.join(first, "w1").join(last, f"w{n}").select(*WORDS[:n], "a", "lang", "f_first", "f_last")


def _with_pairs(grams: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Adds lang, the counts of the first and last words, and those of the first and last two.

    Every pair in a frequent phrase is frequent, so ``pairs`` has it, with its words' counts.
    """
    first = pairs.select("w1", "w2", "lang", "f_first", F.col("a").alias("l2"))
    last = pairs.select(*[F.col(x).alias(y) for x, y in zip(WORDS, WORDS[n - 2:n])], "f_last", F.col("a").alias("r2"))
    return grams.join(first, WORDS[:2]).join(last, WORDS[n - 2:n]) \
        .select(*WORDS[:n], "a", "lang", "f_first", "f_last", "l2", "r2")


def _scored(grams: dict[int, DataFrame], n: int) -> DataFrame:
    """lang, w1..w4 (0 beyond ``n``), a, score, l, r of ``n``-grams whose parts are all counted."""
    df = grams[n]
    cuts = []
    for k in range(1, n):
        # words and pairs came with the phrase; longer parts may be counted in a later batch than it
        left, right = F.col("f_first" if k == 1 else f"l{k}"), F.col("f_last" if n - k == 1 else f"r{n - k}")
        if k > 2:
            df = df.join(grams[k].select(*WORDS[:k], F.col("a").alias(f"l{k}")), WORDS[:k])
        if n - k > 2:
            part = grams[n - k].select(*[F.col(x).alias(y) for x, y in zip(WORDS, WORDS[k:n])], F.col("a").alias(f"r{n - k}"))
            df = df.join(part, WORDS[k:n])
        cuts.append(F.struct(_score("a", left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    rest = [F.lit(0).cast("long").alias(w) for w in WORDS[n:]]
    return df.withColumn("_cut", F.array_min(F.array(*cuts))).select(
        "lang", *WORDS[:n], *rest, "a", "_cut.score", "_cut.l", "_cut.r")


def _survivors(grams: dict[int, DataFrame], levels: DataFrame) -> DataFrame:
    """Scored phrases at or above their language's level that no longer phrase drops."""
    df = reduce(DataFrame.unionByName, [_scored(grams, n) for n in grams]) \
        .join(F.broadcast(levels), "lang").where("score >= level").drop("level")               # one row per language
    sides = [grams[n].select(*[F.col(x).alias(y) for x, y in zip(WORDS[k:], WORDS[:n - 1])],
                             *[F.lit(0).cast("long").alias(w) for w in WORDS[n - 1:]], "a") for n in grams if n > 2 for k in (0, 1)]
    if not sides:
        return df
    most = reduce(DataFrame.unionByName, sides).groupBy(*WORDS).agg(F.max("a").alias("_most"))
    return df.join(most, WORDS, "left").where(
        F.col("_most").isNull() | (_exact("_most") * 100 < _exact("a") * DROP_PERCENT)).drop("_most")


def _phrases(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the text of each phrase: one join with the words, whatever the place."""
    texts = words.select("token", F.col("word").cast("string").alias("t"))
    placed = found.select("*", F.posexplode(F.array(*WORDS)).alias("at", "token")).where("token != 0").join(texts, "token")
    return placed.groupBy("lang", *WORDS, "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("_t")) \
        .withColumn("phrase", F.array_join("_t.t", " ")).drop("_t")


def _first_levels(pairs: DataFrame, top: int) -> dict[str, int]:
    """The highest of LEVELS that ``top`` pairs of a language reach; 0 where none is."""
    score = _score("a", "f_first", "f_last")
    counts = pairs.groupBy("lang").agg(*[F.count(F.when(score >= x, 1)).alias(f"n{x}") for x in LEVELS]).collect()
    return {r["lang"]: next((x for x in LEVELS if r[f"n{x}"] >= top), 0) for r in counts}


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, min_count: int = MIN_COUNT,
                 longest: int = LONGEST, levels: dict[str, int] | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` surviving phrases.

    ``longest``: 2 to 4 words. ``levels``: where each language's frontier starts (by default chosen from its pairs).
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words, totals = count_words(docs, min_count)
    frequent = bitmaps(words.select(F.col("token").alias("w1")), 1, {"all": F.lit(True)})["all"]
    frequent = send(frequent)
    stream = write_tokens(docs, frequent)
    frequent.destroy()
    pairs = store(_with_ends(count_grams(stream, 2, min_count), words, 2), "phrases-2")
    known_pairs = send(bitmaps(pairs, 2, {"all": F.lit(True)})["all"])
    levels = {**_first_levels(pairs, top), **(levels or {})}
    grams: dict[int, DataFrame] = {2: pairs}
    before: dict[int, object] = {}
    folders = {n: folder(spark, f"phrases-{n}") for n in range(3, longest + 1)}
    while True:
        level_rows = spark.createDataFrame(list(levels.items()), "lang string, level int")
        for n in range(3, longest + 1):
            shorter = grams[n - 1].join(F.broadcast(level_rows), "lang")                       # one row per language
            now = send(bitmaps(shorter, n - 1, {"head": _open("a", "f_first"), "tail": _open("a", "f_last")}))
            more = count_grams(stream, n, min_count, _grow(n, known_pairs, now, before.get(n)))
            # one folder for all batches, so that a plan reads them as one table however many there are
            grams[n] = store(_with_pairs(more, pairs, n), f"phrases-{n}", folders[n])
            if n in before:
                before[n].destroy()
            before[n] = now
        found = store(_survivors(grams, level_rows), "phrases-survivors")
        counts = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
        open_ = [x for x, level in levels.items() if level > 0 and counts.get(x, 0) < top]
        if not open_:
            break
        # two steps down, so that the batches stay few
        levels.update({x: next(iter(LEVELS[LEVELS.index(levels[x]) + 2:] if levels[x] in LEVELS else []), 0) for x in open_})
    for sent in (known_pairs, *before.values()):
        sent.destroy()
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return _phrases(found, words) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top) \
        .join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language."""
    return collocations(documents(spark, sf_dir))


ORACLE_OP11 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
counts as (
  select lang, k, phrase, count(*)::bigint as f
  from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
        from worded, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k) group by all),
total as (select lang, sum(f)::bigint as n from counts where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k >= 2 and f >= 30),
cuts as (select lang, k, phrase, a, w, unnest(range(1, k)) as j from cand),
scored as (
  select c.lang, c.k, c.phrase, c.a, x.f as l, y.f as r, j, (2000000::hugeint * c.a) // (x.f + y.f) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1:c.k], ' ')),
cut as (select *, row_number() over (partition by lang, phrase order by score, j) as o from scored),
parts as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as most
  from (select lang, k, a, w, m, unnest(range(1, k - m + 2)) as i from cand, (select unnest([2, 3]) as m) where m < k) group by all),
kept as (
  select c.* from cut c left join parts p using (lang, phrase)
  where o = 1 and (p.most is null or 100::hugeint * p.most < 80::hugeint * c.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""
