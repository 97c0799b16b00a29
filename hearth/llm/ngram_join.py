"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

A document's set is its distinct word n-grams (lower-cased A-Z, 64-bit
hashes, sorted). Two link when 100 * intersection >= percent * union.

1. Equal sets are one class (sum hash and size); everything below works on
   classes, so copies are never paired.
2. Sizes fall into bands. A linked pair of a band differs in at most H
   elements, so of H + 1 + E parts of the hash space at least 1 + E hold
   the same elements on both sides. Each non-empty part of a set is a key
   (a set of all elements with over E empty parts, which is rare, also gives
   keys of those), so
   linked sets of two or more elements always share a key, while unlinked ones
   must agree in all some five n-grams of a part: shared passages and frequent
   lines don't make candidates.
   Parts are cut from the elements that are not common: any fixed set of
   elements may be left out on both sides without adding differences. Common
   is what a Bloom filter of fixed size, filled with the elements most often
   met twice in a task, says; a set with too many empty parts (mostly common
   elements) gives the keys of all its elements as well, and so do all others
   like it, so nothing is lost whatever the filter holds.
   Keys go to their buckets in packed arrays; a bucket hangs all sets with
   one key on the smallest. Components of these links are clusters.
3. A cluster is a tile; a large one is cut by size band and hash into tiles of bounded rows and bytes,
   and each pair of tiles in equal or neighbouring bands is one task's work,
   so a group of any size is spread and its pairs are never rows. Sets meet
   in as many tiles as their cluster has nearby, so tiles are made in rounds that each
   send about as many bytes as all sets have: disk follows the input, not the square of a group.
4. In a tile, parity bitmaps bound the overlap from above: differing bits are
   differing elements, so overlap <= (|A| + |B| - differing bits) / 2. Pairs
   that can still link are intersected exactly as sorted arrays. A tile gives
   each class its number of linked documents and its smallest linked one.

Cases: null and empty texts and texts without words have the empty set, link
with nothing and are their own component; fewer than n words are one n-gram;
repeated rows are documents that link; a null doc_id takes the component of
its equal sets, null if there is none with an id; an empty table gives none.
Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, discard, documents, folder, mix, partitions, release, slices, store
from .components import components

#: Sets of a tile and their bytes, at most (about, as a hash deals them).
TILE = 4096
TILE_BYTES = 16 << 20
#: Sets whose bitmaps are compared at once.
BLOCK = 512
#: Bytes that a round of tiles sends at least, if there is that much.
ROUND_BYTES = 64 << 20
BITS = 1024
RATIO = 1.25
#: Common elements in the filter at most, and the filter's size: fixed, whatever the input.
COMMON = 1 << 20
FILTER_BITS = 25
COMMON_COUNT = 12
FLUSH_KEYS = 1 << 20


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one after the other, and the texts' bounds."""
    words = Words(texts)
    h, count = words.hash, words.per_doc
    grams = np.zeros(0, U64)
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            grams = mix(grams + h[k:len(h) - n + 1 + k] + U64(k + 1))
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], U64)
    for i in range(len(texts)):
        if count[i] >= n:
            own = out[at[i]:at[i + 1]]
            own[:] = grams[first[i]:first[i + 1] - n + 1]
            own.sort()
        elif count[i]:
            one = np.full(1, U64(0x51ED27 + int(count[i])))
            for k in range(first[i], first[i + 1]):
                one = mix(one + h[k])
            out[at[i]] = one[0]
    doc = np.repeat(np.arange(len(texts)), size)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each set (0 for the empty one)."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(0xA5A5A5A55A5A5A5A)), dtype=U64)])
    sig = mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64))
    return np.where(np.diff(bounds) == 0, U64(0), sig)


def band_edges(percent: int, limit: int) -> list[int]:
    """First sizes of the bands: below the first one only equal sets link."""
    first = 1
    while 100 * first < percent * (first + 1):      # first elements of first + 1
        first += 1
    edges = [first]
    while edges[-1] <= limit:
        # linked sets lie in one band or the next: a band reaches 100 / percent times its first size
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * RATIO), -(-100 * edges[-1] // percent)))
    return edges


def is_common(filter_bits: np.ndarray | None, sets: np.ndarray) -> np.ndarray:
    if filter_bits is None:
        return np.zeros(len(sets), bool)
    out = np.ones(len(sets), bool)
    for shift in (0, 24):
        at = (sets >> U64(shift)) & U64((1 << FILTER_BITS) - 1)
        out &= (filter_bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _band_keys(h, doc, n_own, parts, salt):
    """Non-empty parts of a band's sets: keys, their set, and which parts."""
    part = ((h >> U64(32)) * U64(parts)) >> U64(32)
    cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else \
        np.zeros(0, np.int64)
    sums = np.add.reduceat(mix(h), cut) if len(h) else np.zeros(0, U64)
    return mix(sums + part[cut] * U64(0xD1B54A32D192ED03) + salt), doc[cut], part[cut]


def part_keys(sets: np.ndarray, bounds: np.ndarray, sig: np.ndarray, percent: int,
              common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets in all their bands, and the signature each key came from."""
    size = np.diff(bounds)
    edges = band_edges(percent, int(size.max(initial=0)) * 2 + 2)
    if common is None:
        common = np.zeros(len(sets), bool)
    keys, sigs = [], []
    band = np.searchsorted(edges, size, side="right") - 1
    for j in range(len(edges) - 1):
        upper = edges[j + 1] - 1
        differ = 2 * upper * (100 - percent) // (100 + percent)
        spare = 1 + -(-differ // 12)
        parts = differ + 1 + spare
        # sets of the band, and smaller ones that can link with a set of it
        own = np.flatnonzero((band == j) | ((band == j - 1) & (100 * size >= percent * edges[j])))
        if not len(own):
            continue
        salt = U64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for whole in (False, True):
            n = size[own]
            at = np.repeat(bounds[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            doc = np.repeat(np.arange(len(own)), n)
            if not whole:
                rare = ~common[at]
                at, doc = at[rare], doc[rare]
            key, of, part = _band_keys(sets[at], doc, len(own), parts, salt + U64(whole))
            keys.append(key)
            sigs.append(sig[own][of])
            short = np.flatnonzero(parts - np.bincount(of, minlength=len(own)) > spare)
            if not whole:
                own = own[short]                     # too many empty parts: all elements count
                if not len(own):
                    break
                continue
            for i in short:
                empty = np.setdiff1d(np.arange(parts, dtype=U64), part[of == i])
                keys.append(mix(empty * U64(0xD1B54A32D192ED03) + salt + U64(2)))
                sigs.append(np.full(len(empty), sig[own][i]))
    if not keys:
        return np.zeros(0, U64), np.zeros(0, U64)
    return np.concatenate(keys), np.concatenate(sigs)


def _common_pass(n: int):
    """Elements that several distinct sets of a task hold, with their number."""
    def run(batches):
        seen, held = set(), []
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                sets, bounds = shingle_sets(as_bytes(batch.column(0).slice(lo, hi - lo)), n)
                for i, s in enumerate(signatures(sets, bounds).tolist()):
                    if s and s not in seen:
                        seen.add(s)
                        held.append(sets[bounds[i]:bounds[i + 1]])
                if sum(map(len, held)) > 16 * FLUSH_KEYS:
                    yield from several(held)
                    held = []
        if held:
            yield from several(held)

    def several(held):
        h = np.concatenate(held)
        h.sort()
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff([*cut, len(h)])
        often = count > 2
        yield pa.RecordBatch.from_arrays([pa.array(h[cut][often].view(np.int64)), pa.array(count[often])], names=["h", "c"])

    return run


def common_filter(docs: DataFrame, n: int) -> np.ndarray:
    """Bloom filter over the elements most often met more than twice in one task; at most COMMON of them.

    Which elements it holds decides only how well keys discriminate, never
    which links are found, so the limit loses nothing.
    """
    counts = docs.select("text").mapInArrow(_common_pass(n), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")) \
        .where(F.col("c") >= COMMON_COUNT).orderBy(F.desc("c"), "h").limit(COMMON).select("h").toArrow()
    h = counts.column(0).to_numpy().view(U64)
    bits = np.zeros(1 << FILTER_BITS, bool)
    for shift in (0, 24):
        bits[((h >> U64(shift)) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _signature_pass(n: int):
    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                sets, bounds = shingle_sets(as_bytes(batch.column(1).slice(lo, hi - lo)), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(signatures(sets, bounds).view(np.int64)),
                     pa.array(np.diff(bounds).astype(np.int64))], names=["doc_id", "sig", "n"])

    return run


def _key_pass(n: int, percent: int, buckets: int, common):
    def flush(keys, sigs):
        key, sig = np.concatenate(keys), np.concatenate(sigs)
        bucket = key % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, key, sig = bucket[order], key[order], sig[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = [*cut[1:], len(key)]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut].astype(np.int64)),
             pa.array([np.stack([key[a:b], sig[a:b]]).tobytes() for a, b in zip(cut, ends)], pa.binary())],
            names=["bucket", "entries"])

    def run(batches):
        seen: set[int] = set()          # signatures of this task's partition
        keys, sigs, held = [], [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                sets, bounds = shingle_sets(as_bytes(batch.column(0).slice(lo, hi - lo)), n)
                sig = signatures(sets, bounds)
                fresh = np.zeros(len(sig), bool)
                for i, s in enumerate(sig.tolist()):
                    if s and s not in seen:
                        seen.add(s)
                        fresh[i] = True
                size = np.where(fresh, np.diff(bounds), 0)
                at = np.flatnonzero(np.repeat(fresh, np.diff(bounds)))
                k, s = part_keys(sets[at], np.concatenate([[0], np.cumsum(size)]), sig, percent,
                                 is_common(common.value, sets[at]))
                keys.append(k)
                sigs.append(s)
                held += len(k)
                if held > FLUSH_KEYS:
                    yield flush(keys, sigs)
                    keys, sigs, held = [], [], 0
        if held:
            yield flush(keys, sigs)

    return run


def _runs(batches, column: str):
    """Tables of consecutive rows with one value of ``column`` (rows arrive sorted by it)."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = batch.column(column).to_pylist()
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                if held and values[start] != current:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = values[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield current, pa.Table.from_batches(held)


def _link_pass(batches):
    """Hang all sets that share a key on the smallest of them."""
    for _, table in _runs(batches, "bucket"):
        both = [np.frombuffer(x, U64).reshape(2, -1) for x in table.column("entries").to_pylist()]
        key, sig = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
        order = np.argsort(key)
        key, sig = key[order], sig[order]
        twin = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        key, sig = key[twin], sig[twin].view(np.int64)
        if not len(key):
            continue
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.minimum.reduceat(sig, cut)
        a = np.repeat(least, np.diff([*cut, len(key)]))
        pairs = np.unique(np.stack([a, sig], 1)[a != sig], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _set_pass(n: int, kept: list[str]):
    """The candidate rows' sets as binary columns; rows whose text is not the class's are dropped."""
    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets, bounds = shingle_sets(as_bytes(part.column("text")), n)
                ok = signatures(sets, bounds).view(np.int64) == part.column("sig").to_numpy()
                blobs = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(blobs, pa.binary())],
                                                 names=[*kept, "grams"])
                yield out.filter(pa.array(ok))

    return run


def bitmaps(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Parity of the elements per hashed bit, one row a set."""
    out = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((mix(s) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return out


def link_tile(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int):
    """Linked pairs (i, distinct js), block by block: within ``left`` (i < j), or between ``left`` and ``right``."""
    other = left if right is None else right
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in other])
    if not len(a) or not len(b):
        return
    left_bits = bitmaps(left)
    other_bits = left_bits if right is None else bitmaps(other)
    for lo in range(0, len(a), BLOCK):
        own, x = a[lo:lo + BLOCK], left_bits[lo:lo + BLOCK].astype(np.float32)
        for start in range(lo if right is None else 0, len(b), BLOCK):
            size = b[start:start + BLOCK]
            if 100 * own.max() < percent * size.min() or 100 * size.max() < percent * own.min():
                continue
            y = other_bits[start:start + BLOCK].astype(np.float32)
            differ = x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * (x @ y.T)
            total = own[:, None] + size[None, :]
            bound = (total - differ) // 2
            maybe = ((100 + percent) * np.minimum(bound, np.minimum(own[:, None], size[None, :])) >= percent * total)
            if right is None and start == lo:
                maybe = np.triu(maybe, 1)
            for i in np.flatnonzero(maybe.any(1)):
                js = np.flatnonzero(maybe[i]) + start
                mine, cat = left[lo + i], np.concatenate([other[j] for j in js])
                at = np.searchsorted(mine, cat)
                hit = mine[np.minimum(at, len(mine) - 1)] == cat
                inter = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(b[js])[:-1]]), dtype=np.int64)
                good = js[(100 + percent) * inter >= percent * (own[i] + b[js])]
                if len(good):
                    yield int(lo + i), good


def _tile_pass(percent: int):
    def run(batches):
        for tile, table in _runs(batches, "tile"):
            seen, rows = set(), []
            for rep, m, side, sig, blob in zip(*(table.column(c).to_pylist() for c in ("rep", "m", "side", "sig", "grams"))):
                if sig not in seen:              # the same text may stand in several rows
                    seen.add(sig)
                    rows.append((side, len(blob), rep, m, np.frombuffer(blob, U64)))
            rows.sort(key=lambda r: r[:3])
            split = sum(r[0] == 0 for r in rows)
            place = tile.split("/")[1:]          # of a large cluster: band and tile of both sides
            within = place[:2] == place[2:]
            if not within and split in (0, len(rows)):
                continue
            sets = [r[4] for r in rows]
            found = link_tile(sets, None, percent) if within else link_tile(sets[:split], sets[split:], percent)
            rep, m = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, js in found:
                js = js if within else js + split
                links[i] += m[js].sum()
                links[js] += m[i]
                for j in np.unique(root[js]):
                    p, q = top(i), top(j)
                    if p != q:
                        if rep[p] > rep[q]:
                            p, q = q, p
                        root[q] = p
            used = np.flatnonzero(links)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[used]), pa.array([int(rep[top(i)]) for i in used], pa.int64()), pa.array(links[used]),
                     pa.array([tile.count("/") > 0] * len(used))], names=["rep", "root", "links", "large"])

    return run


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
                  tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id, over any number of links), n_links (linked documents)."""
    spark = docs.sparkSession
    p = partitions(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = store(docs.mapInArrow(_signature_pass(n), "doc_id long, sig long, n long"), "ngram-rows")
    classes = rows.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))

    common = spark.sparkContext.broadcast(common_filter(docs, n))      # 4 MB, a fixed size
    keys = docs.select("text").mapInArrow(_key_pass(n, percent, 4 * p, common), "bucket long, entries binary")
    edges = keys.repartition(p, "bucket").sortWithinPartitions("bucket") \
                .mapInArrow(_link_pass, "a long, b long")
    clusters = components(edges, "ngram-clusters")

    bands = F.floor(F.log(F.col("n").cast("double")) / math.log(1.001 * 100 / percent)).cast("int")
    found = store(classes.where("rep is not null").join(clusters.withColumnsRenamed({"node": "sig", "root": "cluster"}), "sig")
                  .withColumn("band", bands), "ngram-candidates")
    release(spark)
    size = F.sum(F.col("n") * 8)
    tiles = found.groupBy("cluster", "band").agg(F.count("*").alias("c"), size.alias("b")) \
        .groupBy("cluster").agg(F.sum("c").alias("total"), F.sum("b").alias("bytes"), F.map_from_entries(F.collect_list(F.struct(
            "band", F.greatest(F.ceil(F.col("c") / tile), F.ceil(F.col("b") / TILE_BYTES)).cast("int").alias("k")))).alias("k"))
    k = lambda d: F.coalesce(F.try_element_at("k", F.col("band") + d), F.lit(0))
    small = (F.col("total") <= tile) & (F.col("bytes") <= TILE_BYTES)
    spot = F.struct("cluster", "band", small.alias("small"), F.pmod(F.xxhash64("sig"), k(0)).cast("int").alias("t"),
                    k(0).alias("here"), k(1).alias("up"), k(-1).alias("down"))
    placed = store(found.join(tiles, "cluster").select("rep", "sig", "m", "n", spot.alias("spot")), "ngram-tiles")
    copies = F.when(F.col("spot.small"), 1).otherwise(F.col("spot.here") + F.col("spot.up") + F.col("spot.down"))
    held, sent = placed.agg(size, F.sum(F.col("n") * 8 * copies)).first()
    rounds = max(1, -(-(sent or 0) // max(ROUND_BYTES, held or 0)))

    kept = ["rep", "sig", "m", "spot"]
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    sets = docs.join(placed.drop("n").withColumnRenamed("rep", "_r"), F.col("doc_id") == F.col("_r")).withColumnRenamed("_r", "rep") \
        .select(*kept, "text").mapInArrow(_set_pass(n, kept), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", grams binary")
    at = folder(spark, "ngram-sets")
    if rounds > 1:
        sets = store(sets, "ngram-sets", into=at)
        release(spark)
    cluster, band, t = (F.col(f"spot.{c}") for c in ("cluster", "band", "t"))
    name = lambda b1, i, b2, j: F.concat_ws("/", cluster, b1, i, b2, j)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda t, side: F.struct(t.alias("tile"), side.cast("int").alias("side"))
    pairs = F.concat(
        F.transform(up_to(F.col("spot.here")), lambda j: one(name(band, F.least(t, j), band, F.greatest(t, j)), (t > j).cast("int"))),
        F.transform(up_to(F.col("spot.up")), lambda j: one(name(band, t, band + 1, j), F.lit(0))),
        F.transform(up_to(F.col("spot.down")), lambda j: one(name(band - 1, j, band, t), F.lit(1))))
    pairs = F.when(F.col("spot.small"), F.array(one(cluster.cast("string"), F.lit(0)))).otherwise(pairs)
    links = folder(spark, "ngram-links")
    for turn in map(F.lit, range(rounds)):
        now = F.filter(pairs, lambda x: F.pmod(F.xxhash64(x["tile"]), F.lit(rounds)) == turn)  # noqa: B023
        work = sets.select("rep", "sig", "m", "grams", F.explode(now).alias("p")).select("rep", "sig", "m", "grams", "p.tile", "p.side")
        linked = store(work.repartition(p, "tile").sortWithinPartitions("tile")
                       .mapInArrow(_tile_pass(percent), "rep long, root long, links long, large boolean"), "ngram-links", into=links)
        release(spark)
    if rounds > 1:
        discard(spark, at)
    roots = linked.where("not large").select(F.col("rep").alias("node"), "root") \
        .unionByName(components(linked.where("large").select(F.col("root").alias("a"), F.col("rep").alias("b")),
                                "ngram-components"))
    verdict = classes.join(linked.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left") \
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("sig", "n", "m", F.coalesce("root", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(store(verdict, "ngram-verdict"), ["sig", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("m") - 1 + F.col("links")).cast("long").alias("n_links"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""
    return ngram_jaccard(documents(spark, sf_dir), n=4, percent=85)


ORACLE_OP2 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
                                      when len(w) > 0 then ['#' || array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select g from s group by g having count(*) > 1),
t as (select s.* from s semi join k using (g)),
x as (select a.doc_id as a, b.doc_id as b, count(*) as i from t a join t b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as v, doc_id as u from documents union select e.b, r.u from r join e on e.a = r.v),
c as (select v, min(u) as component_id from r group by v),
d as (select a as doc_id, count(*) as n_links from e group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from documents left join n using (doc_id) join c on c.v = documents.doc_id left join d using (doc_id)
"""
