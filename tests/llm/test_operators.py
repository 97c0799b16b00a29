"""Training-data operators against brute force on small fixtures, and their edge cases."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import exact_dedup, langid, mixing, ngram_join, pieces, ppm, quality, quotes, token_files, toxicity
from hearth.llm.common import Lookup, Words, pack, unpack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `keep` string, tile string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": ["th", "er", "on", "an", "re", "ed", "nd", "ha"], "de": ["sch", "ung", "keit", "ver", "ä", "ei", "en"]}


def _text(rng, lang="en", n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def _rows():
    """Nulls, empties, spaces, ties, repeated rows, near copies, a long text."""
    rng = random.Random(5)
    base = _text(rng, n=80)
    words = base.split()
    near = " ".join(["Xy", *words[1:]])
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a"), (4, "a"), (5, base), (6, base), (7, near), (None, base),
            (8, "  two  spaces \n and\tlines \r\n" + base), (9, "日本語 ☃ ▁x <|endoftext|> it's 12,5"), (10, "a " * 9000),
            (11, " ".join(words[:8] * 3)), (12, None)]
    rows += [(20 + i, _text(rng, "de" if i % 3 else "en", 30 + i)) for i in range(40)]
    return [(i, t, None if i == 20 else "de" if (i or 0) >= 20 and (i - 20) % 3 else "en", f"s{(i or 0) % 3}" if i != 21 else None,
             0, "x", "y") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(i):
    return -1 if i is None else i


def test_helpers():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    assert (unpack(pack(codes)) == codes).all() and len(unpack(pack(codes[:0]))) == 0
    table = Lookup(codes)
    assert (table(codes) == np.arange(len(codes))).all() and (table(codes[:50] + np.uint64(1)) == -1).all()
    texts = [b"", b" Ab  cd\x0bab ", "é x".encode(), b"AB"]
    w = Words(texts)
    assert w.per_doc.tolist() == [0, 3, 1, 1] and w.hash[0] == w.hash[2] == w.hash[4] and w.doc.tolist() == [1, 1, 1, 2, 3]


@pytest.mark.parametrize("budget", [1 << 20, 40])
def test_trie_merges_and_spills(budget):
    rng = random.Random(2)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(400)] + [b"a" * 300, b"a" * 300 + b"b"]
    trie = exact_dedup.PatriciaTrie(list.extend, budget)
    for s in strings:
        got = trie.insert(s, [1])
        assert (got is None) == (s[:1] != b"" and s[0] in trie.spilled)
    assert {s: sum(n) for s, n in trie.items()} == collections.Counter(strings)
    assert bool(trie.spilled) == (budget == 40)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, empty, keep):
    got = exact_dedup.exact_duplicates(docs.repartition(3), keep=keep, trie_bytes=2000).collect()
    groups = collections.defaultdict(list)
    for r in _rows():
        groups[r[1] or ""].append(r[0])
    choose = max if keep == "max" else min
    expect = sorted((_key(i), choose(x for x in ids if x is not None), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((_key(r.doc_id), r.keep_id, r.group_size) for r in got) == expect
    assert exact_dedup.exact_duplicates(empty).count() == 0


def _brute_join(rows, n, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    comp = collections.defaultdict(list)
    for i in range(len(rows)):
        comp[top(i)].append(rows[i][0])
    return sorted((_key(rows[i][0]), len(sets[i]),
                   rows[i][0] if not sets[i] else min((x for x in comp[top(i)] if x is not None), default=None), links[i])
                  for i in range(len(rows)))


@pytest.mark.parametrize("n,percent,tile", [(4, 85, 512), (5, 80, 2)])
def test_ngram_join_matches_all_pairs(spark, docs, empty, n, percent, tile):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in _rows()]
    for g in range(8):                      # groups of near copies around a base, of many sizes
        base = rng.choices(vocabulary, k=rng.choice([5, 7, 9, 14, 30, 90, 200]))
        for k in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((100 + 10 * g + k, " ".join(w + rng.choices(vocabulary, k=rng.choice([0, 0, 1])))))
    got = ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                   n=n, percent=percent, tile=tile).collect()
    assert sorted((_key(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in got) == _brute_join(rows, n, percent)
    if tile == 2:
        assert ngram_join.ngram_jaccard(empty).count() == 0


def test_a_large_group_is_sent_in_rounds_of_bounded_bytes(spark, monkeypatch):
    """A group's sets meet in many tiles: no round sends many times what the sets have, and links are all found."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=60)
    rows = [(i, " ".join(base[:57] + rng.choices(words, k=1 + i % 3))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "ROUND_BYTES", 1)
    names = []

    def store(df, name, *args, keep=ngram_join.store, **options):
        names.append(name)
        return keep(df, name, *args, **options)

    monkeypatch.setattr(ngram_join, "store", store)
    got = ngram_join.ngram_jaccard(docs, n=5, percent=80, tile=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == _brute_join(rows, 5, 80)
    assert names.count("ngram-links") > 4 and names.count("ngram-sets") == 1
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [d for d in os.listdir(root) if d.startswith("ngram-sets")]


def test_blocks_of_a_tile_give_the_same_links(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[:k], rng.integers(0, 2**63, 3 + k % 9, dtype=np.uint64)])) for k in range(40, 120, 2)]
    sets.sort(key=len)

    def links(a, b):
        return {(i, int(j)) for i, js in ngram_join.link_tile(a, b, 80) for j in js}

    def brute(i, j):
        inter = len(np.intersect1d(sets[i], sets[j]))
        return 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter)

    want = {(i, j) for j in range(len(sets)) for i in range(j) if brute(i, j)}
    for block in (512, 7):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert links(sets, None) == want
        assert links(sets[:15], sets[15:]) == {(i, j - 15) for i, j in want if i < 15 <= j}


def test_links_share_a_key_whatever_is_common():
    """Any two linked sets share a part key, with every choice of elements left out."""
    rng = np.random.default_rng(3)
    for size in (7, 12, 31, 100, 350):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = a.copy()
        drop = max(1, size * 15 // 200)
        b[:drop] = rng.integers(0, 2**63, drop, dtype=np.uint64)
        if 100 * (size - drop) < 85 * (size + drop):
            b = a[1:]
        sets, bounds = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
        sig = ngram_join.signatures(sets, bounds)
        for share in (0.0, 0.3, 0.9, 1.0):
            common = (sets % np.uint64(1000)) < 1000 * share
            keys, owner = ngram_join.part_keys(sets, bounds, sig, 85, common)
            assert set(keys[owner == sig[0]]) & set(keys[owner == sig[1]]), (size, share)


def test_quality_figures_and_rules(spark, docs, empty):
    got = {_key(r.doc_id): r for r in quality.base_figures(docs).collect()}
    for r in _rows():
        t = r[1] or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        if r[0] not in (4, None):
            g = got[_key(r[0])]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
                len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), r[0]
    for n, k, a in ((50, 0, 0.01), (900, 3, 0.01), (5000, 40, 0.01), (12, 1, 0.3), (40, 39, 0.01)):
        exact = sum(math.comb(n, i) * a**i * (1 - a)**(n - i) for i in range(k + 1)) if k < n * a else 1.0
        tail = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), a).alias("p")).first().p
        assert tail == pytest.approx(exact, rel=1e-9)
    rng = random.Random(1)
    rows = [(i, _text(rng, n=40) if i % 6 else _text(rng, n=40).replace(" ", "%%% "), "en") for i in range(2400)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(0, 2400)] + [(1, None), (None, 1)],
                                   "doc_id long, quality int")
    out = quality.apply_rules(data, labels).collect()
    assert all(r.kept == (r.doc_id % 6 != 0) for r in out) and {r.failed_rules[0] for r in out if not r.kept} == {"symbols"}
    none = quality.apply_rules(docs, labels.where("false"))
    assert none.where("kept = base_failed").count() == 0 and quality.apply_rules(empty, labels).count() == 0


def test_language_id(docs, empty):
    learn = docs.where("doc_id >= 20")
    model = langid.fit_prototypes(learn)
    assert sorted(model) == ["de", "en"]
    again = langid.fit_prototypes(learn.repartition(5))
    assert all((model[k] == again[k]).all() for k in model)
    got = {_key(r.doc_id): r for r in langid.predict_language(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2))
    truth = {20 + i: "de" if i % 3 else "en" for i in range(40)}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, lang in truth.items())
    assert langid.predict_language(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict_language(docs, langid.fit_prototypes(empty)).collect()} == {"und"}
    # a profile is the sum of bound letter vectors
    grams = langid.Trigrams(["ab"])
    a, b, gap = (langid.letter_vector(c).astype(int) for c in (97, 98, 0))
    assert (grams.bundle(0) == np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * gap).all()


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 3 else ("mid" if i % 2 else "tiny") if i % 5 else None) for i in range(900)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limits in ({"max_repeats": 1.5}, {"max_repeats": None, "target_entropy": 0.97}):
        out = mixing.mix_sources(data, block_tokens=200, **limits).collect()
        assert len(out) == len(rows)
        total = sum(r.n_tokens for r in out)
        by = collections.defaultdict(lambda: [0, 0, 0.0])
        for r in out:
            by[r.source][0] += r.n_tokens
            by[r.source][1] += r.n_tokens * r.copies
            by[r.source][2] = r.weight
        assert sum(w for _, _, w in by.values()) == pytest.approx(1)
        for t, drawn, w in by.values():
            assert 0 <= math.floor(total * w) - drawn < 40          # the budget, short of one document
            if limits["max_repeats"]:
                assert total * w <= 1.5 * t * (1 + 1e-6)
        h = -sum(w * math.log(w) for _, _, w in by.values()) / math.log(len(by))
        assert h >= limits.get("target_entropy", 0) - 1e-6
        if limits["max_repeats"]:
            assert max(total * w / t for t, _, w in by.values()) == pytest.approx(1.5, rel=1e-4)
    cover = mixing.mix_sources(data, cover=True, max_repeats=3.0, keep=("text",))
    assert cover.where("copies < 1 or copies > 3").count() == 0 and cover.count() == len(rows)
    assert mixing.realise(cover).count() == cover.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(docs).count() == docs.count() and mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(empty, cover=True).count() == 0


def test_pieces_round_trip_and_best_path(spark, docs, empty):
    encoded = pieces.encode_pieces(docs)
    texts = sorted((_key(r.doc_id), r.text) for r in pieces.decode_pieces(encoded).collect())
    assert texts == sorted((_key(r[0]), r[1] or "") for r in _rows())
    assert pieces.encode_pieces(docs, digest=True).where("not round_trip").count() == 0
    assert pieces.encode_pieces(empty).count() == 0
    toy = [("▁a", -1.0, "piece"), ("b", -2.0, "piece"), ("▁ab", -3.0, "piece"), ("c", -2.0, "piece"),
           ("bc", -1.5, "piece"), ("▁", -4.0, "piece")]
    toy += [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    coder = pieces.PieceCoder(toy)
    value = {p: s for p, s, k in toy if k == "piece"}

    def best(s):
        if not s:
            return 0.0
        found = [value[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in value]
        return max(found, default=coder.unknown + best(s[1:]))

    for s in ("abc", "abcb", "cab", "bbc", "a"):
        assert coder.viterbi(pieces.SPACE + s)[1] == pytest.approx(best(pieces.SPACE + s))
    assert coder.viterbi(pieces.SPACE + "ab")[0] == [2]                 # a tie keeps the longer piece
    assert coder.decode(coder.viterbi(pieces.SPACE + "zé")[0]) == "zé"


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(docs, empty, encoding):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(token_files.default_vocabulary())
    files = token_files.write_token_files(token_files.encode(docs), encoding, row_group_bytes=1 << 16, page_bytes=4096)
    got = sorted((_key(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(files).collect())
    expect, start = [], 0
    for i, t in sorted(((_key(r[0]), r[1] or "") for r in _rows())):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        expect.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(expect)
    assert token_files.read_digests(token_files.write_token_files(token_files.encode(empty))).count() == 0


def test_encoder_matches_library_on_odd_texts():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(token_files.default_vocabulary())
    encoder = token_files.CachedEncoder(token_files.default_vocabulary(), cache_bytes=20_000)
    rng = random.Random(7)
    parts = ["Été", "naïve,", "don't", "I'll", "x\ny", "x.\nY!", "\n", " ", "  ", "a1b2", "***", "ÿ×÷ß", " ", "\x1c", "日本",
             "end.", "'s", "-", "_a_", "O'Neil.", "<|endoftext|>", "\r", "\u00a0", "\t", "\n\n", "\u3000z"]
    for i in range(3000):
        # most without the special token, so that the cut path is met too
        t = rng.choice(["", " ", " ", "\n"]).join(rng.choices(parts if i % 5 == 0 else [x for x in parts if x[0] != "<"],
                                                              k=rng.randint(0, 7)))
        assert encoder([t])[0] == np.array(library.encode(t, add_special_tokens=False).ids, np.int32).tobytes(), repr(t)


def test_encoder_table_is_bounded_in_bytes():
    encoder = token_files.CachedEncoder(token_files.default_vocabulary(), cache_bytes=50_000)
    rng = random.Random(1)
    for _ in range(20):
        encoder([" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(300))])
        for table in (encoder.young, encoder.old):
            assert table.nbytes < 26_000 and table.n <= table.capacity


def test_piece_table_tells_pieces_apart_by_their_bytes():
    rng = random.Random(3)
    made = {bytes(rng.choices(b"ab\0", k=rng.randint(0, token_files.KEY_BYTES))) for _ in range(3000)}
    made |= {b"a" * n for n in range(25)} | {b"a" * n + b"\0" for n in range(24)}
    pieces = sorted(made)
    buf = np.frombuffer(b"".join(pieces) + bytes(32), np.uint8)
    size = np.array([len(p) for p in pieces])
    keys = token_files.piece_keys(buf, np.cumsum(size) - size, size)
    assert len({k.tobytes() for k in keys}) == len(pieces)
    counts = np.array([token_files.UNSAFE if i % 7 == 3 else i % 4 for i in range(len(pieces))])
    sizes = np.where(counts == token_files.UNSAFE, 0, counts)
    table = token_files.PieceTable(1 << 20)
    half = np.arange(len(pieces)) % 2 == 0
    ids = np.repeat(np.arange(len(pieces)), sizes).astype(np.int32)
    assert table.add(keys[half], counts[half], ids[np.isin(ids, np.flatnonzero(half))])
    known, offset, count = table.find(keys)
    assert (known == half).all() and (count[half] == counts[half]).all()
    for i in np.flatnonzero(half & (sizes > 0)):
        assert (table.ids[offset[i]:offset[i] + count[i]] == i).all()
    small = token_files.PieceTable(0)
    assert not small.add(keys[half], counts[half], ids) and not small.find(keys)[0].any()


def test_encoder_keeps_ids_right_while_generations_turn():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(token_files.default_vocabulary())
    encoder = token_files.CachedEncoder(token_files.default_vocabulary(), cache_bytes=4000)
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 30))) + rng.choice(["", "", ".", ",", "'s"]) for _ in range(150)]
    for _ in range(60):
        texts = [rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(4)] + ["", " x", "a  b"]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, np.int32).tobytes() for t in texts]
        assert encoder(texts) == want


def test_ppm_matches_brute_force(docs, empty):
    train = F.col("doc_id") % 3 != 0
    got = {_key(r.doc_id): r for r in ppm.ppm_scores(docs, train).collect()}
    seen, words = collections.defaultdict(collections.Counter), collections.Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    pad = bytes([255]) * ppm.ORDER
    for r in _rows():
        if r[0] is not None and r[0] % 3:
            b = pad + (r[1] or "").encode() + b"\xfe"
            for j in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    seen[b[j - k:j]][b[j]] += 1
            words.update(WORD.findall((r[1] or "").translate(low)) + ["\0end"])
    total, distinct = sum(words.values()), len(words)
    for i, t, *_ in _rows():
        b, score = pad + (t or "").encode() + b"\xfe", 0.0
        for j in range(ppm.ORDER, len(b)):
            gone, p = set(), 1.0
            for k in range(ppm.ORDER, -1, -1):
                left = {x: n for x, n in seen.get(b[j - k:j], {}).items() if x not in gone}
                n, d = sum(left.values()), len(left)
                if b[j] in left:
                    p *= left[b[j]] / (n + d)
                    break
                if n:
                    p *= d / (n + d)
                gone |= set(seen.get(b[j - k:j], ()))
            else:
                p /= 256 - len(gone)
            score += math.log10(p)
        tokens = WORD.findall((t or "").translate(low)) + ["\0end"]
        g = got[_key(i)]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(words[x] > 0 for x in tokens), total)
        assert g.base_score == pytest.approx(sum(math.log10((words[x] + 1) / (total + distinct + 1)) for x in tokens))
        assert g.score == pytest.approx(score, rel=1e-5)
    assert ppm.ppm_scores(empty, train).count() == 0
    untrained = ppm.ppm_scores(docs, F.lit(False)).where("doc_id = 1").first()
    assert untrained.score == pytest.approx(-math.log10(256)) and untrained.train_tokens == 0


def test_string_kernel():
    def brute(s, t):
        def phi(w):
            out = collections.Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i] + w[j] + w[k]] += toxicity.LAMBDA ** (k - i + 1)
            return out
        a, b = phi(s), phi(t)
        return sum(a[u] * b[u] for u in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    marks, words = ["idiot", "moron", "worthless"], ["idiot", "idxiot", "iidiot", "idit", "worthles", "moroon", "banana"]
    got = toxicity.Kernel(marks)(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            exact = brute(w, m)
            assert got[i, j] == pytest.approx(exact, abs=1e-5) or (got[i].max() == 0 and exact < toxicity.FLOOR)
    assert got[0, 0] == pytest.approx(1) and got[1, 0] > 0.5 and got[6].max() < 0.3
    assert toxicity.units("i.d-i*o.t") == ["idiot"] and "idiot" in toxicity.read_words("you i d i o t !!")


def test_toxicity_learns_and_tolerates_gaps(spark, empty):
    rng = random.Random(4)
    insults = ["idiot", "moron", "worthless"]
    rows = [(i, _text(rng, n=25) + (f" {rng.choice(insults)} " + _text(rng, n=5) if i % 5 == 0 else ""), int(i % 5 == 0))
            for i in range(600)]
    data = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(data, labels, F.col("doc_id") % 4 != 0)
    assert set(model["landmarks"]) >= set(insults)
    score = {r.doc_id: r.score for r in toxicity.toxicity_scores(data, model).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you i.d.i.o.t there"), (4, "such an idxiot"), (5, "x" * 5000)],
                                "doc_id long, text string")
    odd = {r.doc_id: r.score for r in toxicity.toxicity_scores(odd, model).collect()}
    assert odd[1] == odd[2] and max(odd[1], odd[5]) < 0.5 <= odd[3] and odd[4] > 10 * odd[1]
    assert toxicity.toxicity_scores(empty, model).count() == 0
    none = toxicity.fit_toxicity(data, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.toxicity_scores(data, none).collect()} == {0.0}


def test_quote_links(spark):
    clean, quoted, own = quotes.parse_quotes("> > deep\n> top\nmine\n\n>\nend")
    assert clean == "mine\n\nend" and [q[0] for q in quoted] == [2, 1] and len(own) == 3
    assert quotes.parse_quotes(None) == ("", [], []) and quotes.parse_quotes("a > b")[1] == []
    rows = [(1, 0, "First question here"), (1, 1, "> first  QUESTION here\nAn answer\nin two lines"),
            (1, 2, "Unrelated"), (1, 3, "> An answer\n> in two lines\n>> First question here\nThanks"),
            (1, 4, "> nobody said this\nodd"), (1, 5, "> Thanks\nwelcome"), (2, 0, "> First question here\nother talk"),
            (2, 1, None), (2, 2, ""), (2, 2, ""), (None, 0, "lost"), (3, 1, "> later\nx"), (3, 2, "later")]
    df = spark.createDataFrame([(c, t, "user", x, 1) for c, t, x in rows],
                               "conv_id long, turn long, role string, text string, hash int")
    out = quotes.link_quotes(df).collect()
    assert len(out) == len(rows) and sorted(r.position for r in out) == list(range(len(rows)))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in out}
    assert got[1, 1] == (0, 0, 1) and got[1, 3] == (1, 0, 2) and got[1, 5] == (3, 0, 3)
    assert got[1, 4] == (None, 4, 0) and got[2, 0] == (None, 0, 0) and got[3, 1] == (None, 1, 0)
    order = [(r.conv_id, r.turn) for r in sorted(out, key=lambda r: r.position) if r.conv_id == 1]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 5), (1, 2), (1, 4)]
    assert {r.text for r in out if (r.conv_id, r.turn) == (1, 3)} == {"Thanks"}
    assert quotes.link_quotes(df.where("false")).count() == 0


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline
    columns = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(i, t, lang, s, n, "x") for i, t, lang, s, n, *_ in _rows() if i is not None]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {0, 1, 2, 12, 3, 5}            # no letter; exact copies with a smaller id
    expect = {r[0] for r in rows} - gone
    alive = [(r[0], r[1]) for r in rows if r[0] in expect]
    alive = [x for k, x in enumerate(alive) if x not in alive[:k]]
    expect = {c for _, _, c, _ in _brute_join(alive, 5, 80)}
    assert set(out) == expect and all(r.round_trip for r in out.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources",
                                                           "encode_pieces"]


def test_pipeline_dedup_keeps_one_row_of_repeated_ids(spark):
    import corpus_pipeline
    rng = random.Random(8)
    one, other, third = _text(rng, n=50), _text(rng, n=50), _text(rng, n=50)
    near = other + " again"
    rows = [(4, one), (4, one), (4, one), (7, other), (7, third), (9, near)]
    data = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_dedup(spark, data, "")
    assert sorted((r.doc_id, r.text) for r in exact.collect()) == sorted({(4, one), (7, other), (7, third), (9, near)})
    assert exact.where("doc_id = 4").first().source == "s0"
    # a larger id of a group goes, also where its id is smaller in another group
    data = spark.createDataFrame([(7, other), (7, third), (9, near), (5, third + " too"), (8, one)], "doc_id long, text string") \
        .selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars")
    kept = corpus_pipeline.near_dedup(spark, data, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(7, other), (5, third + " too"), (8, one)])


def test_pipeline_keeps_documents_without_id(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(12)
    alone, shared, near, twice = (_text(rng, n=50) for _ in range(4))
    rows = [(None, alone), (None, shared), (3, shared), (None, twice), (None, twice), (6, near), (None, near + " again"), (8, "x y")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    expect = [(None, alone), (3, shared), (None, twice), (6, near), (None, near + " again"), (8, "x y")]
    assert collections.Counter((r.doc_id, r.text) for r in exact.collect()) == collections.Counter(expect)
    kept = corpus_pipeline.near_dedup(spark, exact, "")
    expect.remove((None, near + " again"))
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(expect)
    out = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == {None: 2, 3: 1, 6: 1, 8: 1}


def test_covering_mix_reaches_its_weights(spark):
    import corpus_pipeline
    sizes = {"a": 1200, "b": 400, "c": 200, "d": 120, None: 80}            # shares 60/20/10/6/4
    rows = [(1000 * k + i, "w w w w", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keep in ((), ("text",)):
        out = mixing.mix_sources(data, block_tokens=100, cover=True, max_repeats=2.0, keep=keep).collect()
        drawn, weight = collections.Counter(), {}
        for r in out:
            drawn[r.source] += r.copies
            weight[r.source] = r.weight
        assert len(out) == len(rows) and {r.copies for r in out} == {1, 2}
        flat = math.log(2) / math.log(1200 / 80)
        for s, n in sizes.items():
            assert drawn[s] / n == pytest.approx((1200 / n) ** flat, abs=1.5 / n)
            assert drawn[s] / sum(drawn.values()) == pytest.approx(weight[s], abs=1e-3)
    # a ratio under the limit: all sources alike
    few = data.where("source in ('c', 'd')")
    few = mixing.mix_sources(few, cover=True, max_repeats=2.0).groupBy("source").agg(F.sum("copies").alias("n"))
    assert {r.source: r.n for r in few.collect()} == {"c": 200, "d": 200}
    docs = data.selectExpr("doc_id", "concat(text, doc_id) as text", "'en' as lang", "source", "0L as n_chars")
    mixed = corpus_pipeline.mix(spark, docs, "").groupBy("source").count().collect()
    for r in mixed:
        assert r["count"] / sizes[r.source] == pytest.approx((1200 / sizes[r.source]) ** flat, abs=1.5 / sizes[r.source])


def test_pipeline_writes_the_draw_in_block_order(spark, tmp_path):
    import corpus_pipeline
    rows = [(i, f"w w w w {i}", "en", "ab"[i % 4 == 0], 0) for i in range(2000)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mix(spark, data.repartition(5), "").write.parquet(f"{tmp_path}/mixed")
    out = []
    for part in sorted(tmp_path.glob("mixed/part-*")):
        out += [(r.order_key, r.epoch, r.source, r.doc_id) for r in spark.read.parquet(str(part)).collect()]
    assert len(out) > 2000 and {e for _, e, _, _ in out} == {1, 2}
    assert [x[0] for x in out] == sorted(x[0] for x in out)                       # blocks in the order of their keys
    assert len({x[0] for x in out}) == len({x[:3] for x in out}) >= 3 and len(set(out)) == len(out)
    first = [d for _, e, s, d in out if (e, s) == (1, "a")]
    assert sorted(first) != first and len(first) == len(set(first)) == 1500      # a seeded order, every document once
    again = corpus_pipeline.mix(spark, data, "").collect()
    assert [(r.order_key, r.epoch, r.source, r.doc_id) for r in again] == out


def test_op7_returns_ids_that_decode(spark, docs, tmp_path):
    import corpus_pipeline
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pieces.op7(spark, str(tmp_path))
    assert dict(out.dtypes)["ids"] == "array<int>"
    got = sorted((_key(r.doc_id), r.n_pieces, r.ids_crc32, r.round_trip) for r in out.collect())
    plain = pieces.encode_pieces(docs).collect()
    assert got == sorted((_key(r.doc_id), len(r.ids), zlib.crc32(np.array(r.ids, "<i4").tobytes()), True) for r in plain)
    texts = sorted((_key(r.doc_id), r.text) for r in pieces.decode_pieces(out).collect())
    assert texts == sorted((_key(r[0]), r[1] or "") for r in _rows())
    last = corpus_pipeline.encode(spark, docs, "")
    assert {"ids", "ids_crc32", "round_trip"} <= set(last.columns) and last.where("size(ids) <> n_pieces").count() == 0


def test_language_id_learns_from_very_long_texts(spark):
    rng = random.Random(6)
    long = {x: (_text(rng, x, 4000) + " ") for x in ("en", "de")}
    long = {x: t * (1_300_000 // len(t) + 1) for x, t in long.items()}
    assert all(len(langid.Trigrams([t]).doc) > 1_100_000 for t in long.values())
    model = langid.fit_prototypes(spark.createDataFrame(list(long.items()), "lang string, text string"))
    assert all(np.abs(v).max() > langid.UNITS // 100 for v in model.values())
    tests = [(i, _text(rng, "de" if i % 2 else "en", 80)) for i in range(20)]
    got = langid.predict_language(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: "de" if i % 2 else "en" for i in range(20)}
    # a text repeated to any length weighs as much as one copy
    once = long["en"][:len(long["en"]) // 40]
    short = langid.fit_prototypes(spark.createDataFrame([("en", once)], "lang string, text string"))["en"]
    assert np.linalg.norm(model["en"]) == pytest.approx(np.linalg.norm(short), rel=0.2)


def test_links_share_a_key_below_80_percent():
    rng = np.random.default_rng(4)
    for percent, large in ((60, 100), (60, 41), (50, 90), (70, 50)):
        a = rng.integers(0, 2**63, large, dtype=np.uint64)
        for small in range(-(-percent * large // 100), large):
            b = a[:small]
            sets, bounds = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
            sig = ngram_join.signatures(sets, bounds)
            keys, owner = ngram_join.part_keys(sets, bounds, sig, percent)
            assert set(keys[owner == sig[0]]) & set(keys[owner == sig[1]]), (percent, large, small)
