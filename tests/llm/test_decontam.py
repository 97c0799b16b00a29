"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from hearth.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, m string, items string"
ITEMS = "item_id long, text string, doc_id string"
AZ = str.maketrans(decontam.UPPER, decontam.LOWER)


def _words(text):
    return WORD.findall((text or "").translate(AZ))


def _tables():
    rng = random.Random(3)
    vocab = ["Aa", "bé", "C3", "dÉ", "日本", "eff", "g", "Hh"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".", "\n-"]) for _ in range(n))
    items = [(1, say(30)), (1, say(12)), (2, say(10)), (3, "Aa bé C3"), (4, None), (5, " .,"), (6, say(9)), (None, say(11)),
             (10, "g g g g g g g g g g g g"), (2, None)]
    items.append((7, items[0][1]))                                  # two items with the same windows
    docs = [(0, None), (1, ""), (2, "  ...  "), (3, items[0][1]), (3, items[0][1]), (3, "another aa BÉ c3"),
            (None, "x " + items[2][1] + " y"), (4, "x, " + items[2][1].upper().replace("É", "é") + " y!"),
            (5, "g " * 5000), (6, say(9)), (7, items[6][1] + " " + items[0][1] + "? end."), (8, "aa, bé c4 aa bé (c3) aa bé")]
    docs += [(30 + i, say(60)) for i in range(30)]
    docs += [(70 + i, say(20) + " " + (rng.choice(items)[1] or "") + " " + say(5)) for i in range(30)]
    return docs, items


def _brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = _words(text)
        m = min(len(w), n)
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, held = _words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                ids = windows.get(tuple(w[i:i + m]))
                if ids:
                    hit |= set(range(i, i + m))
                    held |= ids - {None}
        ids = ",".join(sorted(map(str, held)))
        out.append((doc_id, len(w), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def _op12(spark, monkeypatch, docs, items):
    monkeypatch.setattr(decontam, "documents", lambda s, d: spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS))
    monkeypatch.setattr(decontam, "read_table", lambda s, d, t: spark.createDataFrame([(*r, "z") for r in items], ITEMS))
    return sorted(map(tuple, decontam.op12(spark, "").collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    docs, items = _tables()
    got = _op12(spark, monkeypatch, docs, items)
    want = sorted(_brute(docs, items), key=repr)
    assert got == want
    assert sum(r[5] for r in want) >= 25 and sum(not r[5] for r in want) >= 25


def test_blocks_of_a_large_set_give_the_same(spark):
    docs, items = _tables()
    d, i = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS), spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    one = decontam.contamination(d, i).collect()
    many = decontam.contamination(d, i, set_bytes=2000).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, monkeypatch, empty):
    docs, items = _tables()
    docs, items = ([] if empty != "items" else docs), ([] if empty != "docs" else items)
    assert _op12(spark, monkeypatch, docs, items) == sorted(_brute(docs, items), key=repr)


def test_removal(spark):
    docs, items = _tables()
    d, i = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS), spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    cut = decontam.decontaminate(d, i)
    assert cut.columns == d.columns and cut.count() == len(docs)
    by_id = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert by_id[0] is None and by_id[2] == "  ...  " and by_id[7] == " end." or by_id[7].endswith("end.")
    assert by_id[5] == " " and by_id[8] == "aa, bé c4) aa bé"
    # removal joins what stood around a span, which may make a new window; all words kept were outside of spans
    for r in decontam.contamination(d, i).collect():
        if r["doc_id"] not in (3, None):
            assert len(_words(by_id[r["doc_id"]])) == r["n_words"] - r["n_hit"]
    left = decontam.decontaminate(d, i, remove="documents")
    assert sorted(map(repr, left.collect())) == sorted(
        repr(x) for x, b in zip(d.collect(), _brute(docs, items)) if not b[5])


def test_plan_broadcasts_the_set_and_runs_no_python(spark):
    docs, items = _tables()
    d, i = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS), spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    plan = decontam.decontaminate(d, i)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
