"""Language profiles, prototypes, winners and scores recomputed letter by letter."""

import numpy as np
import pyarrow as pa
import pytest

from hearth.llm import langid

TEXTS = {"en": "the weather here is rather fine and the other brothers gather there",
         "de": "der Wetterbericht für heute: schön, aber später Schauer über Straßen",
         "fr": "le temps était très beau, où est-elle allée après l'été?"}


def _profile(text, dims):
    """Bound and permuted letter vectors, one trigram at a time; runs of other characters are one gap."""
    symbols = []
    for c in f" {text.lower()} ":
        if c.isalpha():
            symbols.append(ord(c))
        elif not symbols or symbols[-1] != 0:
            symbols.append(0)
    total, n = np.zeros(dims), 0
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if a or b:
            va, vb, vc = (langid.letter_vector(x, dims).astype(float) for x in (a, b, c))
            total += np.roll(va, 2) * np.roll(vb, 1) * vc
            n += 1
    return total, n


def test_prototypes_winners_and_scores(spark):
    dims = 64
    rows = []
    for i in range(30):
        lang = ["en", "de", "fr"][i % 3]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(words[j % len(words)] for j in range(i, i + 4 + i % 5)), lang))
    rows += [(40, None, "en"), (41, "12 !?", "de"), (42, "nur ein Wort", None), (43, "", "fr")]
    learn = [r for r in rows if r[0] % 4]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    prototypes = langid.fit_prototypes(df.where("doc_id % 4 <> 0"), dims=dims)
    want = {}
    for _, text, lang in learn:
        if text is not None and lang is not None:
            total, n = _profile(text, dims)
            want[lang] = want.get(lang, 0) + (langid.UNITS // max(n, 1)) * total
    assert prototypes.keys() == want.keys()
    for lang in want:
        assert (prototypes[lang] == want[lang]).all()

    names = sorted(want)
    unit = np.stack([want[k] / np.linalg.norm(want[k]) for k in names])
    mean = unit.mean(0)
    centred = unit - mean
    axis = mean / np.linalg.norm(mean)
    for r in langid.predict_language(df, prototypes, dims=dims).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        profile, _ = _profile(text, dims)
        profile = profile - (profile @ axis) * axis
        cosine = [c @ profile / np.linalg.norm(c) / np.linalg.norm(profile) for c in centred]
        assert r.lang_pred == names[int(np.argmax(cosine))]
        assert r.score == pytest.approx(min(1, max(0, max(cosine))), abs=1e-5)


def test_kept_texts_go_once_and_come_back_by_slices(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 100)
    prototypes = {lang: _profile(text, 64)[0] for lang, text in TEXTS.items()}
    texts = [*TEXTS.values(), None, "", "12 !?", "x" * 250] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["k"] * len(texts)), pa.array(texts)],
                                       names=["doc_id", "lang", "text"])
    out = list(langid._predict_task(prototypes, 2, 3, 64)(iter([batch])))
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part.column(2).to_pylist()) <= 100 for part in out)
    table = pa.Table.from_batches(out)
    assert table.select(["doc_id", "lang", "text"]).equals(pa.Table.from_batches([batch]))
    assert table["lang_pred"].to_pylist() == ["en", "de", "fr", "und", "und", "und", table["lang_pred"][6].as_py()] * 3

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = langid.predict_language(docs, prototypes, keep=("text",), dims=64)
    sent = kept._jdf.queryExecution().analyzed().children().head().output().size()
    assert sent == 2                    # doc_id and one text
    plain = langid.predict_language(docs, prototypes, dims=64)
    assert kept.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted(kept.drop("text").collect()) == sorted(plain.collect())
    assert dict(kept.select("doc_id", "text").collect()) == dict(enumerate(texts))
