import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from botlog.llm import langid as L

EN = ["the cat sat on the mat", "where is the other one", "this and that thing there"]
DE = ["der Hund schläft nicht", "ich weiß es wirklich nicht", "schöne Grüße an dich"]


def brute_fold(text):
    out = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in unicodedata.normalize("NFC", text).lower())
    words = [w for w in out.split()]
    return f" {' '.join(words)} " if any(c.isalpha() for w in words for c in w) else " "


def brute_columns(text):
    mask, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15
    out = []
    for n in L.ORDERS:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i:i + n]:
                h = ((h ^ ord(c)) * mult) & mask
                h ^= h >> 29
            out.append(((h * mult) & mask) >> (64 - int(math.log2(L.WIDTH))))
    return out


def brute(train, texts):
    """Predictions by dictionaries: (lang, posterior) of every text."""
    counts, docs = {}, Counter()
    for t, lang in train:
        f = brute_fold(t or "")
        if lang is not None and f != " ":
            counts.setdefault(lang, Counter()).update(brute_columns(f))
            docs[lang] += 1
    out = []
    for t in texts:
        f = brute_fold(t or "")
        if f == " " or not counts:
            out.append(("und", 0.0))
            continue
        s = {}
        for lang, c in counts.items():
            total = sum(c.values()) + L.SMOOTHING * L.WIDTH
            s[lang] = math.log((docs[lang] + 1) / (sum(docs.values()) + len(counts))) + sum(
                math.log((c[x] + L.SMOOTHING) / total) for x in brute_columns(f))
        best = min(s, key=lambda k: (-s[k], k))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


ODD = [None, "", "  \n", "12 _ 34 !?", "²³ Ⅷ", "é", "É é", "中文字", "a", "the " * 30_000 + "nicht", "x" * 5000, "\U0001d400\U00010400 z"]


def test_equals_brute_force(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE]
             + [(None, "fr"), ("12 34", "fr"), ("sans langue", None), (EN[0], "en"), ("中文", "zh")])]
    texts = ODD + EN + DE
    model = L.fit(frame(spark, train))
    assert model.languages == ["de", "en", "zh"]
    docs = frame(spark, [(i, t, "?") for i, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for i, (lang, p) in enumerate(brute([r[1:] for r in train], texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(p, abs=1e-4), (i, texts[i])


def test_pieces_lose_no_ngram():
    texts = [L.fold(t or "") for t in ODD + EN + DE]
    for piece in (1, 2, 7, 1000, 1 << 20):
        got = Counter()
        for own, cols in L.hashed(texts, piece):
            assert (np.diff(own) >= 0).all()
            got.update(zip(own.tolist(), cols.tolist()))
        assert got == Counter((i, c) for i, t in enumerate(texts) for c in brute_columns(t))


def test_empty_untrained_repeated_and_clashing(spark):
    none = L.fit(frame(spark, []))
    assert none.languages == []
    docs = frame(spark, [(1, "the cat", "en"), (1, "the cat", "en"), (None, "der Hund", None)])
    assert [(r.lang_pred, r.score) for r in L.identify(docs, none).collect()] == [("und", 0.0)] * 3
    model = L.fit(frame(spark, [(i, t, "en") for i, t in enumerate(EN)]))
    odd = docs.withColumns({c: F.lit("x") for c in ("score", "lang_pred", "c0", "text.x", "held_out", "col", "n")})
    out = L.identify(odd, model)
    assert sorted(out.columns) == sorted(odd.columns) and dict(out.dtypes)["score"] == "double"
    assert [(r.lang_pred, r["text.x"], r.c0) for r in out.collect()] == [("en", "x", "x")] * 3
    assert L.identify(docs.limit(0), model).count() == 0


def test_one_hot_language_and_ties(spark):
    train = [(i, "aa bb", "en") for i in range(900)] + [(i, "cc dd", "de") for i in range(30)]
    model = L.fit(frame(spark, train).repartition(16))
    assert model.predict(["cc dd cc", "bb aa bb", "dd"])[0] == ["de", "en", "de"]
    same = L.fit(frame(spark, [(1, "aa", "b"), (2, "aa", "a")]))
    assert same.predict(["aa"])[0] == ["a"] and same.predict(["aa"])[1][0] == pytest.approx(0.5)


def test_query_learns_from_the_other_folds_only(spark, tmp_path):
    rows = [(i, [EN, DE][i % 2][i % 3], ["en", "de"][i % 2], "s", 0) for i in range(60)] + [(60, None, None, "s", 0), (61, "12", "en", "s", 0)]

    def run(flip):
        d = str(tmp_path / f"d{flip}")
        given = [(i, t, ("xx" if flip and zlib.crc32(str(i).encode()) % 5 == 0 else lang), "other" * flip, n) for i, t, lang, _, n in rows]
        spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        return sorted(map(tuple, L.op11_language_id(spark, d).collect()))

    a = run(0)
    assert a == run(1) and len(a) == 62
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h, _, _ in a)
    assert [lang for _, _, lang, _ in a][:60] == ["en", "de"] * 30 and [(x[2], x[3]) for x in a[60:]] == [("und", 0.0)] * 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op11_language_id(spark, sf).collect()
    assert len(rows) == len(true) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == true[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.995
