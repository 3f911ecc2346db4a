import random
import time

import numpy as np
from pyspark.sql import functions as F

from botlog.llm import tiling as T


def brute(doc, item, least):
    """Greedy tiling by trying every pair of starts, longest first."""
    fd, fi, out = [x > 0 for x in doc], [x > 0 for x in item], []
    while True:
        best = (least - 1, 0, 0)
        for s in range(len(doc)):
            for t in range(len(item)):
                n = 0
                while s + n < len(doc) and t + n < len(item) and fd[s + n] and fi[t + n] and doc[s + n] == item[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, s, t)
        n, s, t = best
        if n < least:
            return out
        out.append((s, t, n))
        for k in range(n):
            fd[s + k] = fi[t + k] = False


def test_tiles_against_brute_force():
    rng = random.Random(4)
    with np.errstate(over="ignore"):
        for _ in range(300):
            v = rng.choice([2, 3, 6, 30])
            item = [rng.randrange(1, v + 1) for _ in range(rng.randrange(1, 25))]
            doc = [rng.randrange(0, v + 1) for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.7:
                cut = rng.randrange(len(item))
                doc[3:3] = item[cut:] + [0] + item[:cut]
            assert sorted(T.tiles(np.array(doc), np.array(item), 3)) == sorted(brute(doc, item, 3))


def test_tiles_stay_below_the_square():
    """Six-word pieces of a passage of 100,000 words, shuffled: about a second; a pass for every length took the square."""
    words, rng = np.arange(1, 100_003), random.Random(1)
    pieces = np.split(words, len(words) // 6)
    rng.shuffle(pieces)
    started = time.process_time()
    with np.errstate(over="ignore"):
        found = T.tiles(np.concatenate(pieces), words)
    assert sum(n for _, _, n in found) == len(words)
    assert time.process_time() - started < 30


def items_df(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def sentence(rng, n):
    return " ".join("w%d" % rng.randrange(5000) for _ in range(n))


def test_reordered_edited_and_clean(spark, docs_of):
    rng = random.Random(9)
    a = [sentence(rng, 9).capitalize() + "." for _ in range(4)]
    whole, moved = " ".join(a), a[2] + " filler " + a[0].upper() + "\n" + a[3] + " x " + a[1]
    edited = " ".join(w if k % 9 else "zz" for k, w in enumerate(whole.split()))
    rows = [(1, "lead " + whole + " tail"), (2, moved), (3, edited), (4, a[0]), (5, sentence(rng, 400)), (6, None), (7, ""),
            (None, whole), (8, whole), (8, whole), (9, sentence(rng, 60_000) + " " + moved)]
    tests = [(5, whole), (6, whole), (7, sentence(rng, 30)), (8, None), (9, "too short"), (None, sentence(rng, 12)), (5, whole)]
    for block in (T.BLOCK_BYTES, 100):
        docs = docs_of(rows, extra=True)
        out = T.contamination(docs, items_df(spark, tests), block_bytes=block)
        got = sorted([(r.doc_id, r._leak.item_id, round(r._leak.coverage, 3), r._leak.contaminated) for r in out.collect()], key=str)
        full = [(i, 5, 1.0, True) for i in (1, 2, 8, 8, 9, None)]
        assert got == sorted(full + [(3, 5, round(32 / 36, 3), True), (4, 5, 0.25, False)]
                             + [(i, None, 0.0, False) for i in (5, 6, 7)], key=str)
        kept = T.drop_contaminated(docs, items_df(spark, tests))
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert T.drop_contaminated(docs, items_df(spark, []).limit(0)).count() == len(rows)
    assert T.contamination(docs.limit(0), items_df(spark, tests)).count() == 0


def test_every_covered_passage_is_named(spark, docs_of):
    rng = random.Random(3)
    a, b, c = sentence(rng, 20), sentence(rng, 20), sentence(rng, 20)
    half = " ".join(b.split()[:10])
    rows = [(1, f"{c} x {a} y {half} {a}"), (2, half), (3, " ".join(c.split()[:8])), (4, "")]
    tests = [(9, a), (4, a), (None, a), (7, b), (None, c), (8, None)]
    for block in (T.BLOCK_BYTES, 60):
        got = {r.doc_id: r._leak for r in T.contamination(docs_of(rows), items_df(spark, tests), block_bytes=block).collect()}
        assert [(x.item_id, x.coverage, x.n_tiles) for x in got[1]["items"]] == [(4, 1.0, 1), (None, 1.0, 1), (7, 0.5, 1)]
        assert (got[1].item_id, got[1].coverage) == (4, 1.0)
        assert [x.item_id for x in got[2]["items"]] == [7] and got[2].contaminated
        assert (got[3].item_id, got[3].coverage, got[3]["items"]) == (None, 0.4, []) and not got[3].contaminated
        assert (got[4].item_id, got[4].coverage, got[4].n_tiles, got[4]["items"]) == (None, 0.0, 0, [])


def test_a_passage_listed_often_takes_one_place(spark):
    rng = random.Random(8)
    text = sentence(rng, 30)
    tests = items_df(spark, [(i, text) for i in range(500)] + [(i, sentence(rng, 30)) for i in range(1000, 1040)])
    sizes = [sum(len(t) + 16 for _, t in block) for block in T._blocks(tests, "item_id", "text", 2000)]
    assert sum(len(b) for b in T._blocks(tests, "item_id", "text", 2000)) == 41
    assert len(sizes) > 2 and max(sizes) < 3 * 2000
    assert T.passages(tests).where(F.col("t") == text).first().i == 0


def test_query_against_brute_force(spark, sf):
    tests = [(r.item_id, T.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: T.words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in T.op3_benchmark_decontamination(spark, sf).collect()}
    assert len(got) == len(rows)
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    indexed = [(i, w, grams(w)) for i, w in tests if len(w) >= 5]
    for d, words in rows.items():
        mine, best, above = grams(words), (0.0, None), []
        for i, w, g in sorted(indexed, key=lambda x: x[0]):
            if g & mine:
                vocab = {x: k + 1 for k, x in enumerate(set(w))}
                hits = [k for k in range(len(words) - 4) if tuple(words[k:k + 5]) in g]
                near = sorted({k + j for k in hits for j in range(5)})
                doc = []
                for x, k in enumerate(near):
                    doc += ([0] if x and near[x - 1] != k - 1 else []) + [vocab.get(words[k], 0)]
                c = sum(t[2] for t in brute(doc, [vocab[x] for x in w], 5)) / len(w)
                if c > best[0]:
                    best = (c, i)
                above += [(-c, i)] * (c >= 0.5)
        assert (round(got[d].coverage, 9), got[d].item_id) == (round(best[0], 9), best[1])
        assert got[d].item_ids == [i for _, i in sorted(above)]
    assert any(r.contaminated for r in got.values()) and not all(r.contaminated for r in got.values())
