import hashlib
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from botlog.llm import bpe, tiling, toxicity

from . import test_secrets, test_simhash, test_tiling


def leaks(text, tests):
    """Whether a text covers half of a test passage, by brute-force tiling."""
    words = tiling.words_of(text)
    mine = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    for t in tests:
        grams = {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
        if grams & mine:
            vocab = {w: k + 1 for k, w in enumerate(set(t))}
            near = sorted({k + j for k in range(len(words) - 4) if tuple(words[k:k + 5]) in grams for j in range(5)})
            doc = []
            for x, k in enumerate(near):
                doc += ([0] if x and near[x - 1] != k - 1 else []) + [vocab.get(words[k], 0)]
            if sum(m[2] for m in test_tiling.brute(doc, [vocab[w] for w in t], 5)) >= 0.5 * len(t):
                return True
    return False


def masked(t):
    runs = []
    for s, _, e in test_secrets.all_spans(t):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in reversed(runs):
        t = t[:s] + "[secret]" + t[e:]
    return t


def test_whole_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = lexicon.automaton()
    rows = {r.doc_id: r.text for r in docs.collect()}
    first = {i: t for i, t in rows.items() if lexicon.score(a, t) < 0.5}
    second = {i: first[i] for i in {c for _, _, c in test_simhash.brute(list(first.items()), 4)}}
    tests = [tiling.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    third = {i: t for i, t in second.items() if not leaks(t, tests)}
    assert len(rows) > len(first) > len(second) > len(third) > len(rows) // 2
    fourth = {i: masked(t) for i, t in third.items()}
    assert any(fourth[i] != third[i] for i in third)
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in fourth.items()}
    got = C.run(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_columns_and_take_odd_rows(spark, docs_of, sf):
    long = "one two three four five six " * 20_000
    docs = docs_of([(1, None), (2, ""), (None, "no id here"), (3, "x y z"), (3, "x y z"), (4, long)], extra=True)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    assert C.STAGES[-1][1](spark, docs, sf).count() == 6


INTERNAL = ("_h", "_id", "_i", "_j", "_cuts", "_leak", "_scored", "_score", "_clean", "_most", "i", "j", "h", "t", "k_id", "k_h", "id", "row",
            "item", "cov", "n", "c0", "score", "Score", "cuts", "masked", "leak", "fp", "root", "node", "component_id", "least_id", "text.x", "bits")


def test_stages_keep_columns_named_like_their_own(spark, docs_of, sf):
    """Every name the stages use inside, on the documents: all columns come back as they were."""
    from pyspark.sql import functions as F
    rows = [(1, "token = abcdef123456 and more"), (2, "some clean words here now"), (2, "some clean words here now"), (3, None)]
    docs = docs_of(rows).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
                                      for c in INTERNAL if c != "Score"})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r.doc_id for r in got} == {1, 2, 3}, name
        for r in got:
            assert all(r[c] == f"{c} of {r.doc_id}" for c in INTERNAL if c != "Score"), name
        docs = out
    assert {r.text for r in docs.collect()} == {"[secret] and more", "some clean words here now", None}
    assert C.STAGES[-1][1](spark, docs, sf).count() == 3
    cased = docs_of(rows).withColumn("Score", F.lit("s")).withColumn("_LEAK", F.lit("l"))
    assert C.STAGES[0][1](spark, cased, sf).columns == cased.columns == C.STAGES[2][1](spark, cased, sf).columns


def test_stages_on_empty_tables(spark, docs_of, sf):
    docs = docs_of([(1, "x")], extra=True)
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    assert C.ORACLE_SQL is None
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert {"op6_license_scan", "op7_secret_scan"} <= set(E.oracle_sql())
