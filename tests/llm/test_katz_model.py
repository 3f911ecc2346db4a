import math

import pytest
from pyspark.sql import functions as F

from botlog.llm import katz as K
from botlog.llm import katz_model as M
from tests.llm.test_katz import HELD, Brute, corpus, held, tokens

ODD = [(900, None), (901, ""), (None, "w1 w2 w1"), (902, "unseen Ünseen w1"), (5, "w1 w2"), (5, "w1 w2"),
       (903, "w1\x1cw2\x0bw3 \n w4"), (904, "w1 " * 20_000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_unseen_texts_from_stored_tables(spark, docs_of, tmp_path, order):
    rows = corpus(order, 300) + ODD
    path = str(tmp_path / "model")
    M.fit(docs_of(rows, extra=True), path, order, HELD)
    model = Brute([t for i, t in rows if not held(i)], order)
    new = [(i, t) for i, t in rows if held(i)] + corpus(77, 40) + ODD
    got = M.score(docs_of(new, extra=True), path).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = sorted([(i, len(tokens(t)), model.score(t)) for i, t in new], key=key)
    got = sorted([tuple(r) for r in got], key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(got, want))


def test_same_scores_as_the_block_form(spark, docs_of, tmp_path):
    docs = docs_of(corpus(5, 200))
    M.fit(docs, str(tmp_path / "m"), 2, HELD)
    a = {r.doc_id: r.score for r in M.score(docs, str(tmp_path / "m")).collect()}
    b = {r.doc_id: r.score for r in K.score(docs, 2, HELD).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_each_context_sums_to_one(spark, docs_of, tmp_path):
    """Seen words of a context and its weight times the lower orders' rest, from the stored tables alone."""
    path = str(tmp_path / "m")
    M.fit(docs_of(corpus(4, 150)), path, 3)
    grams = {k: {} for k in (1, 2, 3)}
    weights = {k: {r.context: r.weight for r in spark.read.parquet(f"{path}/contexts/order={k}").collect()} for k in (2, 3)}
    for r in spark.read.parquet(f"{path}/grams").collect():
        grams[r.order][r.context, r.word] = r.p
    unseen = spark.read.parquet(f"{path}/levels").where("`order` = 1").first().unseen
    assert math.isclose(sum(grams[1].values()) + unseen, 1, rel_tol=1e-9)

    def p(context, w, k):
        if (context, w) in grams[k]:
            return grams[k][context, w]
        if k == 1:
            return unseen
        parts = context.split(" ")
        return weights[k].get(context, 1.0) * p(" ".join(parts[1:]) if len(parts) == k - 1 else context, w, k - 1)

    words = [w for _, w in grams[1]] + ["never seen"]
    for context in sorted(weights[3])[::200] + ["w0 never"]:
        assert math.isclose(sum(p(context, w, 3) for w in words), 1, rel_tol=1e-9)


def test_no_training_rows_and_empty_tables(spark, docs_of, tmp_path):
    path = str(tmp_path / "m")
    M.fit(docs_of([(1, "a b")]), path, 2, "true")
    assert [tuple(r) for r in M.score(docs_of([(1, "a b"), (1, None)]), path).orderBy("n_tokens").collect()] == [(1, 1, 0.0), (1, 3, 0.0)]
    assert M.score(docs_of([(1, "a")]).limit(0), path).count() == 0
    M.fit(docs_of([(1, "a b")]), path, 2)  # a model is replaced
    assert M.score(docs_of([(1, "a b")]), path).first().score < 0


def test_a_filter_on_a_context_reads_few_files(spark, docs_of, tmp_path):
    path = str(tmp_path / "m")
    M.fit(docs_of(corpus(6, 400)), path, 2)
    plan = spark.read.parquet(f"{path}/grams").where((F.col("order") == 2) & (F.col("context") == "w7"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(context), EqualTo(context,w7)]" in text and "PartitionFilters: [isnotnull(order" in text
    contexts = [{r.context for r in spark.read.parquet(f).select("context").distinct().collect()}
                for f in spark.read.parquet(f"{path}/grams/order=2").inputFiles()]
    assert sum("w7" in c for c in contexts) <= 2
