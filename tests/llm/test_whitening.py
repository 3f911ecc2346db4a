import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from botlog.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0)
                                  for i, v in vectors], SCHEMA)


def brute(rows, k=8):
    """(n, {id: deviation}, eigenvalues, trace, covariance, x of every remaining row) by whole-list numpy and Python integers."""
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[j] for _, v in x) for j in range(d)]
    dev = [(i, sum((n * v[j] - s[j]) ** 2 for j in range(d))) for i, v in x]
    y = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for _, v in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return n, dev, e[::-1][:k], np.trace(cov), u[:, ::-1][:, :k], y


def check(rows, got, k=8):
    n, dev, e, trace, u, y = brute(rows, k)
    assert len(got) == n * min(k, y.shape[1])
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(dev)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-6
    for c in range(1, min(k, y.shape[1]) + 1):
        z = {}
        for r in got:
            if r.component == c:
                z.setdefault(r.vec_id, []).append(r.whitened)
                assert r.explained == pytest.approx(e[c - 1] / trace, rel=1e-8)
        want = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        sign = np.sign(sum(a * z[i][0] for (i, _), a in zip(rows, want)))
        for (i, _), a in zip(rows, want):
            assert z[i][0] == pytest.approx(sign * a, abs=1e-6)


def test_equals_brute_force_with_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12)) @ np.diag(np.linspace(1, 0.1, 12))
    rows = [(i, base[i]) for i in range(60)] + [(100 + i, base[0]) for i in range(200)] + [(400 + i, base[1]) for i in range(3)]
    got = W.whiten(frame(spark, rows).repartition(7)).collect()
    check(rows, got)
    assert sorted({r.component for r in got}) == list(range(1, 9))
    few = W.whiten(frame(spark, [(i, v[:3]) for i, v in rows]))
    check([(i, v[:3]) for i, v in rows], few.collect(), k=3)


def test_weight_one_fits_distinct_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 4))
    rows = [(i, base[i]) for i in range(30)]
    alone = {r.vec_id: r for r in W.whiten(frame(spark, rows)).where("component = 2").collect()}
    many = W.whiten(frame(spark, rows + [(100 + i, base[3]) for i in range(90)]), multiplicity=False).where("component = 2").collect()
    assert len(many) == 120 and {r.n for r in many} == {30}
    for r in many:
        a = alone[r.vec_id if r.vec_id < 100 else 3]
        assert r.whitened == pytest.approx(a.whitened, abs=1e-9) and r.deviation == a.deviation


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=3)) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1, None, 2]), (53, [1, math.nan, 2]), (54, [math.inf, 0, 0]), (55, [1e30, 0, 0]), (56, [1, 2]), (57, [1] * 5)]
    df = frame(spark, good + bad + [good[0], good[1]]).withColumns({c: F.lit("x") for c in ("id", "x", "w", "key", "n", "component", "v")})
    check(good + [good[0], good[1]], W.whiten(df).collect(), k=3)
    none = W.whiten(frame(spark, bad[:6]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    nulls = W.whiten(frame(spark, [(None, v) for _, v in good])).collect()
    assert len(nulls) == 60 and {r.vec_id for r in nulls} == {None}


def test_without_variance(spark):
    same = W.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(9)])).collect()
    assert len(same) == 18 and {(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in same} == {(None, 0.0, 0.0, 0, 9)}
    line = W.whiten(frame(spark, [(i, [i / 8, 1.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9


def test_exact_deviation_beyond_floats():
    rng = np.random.default_rng(8)
    x = rng.integers(99_000, 101_000, (40, 3)).astype(np.int64)
    for n in (40, 10 ** 5, 4 * 10 ** 6, 10 ** 8):
        s = [int(v) * (n // 40) for v in x.sum(axis=0)]
        whole = np.array([v // n for v in s], np.int64)
        for row, got in zip(x, W.deviations(x, n, s, whole)):
            want = sum((n * int(c) - t) ** 2 for c, t in zip(row, s))
            assert got == (want if want < 2 ** 63 else None)


def test_exact_sums_of_large_entries(spark):
    rows = [(i, [(1 << 40) - 2 ** 20 * 5, -(2.0 ** 39), 0.25 * i]) for i in range(12)]
    g = W.integer_vectors(frame(spark, rows), "vec_id", "embedding").groupBy("x").agg(F.count("*").alias("w"))
    n, s = W.exact_sums(g, 3)
    want = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    assert n == 12 and s == [sum(v[j] for v in want) for j in range(3)]


def test_query_on_the_given_table(spark, sf):
    got = W.op13_embedding_whitening(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, got)
