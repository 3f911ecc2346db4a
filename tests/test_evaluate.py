import math

import numpy as np
from pyspark.sql import functions as F
import pytest

from botlog.operators import evaluate
from botlog.operators.ranking import exact_percentiles, order_statistics, prefix_counts


def _ev(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int, score double")


def test_auc_with_ties(spark):
    ev = _ev(spark, [(1, 1, .9), (0, 1, .9), (1, 0, .4), (0, 0, .1)])
    assert evaluate.roc_auc_value(ev) == pytest.approx(0.625)
    assert evaluate.roc_auc_value(ev, n_buckets=3) == pytest.approx(0.625)


def test_one_class(spark):
    ev = _ev(spark, [(0, 0, .9), (0, 1, .2)])
    assert evaluate.roc_auc_value(ev) is None
    cm = evaluate.confusion_matrix(ev).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (1, 1, 0, 0)
    pts = evaluate.roc_curve(ev).collect()
    assert all(p.tpr is None for p in pts)


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8, 16)], "v double")
    got = exact_percentiles(df, "v", [0.01, 0.02, 0.05, 0.10])
    assert got == pytest.approx([1.04, 1.08, 1.2, 1.4])


def test_bucketed_prefix_equals_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for nb in (1, 7, 40):
        pc = prefix_counts(df, "v", {"c": F.lit(1)}, n_buckets=nb).toPandas().sort_values("v")
        u, c = np.unique(vals, return_counts=True)
        assert np.array_equal(pc["v"].to_numpy(), u)
        assert np.array_equal(pc["cum_c"].to_numpy(), np.cumsum(c))
    qs = [0.0, 0.013, 0.5, 0.99, 1.0]
    assert exact_percentiles(df, "v", qs, n_buckets=9) == pytest.approx(list(np.percentile(vals, [100 * q for q in qs])))
    assert order_statistics(df, "v", [0, 4999, 5000], n_buckets=5) == [np.sort(vals)[0], np.sort(vals)[-1], None]


def test_roc_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    s = np.round(rng.normal(size=3000) + y * 0.7, 1)
    ev = spark.createDataFrame([(int(a), 0, float(b)) for a, b in zip(y, s)], "y_true int, y_pred int, score double")
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc_value(ev, n_buckets=6) == pytest.approx(exp, rel=1e-12)
    pts = evaluate.roc_curve(ev, n_buckets=6).collect()
    assert len(pts) == len(np.unique(s)) + 1
    assert math.isinf(max(p.threshold for p in pts))
    last = min(pts, key=lambda p: p.threshold)
    assert last.fpr == pytest.approx(1.0) and last.tpr == pytest.approx(1.0)


def test_classification_report(spark):
    ev = _ev(spark, [(1, 1, 0.0), (1, 0, 0.0), (0, 0, 0.0), (0, 0, 0.0), (0, 1, 0.0)])
    rep = {r.label: r for r in evaluate.classification_report(ev).collect()}
    assert rep["Likely Bot"].precision == pytest.approx(0.5) and rep["Likely Bot"].recall == pytest.approx(0.5)
    assert rep["Likely Human"].recall == pytest.approx(2 / 3)
    assert rep["accuracy"].f1_score == pytest.approx(0.6) and rep["accuracy"].support == 5


def test_sweep_recall_monotone(spark):
    rng = np.random.default_rng(5)
    rows = [(f"ip{i}", int(rng.integers(0, 2)), float(rng.normal())) for i in range(2000)]
    df = spark.createDataFrame(rows, "ip string, y int, s double")
    sw = evaluate.contamination_sweep(df, "s", "y", (0.01, 0.02, 0.05, 0.10)).orderBy("contamination").collect()
    rec = [r.recall for r in sw]
    assert rec == sorted(rec)
    assert len({r.auc for r in sw}) == 1
    cuts = evaluate.contamination_cuts(df, "s", (0.01, 0.10)).collect()
    assert [c.flagged for c in cuts] == [20, 200]


def test_grouped_order_statistics(spark):
    from botlog.operators.ranking import order_statistics_by
    rng = np.random.default_rng(9)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 3))]
    df = spark.createDataFrame(rows, "g int, v double")
    for nb in (None, 6):
        got = order_statistics_by(df, "g", "v", lambda grp, n: [0, n // 2, n - 1], n_buckets=nb)
        for grp in (0, 1, 2):
            vals = np.sort([v for g, v in rows if g == grp])
            assert got[grp] == [vals[0], vals[len(vals) // 2], vals[-1]]


def _corners(points):
    """Positions kept of (tp, fp) steps by plain second differences of the running totals."""
    import numpy as np
    tp, fp = np.cumsum([p for p, _ in points]), np.cumsum([n for _, n in points])
    if len(points) <= 2:
        return list(range(len(points)))
    return np.flatnonzero(np.r_[True, (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0), True]).tolist()


@pytest.mark.parametrize("buckets", [1, 3, 16])
@pytest.mark.parametrize("scores", [60, 3, 2, 1])
def test_roc_corners_for_any_buckets(spark, buckets, scores):
    import random
    rng = random.Random(scores)
    # long straight stretches: many scores with one positive or one negative each
    rows = []
    for s in range(scores):
        p, n = rng.choice([(1, 0), (1, 0), (0, 1), (0, 1), (2, 1)])
        rows += [(1, 0, float(s))] * p + [(0, 0, float(s))] * n
    ev = spark.createDataFrame(rows, "y_true int, y_pred int, score double").repartition(3)
    full = sorted(evaluate.roc_curve(ev, buckets).collect(), key=lambda r: -r.threshold)
    steps = [(sum(1 for y, _, x in rows if x == r.threshold and y == 1), sum(1 for y, _, x in rows if x == r.threshold and y == 0))
             for r in full[1:]]
    got = sorted(evaluate.roc_curve_corners(ev, buckets).collect(), key=lambda r: -r.threshold)
    assert got == [full[0]] + [full[1 + i] for i in _corners(steps)]


def test_grouped_prefixes_and_neighbours(spark):
    from botlog.operators.ranking import prefix_counts_with_totals
    rows = [(g, v, c) for g, n in (("a", 30), ("b", 1), (None, 7)) for v, c in ((i % 11, i) for i in range(n))]
    df = spark.createDataFrame(rows, "g string, v int, c long").repartition(4)
    for desc in (False, True):
        pc, tot = prefix_counts_with_totals(df, "v", {"c": F.col("c"), "k": F.lit(1).cast("long")}, descending=desc, n_buckets=5, by=["g"], neighbours=True)
        got = pc.collect()
        assert len(got) == 11 + 1 + 7
        for r in got:
            mine = [(v, c) for g, v, c in rows if g == r.g]
            inside = [(v, c) for v, c in mine if (v >= r.v if desc else v <= r.v)]
            lower = [v for v, _ in mine if v < r.v]
            assert (r.cum_c, r.cum_k) == (sum(c for _, c in inside), len(inside))
            assert r.below_k == (sum(v == max(lower) for v, _ in mine) if lower else None)
            assert tot["_groups"][(r.g,)]["k"] == len(mine)
