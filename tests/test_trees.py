import numpy as np
import pytest
from pyspark.sql import functions as F

from botlog.operators import evaluate, features, forest, trees
from botlog.plans import catalog, jobs

COLS = ["a", "b", "c", "d"]


def _table(spark, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 3] + 0.5 * rng.normal(size=n) > 0.8).astype(int)
    rows = [(f"ip{i}", *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ip string, a double, b double, c double, d double, ua_bot_flag int")


def _data(df):
    return df.select(F.xxhash64("ip").alias("_k"), F.array(*COLS).alias("_x"), F.col("ua_bot_flag").alias("_y"))


def _plan(n_trees=6, **kw):
    return trees.Plan(**{"n_trees": n_trees, "seed": 3, "max_depth": 30, "max_bins": 16, "n_features": 4, "subset": 2,
                         "weights": np.array([0.6, 2.5]), **kw})


def _scored(model, df):
    return [(r.s.p, r.s.y) for r in df.select("ip", model.scores(df, COLS).alias("s")).orderBy("ip").collect()]


def test_forest_depends_neither_on_partitions_nor_on_where_a_node_is_grown(spark):
    df = _table(spark)
    whole = trees.fit(_data(df.repartition(1)), _plan(), 1500)
    parts = trees.fit(_data(df.repartition(7)), _plan(), 1500, local_rows=40)
    assert [t.numNodes for t in whole.trees] == [t.numNodes for t in parts.trees]
    assert _scored(whole, df) == _scored(parts, df)
    np.testing.assert_allclose(whole.importance, parts.importance, rtol=1e-9)
    assert whole.importance.sum() == pytest.approx(1)


def test_subtree_is_that_of_a_plain_recursion():
    rng = np.random.default_rng(1)
    plan = _plan(max_depth=6)
    bins, y, w = rng.integers(0, 16, (300, 4)).astype(np.uint8), rng.integers(0, 2, 300), rng.integers(1, 4, 300)
    got = trees.grow(plan, 2, 1, 0, bins, y, w)

    def gini(i):
        c = np.bincount(y[i], weights=w[i], minlength=2) * plan.weights
        return c.sum(), 1 - ((c / c.sum()) ** 2).sum()

    def check(node, i, path, depth):
        assert got.counts[node].tolist() == np.bincount(y[i], weights=w[i], minlength=2).tolist()
        n, g = gini(i)
        best = 0.0
        if g > 0 and depth < 6:
            for f in trees.subsets(plan, 2, np.array([path]))[0]:
                for b in range(15):
                    left, right = i[bins[i, f] <= b], i[bins[i, f] > b]
                    if len(left) and len(right):
                        (nl, gl), (nr, gr) = gini(left), gini(right)
                        best = max(best, g - nl / n * gl - nr / n * gr)
        if got.feature[node] < 0:
            assert best < 1e-9
            return 1
        assert got.gain[node] == pytest.approx(best)
        go = bins[i, got.feature[node]] > got.bin[node]
        return 1 + check(got.child[node], i[~go], 2 * path, depth + 1) + check(got.child[node] + 1, i[go], 2 * path + 1, depth + 1)

    assert check(0, np.arange(300), 1, 0) == got.numNodes
    small = got.pruned(plan.weights)
    says = lambda t: (t.counts[t.walk(bins)] * plan.weights).argmax(1).tolist()
    assert small.numNodes < got.numNodes and says(small) == says(got)
    inner = np.flatnonzero(small.feature >= 0)
    label, leaf = (small.counts * plan.weights).argmax(1), small.feature < 0
    assert not any(leaf[small.child[i]] and leaf[small.child[i] + 1] and label[small.child[i]] == label[small.child[i] + 1] for i in inner)


def test_thresholds_are_midpoints_and_bounded():
    assert trees.candidates(np.array([3.0, 1.0, 1.0, 7.0]), np.ones(4), 16).tolist() == [2.0, 5.0]
    many = trees.candidates(np.arange(1000.0), np.ones(1000), 16)
    assert len(many) == 15 and np.all(np.abs(np.diff(many) - 62.5) <= 1)
    assert trees.candidates(np.ones(5), np.ones(5), 16).tolist() == []


def test_draws_are_poisson_by_key_and_tree():
    keys = np.arange(200_000, dtype=np.int64)
    a, b = trees.draws(keys, 0, 42), trees.draws(keys, 1, 42)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert trees.draws(keys[500:600], 0, 42).tolist() == a[500:600].tolist()


def test_large_tables_get_a_forest_as_good_as_spark_mls(spark):
    df, new = _table(spark), _table(spark, 1000, seed=6)
    auc, tops = [], []
    for rows in (0, 10_000):
        fit = forest.fit_random_forest(df, COLS, n_trees=40, spark_ml_rows=rows)
        assert isinstance(fit.model, trees.Forest) == (rows == 0)
        p = fit.predict(new)
        assert p.columns == [*new.columns, "bot_probability", "predicted_bot"] and p.count() == 1000
        auc.append(evaluate.roc_auc_value(p.select(F.col("ua_bot_flag").alias("y_true"), F.col("bot_probability").alias("score"))))
        imp = {r.feature: r.importance for r in fit.importances(spark).collect()}
        assert sum(imp.values()) == pytest.approx(1)
        tops.append(imp)
    assert auc[0] == pytest.approx(auc[1], abs=0.02)
    assert all(tops[0][c] == pytest.approx(tops[1][c], abs=0.06) for c in COLS)


def test_odd_rows(spark):
    """Null ids and null features are rows as any; no positive label is an error, other labels stay with Spark ML."""
    df = _table(spark, 300).withColumn("ip", F.when(F.col("a") > 0, F.col("ip"))).withColumn("b", F.when(F.col("c") > 0, F.col("b")))
    fit = forest.fit_random_forest(df, COLS, n_trees=5, spark_ml_rows=0)
    assert fit.predict(df).filter("bot_probability between 0 and 1").count() == 300
    assert forest.fit_random_forest(df.drop("ip"), COLS, n_trees=2, spark_ml_rows=0).predict(df).count() == 300
    with pytest.raises(ValueError):
        forest.fit_random_forest(df.filter("ua_bot_flag = 0"), COLS, spark_ml_rows=0)
    other = forest.fit_random_forest(df.withColumn("ua_bot_flag", F.col("ua_bot_flag") + 1), COLS, n_trees=2, spark_ml_rows=0)
    assert not isinstance(other.model, trees.Forest)


def test_held_out_rows_are_scored_once(spark):
    res = jobs.supervised_job(_table(spark), COLS, n_trees=3, max_depth=4)
    ev = res.test_evaluation
    assert res.test_evaluation is ev
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "UDF" not in plan and "Python" not in plan
    m = res.test_metrics.first()
    assert (m.n_train, m.n_test) == (res.split.filter("is_test = 0").count(), ev.count())


def test_thresholds_come_from_all_rows(spark):
    """More rows than Spark ML's sample: ties over many steps, few values, a rare value, equal steps and negative values."""
    rng = np.random.default_rng(8)
    n = 20_000
    x = np.column_stack([rng.normal(size=n), np.where(rng.random(n) < 0.6, 3.0, rng.integers(0, 4000, n)), rng.integers(0, 3, n),
                         np.arange(n) % 64]).astype(float)
    x[:, 2][:2] = 9.0
    y = rng.integers(0, 2, n)
    df = spark.createDataFrame([(f"ip{i}", *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "ip string, a double, b double, c double, d double, ua_bot_flag int")
    plan = _plan(n_trees=1, max_depth=2)
    got = trees.fit(_data(df.repartition(5)), plan, n).thresholds
    want = [trees.candidates(x[:, i], plan.weights[y], 16) for i in range(4)]
    assert want[2].tolist() == [0.5, 1.5, 5.5] and len(want[0]) == len(want[3]) == 15
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12)


def test_thresholds_over_all_rows_of_many_tables(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        n, bins = int(rng.integers(40, 400)), int(rng.integers(3, 40))
        x = np.column_stack([rng.integers(0, rng.integers(1, 300), n), rng.zipf(1.4, n), rng.integers(-5, 5, n) * 0.5, np.zeros(n)]).astype(float)
        y = (rng.random(n) < 0.2).astype(int)
        df = spark.createDataFrame([(list(map(float, v)), int(t)) for v, t in zip(x, y)], "_x array<double>, _y int")
        plan = _plan(max_bins=bins, weights=np.array([1.0, 4.0]))  # whole weights: no ties by rounding
        for a, i in zip(trees.all_thresholds(df, plan), range(4), strict=True):
            assert a.tolist() == trees.candidates(x[:, i], plan.weights[y], bins).tolist()


def test_every_training_row_is_fitted_whatever_a_task_may_hold(spark):
    df = _table(spark)
    whole = forest.fit_random_forest(df, COLS, n_trees=8, spark_ml_rows=0)
    bound = forest.fit_random_forest(df, COLS, n_trees=8, spark_ml_rows=0, max_fit_rows=100)
    for fit in (whole, bound):
        drawn = [t.counts[0].sum() for t in fit.model.trees]
        assert 1400 < np.mean(drawn) < 1600
    assert [t.numNodes for t in whole.model.trees] == [t.numNodes for t in bound.model.trees]
    probability = lambda fit: [r[0] for r in fit.predict(df).orderBy("ip").select("bot_probability").collect()]
    assert probability(whole) == probability(bound)


def test_forest_too_large_for_the_driver_scores_where_it_is_stored(spark):
    df, plan = _table(spark), _plan()
    held = trees.fit(_data(df), plan, 1500, local_rows=150)
    apart = trees.fit(_data(df.repartition(5)), plan, 1500, local_rows=150, held_nodes=0)
    assert held.below is None and apart.below.count() > 6
    assert sum(t.numNodes for t in apart.trees) < sum(t.numNodes for t in held.trees) / 4
    np.testing.assert_allclose(held.importance, apart.importance, rtol=1e-9)
    rows = df.unionByName(df.limit(300)).withColumn("ip", F.when(F.col("a") > -1, F.col("ip")))  # rows twice, null ids
    scored = apart.scored(rows.repartition(3), COLS)
    assert scored.columns == [*rows.columns, "_s"]
    order = lambda d: sorted((tuple(r[:5]), r._s.p, r._s.y) for r in d.select(*COLS, "ua_bot_flag", "_s").collect())
    assert order(scored) == order(held.scored(rows, COLS))
    assert apart.scored(rows.limit(0), COLS).count() == 0


def test_more_classes_and_bins_keep_to_all_rows(spark):
    df = _table(spark, 3000).withColumn("ua_bot_flag", F.when(F.col("b") > 1, 2).otherwise(F.col("ua_bot_flag")))
    fit = forest.fit_random_forest(df, COLS, n_trees=10, max_bins=16)
    assert not isinstance(fit.model, trees.Forest)  # Spark ML reads all rows of a table this small for its thresholds
    big = df.crossJoin(spark.range(6).withColumnRenamed("id", "k")).withColumn("ip", F.concat_ws("-", "ip", "k")).drop("k")
    fit = forest.fit_random_forest(big, COLS, n_trees=10, max_bins=16)
    assert isinstance(fit.model, trees.Forest) and len(fit.model.plan.weights) == 3
    right = fit.predict(big).filter(F.col("predicted_bot") == F.col("ua_bot_flag")).count()
    assert right > 0.8 * 18_000
    wide = forest.fit_random_forest(df.withColumn("ua_bot_flag", F.col("ua_bot_flag") % 2), COLS, n_trees=4, max_bins=40)
    x = np.array([r[0] for r in df.select("a").collect()])
    assert isinstance(wide.model, trees.Forest) and len(wide.model.thresholds[0]) == 39
    plan = _plan(n_trees=2, max_bins=400)
    fine = trees.fit(_data(df.withColumn("ua_bot_flag", F.col("ua_bot_flag") % 2)), plan, 3000, local_rows=500)
    assert len(fine.thresholds[0]) > 390 and int(trees.to_bins(plan, x[:, None], fine.thresholds[:1]).max()) > 390
    assert max(int(t.bin.max()) for t in fine.trees) > 255


@pytest.mark.parametrize("key", ["rf_fit", "feature_importance", "rf_cross_validation", "rf_predictions", "rf_roc_curve", "rf_test_confusion", "rf_test_report"])
def test_query_fits_every_training_row(spark, monkeypatch, key):
    """Each fit gets all rows that are not held out, and the thresholds of all of them: more than Spark ML's sample."""
    n, cols = 30_000, list(features.V2_FEATURES)
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10 ** 6)) / 10 ** 6
    table = spark.range(n).select(F.concat(F.lit("ip"), "id").alias("ip"), (u(0) < 0.3).cast("int").alias("ua_bot_flag"),
                                  *[(u(i + 1) + u(0) * int(i == 2)).alias(c) for i, c in enumerate(cols)])
    seen, real = [], trees.fit

    def spied(data, plan, n_rows, *a, **k):
        small = trees.Plan(2, plan.seed, 3, plan.max_bins, plan.n_features, plan.subset, np.rint(plan.weights * 64) / 64)  # exact sums
        got = real(data, small, n_rows, *a, **k)
        seen.append((data.count(), n_rows, got.thresholds, small, data.select("_x", "_y").collect()))
        return got

    monkeypatch.setattr(trees, "fit", spied)
    monkeypatch.setattr(catalog, "_features", lambda spark, sf: table)
    assert catalog.all_queries()[key](spark, "sf").count() > 0
    assert len(seen) == (5 if key == "rf_cross_validation" else 1)
    for rows, n_rows, thresholds, plan, xy in seen:
        assert rows == n_rows and 0.65 * n < rows < 0.85 * n
        x, w = np.array([r["_x"] for r in xy]), plan.weights[[r["_y"] for r in xy]]
        for i in (0, 2, 12):
            np.testing.assert_allclose(thresholds[i], trees.candidates(x[:, i], w, plan.max_bins), rtol=1e-12)


def test_a_tree_without_any_drawn_row(spark):
    df = _table(spark, 2).withColumn("ua_bot_flag", (F.col("ip") == "ip0").cast("int"))
    keys = np.array([r._k for r in _data(df).collect()], np.int64)
    seed = next(s for s in range(1000) if not trees.draws(keys, 0, s).any())
    fit = forest.fit_random_forest(df, COLS, n_trees=1, seed=seed, spark_ml_rows=0)
    assert [(r.bot_probability, r.predicted_bot) for r in fit.predict(df).collect()] == [(0.0, 0)] * 2
