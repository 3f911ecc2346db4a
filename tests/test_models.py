import numpy as np
import pytest
from pyspark.sql import functions as F

from botlog.operators import forest, iforest
from botlog.plans import catalog, jobs
from conftest import SF_MID


def test_average_path_length():
    c = iforest.average_path_length([0, 1, 2, 256])
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert c[3] == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def _blob(spark, n=1000, outlier=True):
    rng = np.random.default_rng(11)
    rows = [(f"ip{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    if outlier:
        rows.append(("far", 40.0, -40.0))
    return spark.createDataFrame(rows, "ip string, x double, y double")


def test_planted_outlier_ranks_first_and_contamination_share(spark):
    df = _blob(spark)
    m = iforest.fit_isolation_forest(df, ["x", "y"], n_trees=50)
    s = iforest.score(m, df, contamination=0.05)
    top = s.orderBy("anomaly_score").first()
    assert top.ip == "far"
    flagged = s.filter("is_anomaly = 1").count()
    assert abs(flagged - 0.05 * 1001) <= 2


def test_partition_invariance(spark):
    df = _blob(spark, 600, outlier=False)
    outs = []
    for k in (1, 7):
        d = df.repartition(k)
        m = iforest.fit_isolation_forest(d, ["x", "y"], n_trees=20, seed=3)
        outs.append(m.score_samples(d).orderBy("ip").toPandas()["score_samples"].to_numpy())
    np.testing.assert_allclose(outs[0], outs[1], rtol=0, atol=0)


def test_small_table_uses_all_rows(spark):
    df = _blob(spark, 40, outlier=False)
    m = iforest.fit_isolation_forest(df, ["x", "y"], n_trees=5)
    roots = m.nodes[m.nodes["node"] == 0]
    assert m.psi == 40 and (roots["size"] == 40).all()
    assert m.nodes["depth"].max() <= 6


def test_stratified_split_is_exact(spark):
    f = jobs.feature_table(catalog.requests(spark, SF_MID))
    sp = forest.stratified_split(f).groupBy("ua_bot_flag", "is_test").count().collect()
    d = {(r.ua_bot_flag, r.is_test): r["count"] for r in sp}
    for cls in (0, 1):
        n = d.get((cls, 0), 0) + d.get((cls, 1), 0)
        assert d.get((cls, 1), 0) == round(0.3 * n)


def test_supervised_guard(spark):
    f = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "ip string, ua_bot_flag int, x double")
    with pytest.raises(ValueError):
        jobs.supervised_job(f, ["x"])


def test_supervised_outputs(spark):
    f = jobs.feature_table(catalog.requests(spark, SF_MID))
    res = jobs.supervised_job(f, n_trees=20, max_depth=10)
    p = res.predictions
    assert p.count() == f.count()
    assert p.filter((F.col("bot_probability") < 0) | (F.col("bot_probability") > 1)).count() == 0
    imp = res.importances.agg(F.sum("importance")).first()[0]
    assert imp == pytest.approx(1.0)
    m = res.test_metrics.first()
    assert m.n_train + m.n_test == f.count()


def test_forest_bound_keeps_scoring_every_row(spark):
    f = jobs.feature_table(catalog.requests(spark, SF_MID))
    cols = ["total_requests", "unique_paths", "path_entropy"]
    fit = forest.fit_random_forest(f, cols, n_trees=5, max_fit_rows=60)
    grown = max(t.numNodes for t in fit.model.trees)
    assert grown <= 2 * 90 and fit.predict(f).count() == f.count()


def test_forest_scores_by_a_plain_walk(spark):
    """Scores recomputed from the node table, one row and one tree at a time."""
    df = _blob(spark, 80)
    m = iforest.fit_isolation_forest(df, ["x", "y"], n_trees=8)
    nodes = {(r.tree, r.node): r for r in m.node_table(spark).collect()}
    trees = sorted({t for t, _ in nodes})

    def c(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    for r in m.score_samples(df).collect():
        total = 0.0
        for t in trees:
            node = nodes[t, 0]
            while node.feature >= 0:
                node = nodes[t, node.left if [r.x, r.y][node.feature] <= node.threshold else node.right]
            total += node.depth + c(node.size)
        assert r.score_samples == pytest.approx(-2 ** (-(total / len(trees)) / c(m.psi)))


def test_detector_evaluation_matches_counts_of_the_score_table(spark):
    s = jobs.anomaly_job(jobs.feature_table(catalog.requests(spark, SF_MID))).scores
    rows = s.select("ip", "ua_bot_flag", "is_anomaly", "anomaly_score").collect()
    e = jobs.detector_evaluation(s).first()
    count = lambda y, p: sum(r.ua_bot_flag == y and r.is_anomaly == p for r in rows)
    assert (e.tn, e.fp, e.fn, e.tp) == (count(0, 0), count(0, 1), count(1, 0), count(1, 1))
    top = sorted(rows, key=lambda r: (r.anomaly_score, r.ip))[:20]
    assert e.top20_flagged == sum(r.ua_bot_flag for r in top)
    pos = [r.anomaly_score for r in rows if r.ua_bot_flag == 1]
    neg = [r.anomaly_score for r in rows if r.ua_bot_flag == 0]
    area = sum((p < n) + 0.5 * (p == n) for p in pos for n in neg)
    assert e.auc == pytest.approx(area / (len(pos) * len(neg)))


def test_hybrid_rules_first_then_a_forest_on_the_rest(spark):
    f = jobs.feature_table(catalog.requests(spark, SF_MID))
    rows = jobs.hybrid_job(f, n_trees=20, contamination=0.1).collect()
    assert len(rows) == f.count() == len({r.ip for r in rows})
    assert all(r.is_bot == 1 and r.detected_by == "rule" and r.anomaly_score is None for r in rows if r.ua_bot_flag == 1)
    rest = [r for r in rows if r.ua_bot_flag != 1]
    assert all((r.is_bot == 1) == (r.anomaly_score < 0) == (r.detected_by == "forest") for r in rest)
    assert abs(sum(r.is_bot for r in rest) - 0.1 * len(rest)) <= 2
    only = jobs.hybrid_job(f.filter("ua_bot_flag = 1"))
    assert only.count() == f.filter("ua_bot_flag = 1").count()


def test_cross_validation_covers_every_row_once(spark):
    f = jobs.feature_table(catalog.requests(spark, SF_MID))
    rows = jobs.cross_validate(f, folds=3, n_trees=5, feature_cols=["total_requests", "path_entropy"]).collect()
    n = f.count()
    assert sum(r.n_test for r in rows) == n and all(r.n_train + r.n_test == n for r in rows)
    assert all(0 <= v <= 1 for r in rows for v in (r.precision, r.recall, r.f1))


def test_cross_validation_query_takes_the_defaults(spark, monkeypatch):
    """The registered metrics are of the forest that rf_fit trains, over the operator's own folds."""
    asked = []
    monkeypatch.setattr(catalog, "_features", lambda spark, sf: "features")
    monkeypatch.setattr(catalog.jobs, "cross_validate", lambda *a, **k: asked.append((a, k)))
    catalog._rf_cross_validation(spark, "sf")
    assert asked == [(("features",), {})]


def test_bottom_k_is_the_rule_in_any_partitioning(spark):
    import hashlib
    df = _blob(spark, 700, outlier=False)
    ids = [r.ip for r in df.collect()]
    want = set()
    for t in range(7):
        digest = {i: hashlib.md5(f"{i}:9:{t // 2}".encode()).hexdigest() for i in ids}
        want |= {(t, i) for i in sorted(ids, key=lambda i: (digest[i][13 * (t % 2):13 * (t % 2) + 13], i))[:40]}
    for parts in (1, 5, 64):
        got = iforest.bottom_k(df.repartition(parts), "ip", ["x", "y"], 7, 40, 9)
        rows = got.collect()
        assert {(r.tree, r.ip) for r in rows} == want and len(rows) == 280
    xs = {r.ip: (r.x, r.y) for r in df.collect()}
    assert all((r.x, r.y) == xs[r.ip] for r in rows)
    few = iforest.bottom_k(df.limit(30), "ip", ["x"], 3, 40, 9)
    assert few.count() == 90 and iforest.bottom_k(df.limit(0), "ip", ["x"], 3, 40, 9).count() == 0


def test_bottom_k_does_not_depend_on_batches(spark):
    df = spark.createDataFrame([(f"ip{i:04d}", 1.0) for i in range(500)][::-1], "ip string, x double").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        real = {(r.tree, r.ip) for r in iforest.bottom_k(df, "ip", ["x"], 2, 20, 1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert real == {(r.tree, r.ip) for r in iforest.bottom_k(df, "ip", ["x"], 2, 20, 1).collect()}
    h = iforest.tree_hashes(["a", "b"], 5, 3)
    assert h.shape == (2, 5) and (h >= 0).all() and (h < 2 ** 52).all() and len(set(h.ravel().tolist())) == 10


def test_a_task_hands_on_no_more_than_its_buffers(spark):
    """What leaves the map side: at most trees x k rows a task, whatever it read."""
    df = spark.range(20_000).select(F.concat(F.lit("10."), "id").alias("ip"), F.lit(1.0).alias("x")).repartition(3)
    got = iforest.bottom_k(df, "ip", ["x"], 4, 16, 1)
    assert got.count() == 64
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")
    assert got.columns == ["tree", "h", "ip", "x"]


def test_threshold_split_is_map_side_and_binomial(spark):
    n = 40_000
    df = spark.range(n).select(F.concat(F.lit("ip"), "id").alias("ip"), (F.col("id") % 10 == 0).cast("int").alias("ua_bot_flag"))
    sp = forest.threshold_split(df, test_fraction={1: 0.3, 0: 0.1})
    plan = sp._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    for cls, share in ((1, 0.3), (0, 0.1)):
        r = sp.where(F.col("ua_bot_flag") == cls).agg(F.count("*").alias("n"), F.sum("is_test").alias("k")).first()
        assert abs(r.k - share * r.n) <= 4 * (r.n * share * (1 - share)) ** 0.5
    small = {r.ip: r.is_test for r in forest.threshold_split(df.limit(500), test_fraction={1: 0.3, 0: 0.1}).collect()}
    assert all(small[r.ip] == r.is_test for r in sp.where(F.col("ip").isin(list(small))).collect())
    none = forest.threshold_split(spark.createDataFrame([(None, 1), ("a", None)], "ip string, ua_bot_flag int"), test_fraction={1: 1.0})
    assert [r.is_test for r in none.collect()] == [0, 0]
    assert forest.threshold_split(df, test_fraction=1.0).where("is_test = 0").count() == 0
