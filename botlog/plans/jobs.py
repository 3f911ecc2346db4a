"""End-to-end jobs, the programmatic form of the reference's scripts:

* :func:`parse_job`       raw log text -> request table (+ reject count)
* :func:`feature_table`   request table -> materialised per-IP features
* :func:`anomaly_job`     features -> isolation-forest scores, contamination
                          sweep, best level and labels
* :func:`supervised_job`  features -> stratified split, random forest,
                          test metrics, importances, predictions for all rows

Intermediate tables that are read several times (per-IP features, scores)
are cut from their lineage with ``checkpoint()`` into the shared checkpoint
folder (``spark.checkpoint.dir``), so a lost executor does not replay the
raw-log scan and later stages read a compact table.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.operators import daily, evaluate, features, forest, iforest, marts, parse, scaling
from botlog.session import checkpoint_root
from botlog.sources.files import read_parsed_log, write_parsed_log

CONTAMINATION_LEVELS = (0.01, 0.02, 0.05, 0.10)


def parse_job(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, rejected lines), both lazy."""
    return parse.parse_log_lines(lines), parse.rejected_lines(lines)


def ingest(lines: DataFrame, path: str, partition_by_date: bool = True) -> DataFrame:
    """Parse once and store the request table as Parquet (partitioned by UTC
    date); returns the typed scan of the stored table.

    This is the production entry point: the regex runs once per line, and
    every later job (features run two aggregation chains over it, marts
    re-read it) scans only the columns it needs, with date pruning. No
    shuffle: each task writes the dates its split covers (log files are
    time-ordered, so a split covers few dates)."""
    spark = lines.sparkSession
    write_parsed_log(parse.parse_log_lines(lines), path, partition_by_date=partition_by_date)
    return read_parsed_log(spark, path)


def feature_table(requests: DataFrame, version: int = 2, materialize: bool = True) -> DataFrame:
    """Per-IP features from a request table in its post-CSV form."""
    r = parse.with_null_tokens(requests)
    f = features.ip_features_v2(r) if version == 2 else features.ip_features_v1(r)
    if materialize:
        checkpoint_root(f.sparkSession)
        f = f.checkpoint(eager=True)
    return f


def update_features(spark: SparkSession, requests_path: str, states_root: str, day, fold: bool = True) -> DataFrame:
    """The daily form of :func:`feature_table`: aggregates the requests of
    ``day`` (a date) from the date-partitioned store, and returns the v2 features
    of all history from the stored states, checkpointed. With ``fold`` the days
    before ``day`` are folded into a snapshot, so the next update reads one row
    per address and path of them."""
    states = daily.FeatureStates(spark, states_root)
    states.update_day(requests_path, day)
    if fold:
        before = day - dt.timedelta(days=1)
        if before not in states.snapshots():
            states.compact(before)
    checkpoint_root(spark)
    return states.features().checkpoint(eager=True)


@dataclass
class AnomalyResult:
    model: iforest.IsolationForestModel
    scores: DataFrame          # features + score_samples, anomaly_score, is_anomaly (best level)
    sweep: DataFrame           # contamination, precision, recall, f1, auc
    best: float                # chosen contamination


def evaluation_input(scores: DataFrame) -> DataFrame:
    """(y_true, y_pred, score) of a scored feature table."""
    return scores.select(F.col("ua_bot_flag").alias("y_true"), F.col("is_anomaly").alias("y_pred"),
                         (-F.col("anomaly_score")).alias("score"))


def detector_evaluation(scores: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp, auc and how many of the 20 most anomalous
    addresses carry the user-agent flag."""
    ev = evaluation_input(scores)
    auc = evaluate.roc_auc_value(ev)
    flagged = marts.top20_flagged_count(scores).first()["flagged"]
    return (evaluate.confusion_matrix(ev).withColumn("auc", F.lit(auc).cast("double"))
            .withColumn("top20_flagged", F.lit(flagged).cast("long")))


def mart_tables(requests: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's tables from a stored request table and a score table, with the default filters."""
    r = parse.with_null_tokens(requests)
    sus = marts.suspicious_ips(scores)
    ua = marts.ua_stats(r, sus)
    return {"overview": marts.overview_metrics(r, scores, sus), "traffic_over_time": marts.traffic_over_time(r, sus),
            "suspicious_ips": sus, "drilldown_candidates": marts.drilldown_candidates(sus), "ua_stats": ua,
            "top_user_agents": marts.top_user_agents(ua), "ua_category_counts": marts.ua_category_counts(r),
            "path_abuse": marts.path_abuse(r, sus), "score_range": marts.score_range(scores)}


def anomaly_job(feats: DataFrame, feature_cols=features.V2_FEATURES, levels=CONTAMINATION_LEVELS,
                n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> AnomalyResult:
    """Standardise, fit one forest, score once, evaluate every contamination
    level against the user-agent flag and keep the level with the best F1."""
    cols = list(feature_cols)
    scaled = scaling.standardize(feats, cols, suffix="__z")
    zcols = [f"{c}__z" for c in cols]
    model = iforest.fit_isolation_forest(scaled.select("ip", *zcols), zcols, n_trees=n_trees,
                                         max_samples=max_samples, seed=seed)
    raw = model.score_samples(scaled, "score_samples").drop(*zcols).checkpoint(eager=True)
    sweep = evaluate.contamination_sweep(raw, "score_samples", "ua_bot_flag", levels)
    rows = sweep.collect()  # one row per level
    sweep = sweep.sparkSession.createDataFrame(rows, sweep.schema)
    best = min(rows, key=lambda r: (-r["f1"], r["contamination"]))
    scores = iforest.apply_offset(raw, best["cut"])
    return AnomalyResult(model, scores, sweep, best["contamination"])


def anomaly_job_v1(feats: DataFrame, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """The first detector: six v1 features, one contamination level.
    ``feats`` is a v1 (or v2) feature table."""
    cols = list(features.V1_FEATURES)
    scaled = scaling.standardize(feats, cols, suffix="__z")
    zcols = [f"{c}__z" for c in cols]
    model = iforest.fit_isolation_forest(scaled.select("ip", *zcols), zcols, seed=seed)
    return iforest.score(model, scaled, contamination).drop(*zcols)


@dataclass
class SupervisedResult:
    fit: forest.ForestFit
    split: DataFrame             # features + is_test
    feats: DataFrame

    @cached_property
    def test_evaluation(self) -> DataFrame:
        """(y_true, y_pred, score) on the held-out rows, scored once and stored."""
        label = self.fit.label
        pred = self.fit.predict(self.split.filter(F.col("is_test") == 1))
        return pred.select(F.col(label).alias("y_true"), F.col("predicted_bot").alias("y_pred"),
                           F.col("bot_probability").alias("score")).checkpoint(eager=True)

    @property
    def test_metrics(self) -> DataFrame:
        """One row: n_train, n_test, precision, recall, f1, auc (test set)."""
        auc = evaluate.roc_auc_value(self.test_evaluation)
        cells = evaluate.confusion_matrix(self.test_evaluation).first()
        test = F.col("is_test") == 1
        counts = self.split.agg(F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"))
        prec, rec, f1 = evaluate.precision_recall_f1_from_counts(*[F.lit(cells[c]).cast("long") for c in ("tp", "fp", "fn")])
        return counts.select("n_train", "n_test", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                             F.lit(auc).cast("double").alias("auc"))

    @property
    def test_report(self) -> DataFrame:
        return evaluate.classification_report(self.test_evaluation, names=("Human", "Bot"))

    @property
    def test_confusion(self) -> DataFrame:
        return evaluate.confusion_matrix(self.test_evaluation)

    @property
    def importances(self) -> DataFrame:
        return self.fit.importances(self.feats.sparkSession)

    @property
    def predictions(self) -> DataFrame:
        """All rows (train rows included) + bot_probability, predicted_bot."""
        return self.fit.predict(self.feats)


def supervised_job(feats: DataFrame, feature_cols=features.V2_FEATURES, label: str = "ua_bot_flag",
                   seed: int = 42, n_trees: int = 100, max_depth: int = 30) -> SupervisedResult:
    split = forest.stratified_split(feats, label, seed=seed).checkpoint(eager=True)
    train = split.filter(F.col("is_test") == 0)
    fit = forest.fit_random_forest(train, feature_cols, label, n_trees=n_trees, seed=seed, max_depth=max_depth)
    return SupervisedResult(fit, split, feats)


def rule_hits(feats: DataFrame) -> DataFrame:
    """Addresses whose user agent names a bot, as hits by rule."""
    return feats.filter(F.col("ua_bot_flag") == 1).select(
        *feats.columns, F.lit(None).cast("double").alias("anomaly_score"), F.lit(1).alias("is_bot"), F.lit("rule").alias("detected_by"))


def hybrid_job(feats: DataFrame, feature_cols=features.V2_FEATURES, contamination: float = 0.05, n_trees: int = 100,
               seed: int = 42) -> DataFrame:
    """Rules first, the forest on the rest: addresses whose user agent names a
    bot are hits by rule (``detected_by`` "rule", no score); an isolation
    forest is fitted on the others only, and those below its cut are hits by
    "forest". Every address of ``feats`` has one row; without any unflagged
    address there is no forest and only the rule decides."""
    cols = list(feature_cols)
    by_rule = rule_hits(feats)
    rest = feats.filter(F.coalesce(F.col("ua_bot_flag"), F.lit(0)) != 1)
    if rest.isEmpty():
        return by_rule
    scaled = scaling.standardize(rest, cols, suffix="__z")
    zcols = [f"{c}__z" for c in cols]
    model = iforest.fit_isolation_forest(scaled.select("ip", *zcols), zcols, n_trees=n_trees, seed=seed)
    scored = iforest.score(model, scaled, contamination)
    return by_rule.unionByName(scored.select(
        *feats.columns, "anomaly_score", F.col("is_anomaly").alias("is_bot"),
        F.when(F.col("is_anomaly") == 1, "forest").alias("detected_by")))


def with_folds(feats: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``_fold``, a hash of the address: it does not depend on partitioning."""
    return feats.withColumn("_fold", F.pmod(forest.hash52("ip", seed), F.lit(folds)))


def cross_validate(feats: DataFrame, folds: int = 5, feature_cols=features.V2_FEATURES, label: str = "ua_bot_flag",
                   seed: int = 42, n_trees: int = 100, max_depth: int = 30) -> DataFrame:
    """(fold, n_train, n_test, precision, recall, f1, auc) of the random
    forest, one row for each fold. A row's fold is a hash of its address, so
    folds do not depend on partitioning; AUC is null where a fold has one
    class. One fit per fold, and one row of metrics each reaches the driver."""
    evaluate.require_positive_labels(feats, label)
    x = with_folds(feats, folds, seed).checkpoint(eager=True)
    rows = []
    for k in range(folds):
        test = x.filter(F.col("_fold") == k).drop("_fold")
        train = x.filter(F.col("_fold") != k).drop("_fold")
        fit = forest.fit_random_forest(train, feature_cols, label, n_trees=n_trees, seed=seed, max_depth=max_depth)
        ev = fit.predict(test).select(F.col(label).alias("y_true"), F.col("predicted_bot").alias("y_pred"),
                                      F.col("bot_probability").alias("score")).checkpoint(eager=True)  # scored once
        cm = evaluate.confusion_matrix(ev)
        p, r, f = evaluate.precision_recall_f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
        m = cm.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), p.alias("p"), r.alias("r"), f.alias("f")).first()
        rows.append((k, train.count(), m["n"], m["p"], m["r"], m["f"], evaluate.roc_auc_value(ev)))
    return feats.sparkSession.createDataFrame(
        rows, "fold int, n_train long, n_test long, precision double, recall double, f1 double, auc double")
