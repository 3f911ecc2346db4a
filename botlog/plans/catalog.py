"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key. Every query starts from the driver's ``events`` table (via the
derived access log), so its work grows with the data.

Outputs compared against an SQL oracle are normalised by :func:`finish`:
instants become UTC ``timestamp_ntz`` and doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog import sources
from botlog.functions import logformat as lf
from botlog.operators import daily, evaluate, features, forest, iforest, marts, membership, parse, reports, scaling
from botlog.operators.ranking import exact_percentiles
from botlog.plans import jobs
from botlog.session import ensure_utc, scratch_path
from botlog.streaming import start_flag_stream, start_ingest_stream, start_session_stream, start_traffic_stream
from botlog.sources import access_log_lines

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)
        wrapped.__name__ = name
        wrapped.__doc__ = fn.__doc__
        _REGISTRY[name] = wrapped
        return wrapped
    return deco


def all_queries() -> dict[str, QueryFn]:
    return dict(_REGISTRY)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """UTC ntz instants and rounded doubles, for engine-independent compare."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- shared inputs ----------------------------------------------------------

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log_lines(spark, sf_dir)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed request table, as the parser hands it over (pre-CSV)."""
    return parse.parse_log_lines(lines(spark, sf_dir))


def requests_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request table as features and marts see it (missing-value tokens -> null)."""
    return parse.with_null_tokens(requests(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table of queries that read it more than once: parsed once,
    stored, and scanned from there in its post-CSV form."""
    path = scratch_path(spark, "requests")
    sources.write_parsed_log(requests(spark, sf_dir), path, partition_by_date=False)
    return parse.with_null_tokens(sources.read_parsed_log(spark, path))


# --- sources and parsing ----------------------------------------------------

@query("parse_log_lines")
def _parse_log_lines(spark, sf):
    return finish(requests(spark, sf))


@query("rejected_lines")
def _rejected_lines(spark, sf):
    return parse.rejected_lines(lines(spark, sf))


@query("parse_timestamp")
def _parse_timestamp(spark, sf):
    raw = parse.parse_raw_fields(lines(spark, sf))
    dt = F.col("datetime")
    return finish(raw.select("datetime", lf.parse_timestamp(dt).alias("timestamp"), lf.tz_offset(dt).alias("tz_offset")))


@query("coerce_status")
def _coerce_status(spark, sf):
    raw = parse.parse_raw_fields(lines(spark, sf))
    return raw.select(F.col("status").alias("status_text"), lf.coerce_status(F.col("status")).alias("status"))


@query("coerce_bytes")
def _coerce_bytes(spark, sf):
    raw = parse.parse_raw_fields(lines(spark, sf))
    return raw.select(F.col("size").alias("size_text"), lf.coerce_bytes(F.col("size")).alias("bytes_sent"))


@query("null_tokens")
def _null_tokens(spark, sf):
    return requests_n(spark, sf).select("ip", "method", "path", "protocol", "referrer", "user_agent")


# --- heuristic reports --------------------------------------------------------

@query("top_ips")
def _top_ips(spark, sf):
    return reports.top_ips(requests(spark, sf))


@query("top_repeated_paths")
def _top_repeated_paths(spark, sf):
    return reports.top_repeated_paths(requests(spark, sf))


@query("top_error_ips")
def _top_error_ips(spark, sf):
    return reports.top_error_ips(requests(spark, sf))


@query("suspicious_ua_requests")
def _suspicious_ua_requests(spark, sf):
    return finish(reports.suspicious_ua_requests(requests(spark, sf)))


@query("parse_summary")
def _parse_summary(spark, sf):
    return reports.parse_summary(lines(spark, sf))


@query("suspicious_ua_sample")
def _suspicious_ua_sample(spark, sf):
    return finish(reports.suspicious_ua_sample(requests(spark, sf)))


# --- row-level traits ---------------------------------------------------------


@query("minute_bucket")
def _minute_bucket(spark, sf):
    return finish(features.with_minute(requests_n(spark, sf)).select("ip", "timestamp", "minute"))


@query("status_class_flags")
def _status_class_flags(spark, sf):
    r = features.with_status_flags(requests_n(spark, sf))
    return r.select("ip", "status", *[F.col(c).cast("int").alias(c) for c in ("is_4xx", "is_5xx", "is_3xx")])


@query("ua_bot_flag")
def _ua_bot_flag(spark, sf):
    return features.with_ua_bot_flag(requests_n(spark, sf)).select("ip", "user_agent", "ua_bot_flag")


@query("login_api_flag")
def _login_api_flag(spark, sf):
    return features.with_login_api_flag(requests_n(spark, sf)).select("ip", "path", "is_login_api")


@query("time_bin_10min")
def _time_bin(spark, sf):
    return finish(features.with_time_bin(requests_n(spark, sf)).select("ip", "timestamp", "time_bin"))


@query("ua_category")
def _ua_category(spark, sf):
    return features.with_ua_category(requests_n(spark, sf)).select("ip", "user_agent", "ua_category")


# --- per-IP features ----------------------------------------------------------

@query("requests_per_minute")
def _requests_per_minute(spark, sf):
    return finish(features.requests_per_minute(requests_n(spark, sf)))


@query("ip_rpm_stats")
def _ip_rpm_stats(spark, sf):
    return finish(features.ip_rpm_stats(requests_n(spark, sf)))


@query("ip_intervals")
def _ip_intervals(spark, sf):
    return finish(features.ip_intervals(requests_n(spark, sf)))


@query("ip_interval_stats")
def _ip_interval_stats(spark, sf):
    return finish(features.ip_interval_stats(requests_n(spark, sf)))


@query("ip_path_entropy")
def _ip_path_entropy(spark, sf):
    return finish(features.ip_path_entropy(requests_n(spark, sf)))


@query("ip_features_v1")
def _ip_features_v1(spark, sf):
    return finish(features.ip_features_v1(stored(spark, sf)))


@query("ip_features_v2")
def _ip_features_v2(spark, sf):
    return finish(features.ip_features_v2(stored(spark, sf)))


def daily_states(spark, sf) -> daily.FeatureStates:
    """Daily states of the derived log, built from its date-partitioned store,
    with the first day folded into a snapshot."""
    path = scratch_path(spark, "requests-by-date")
    sources.write_parsed_log(requests(spark, sf), path)
    states = daily.FeatureStates(spark, scratch_path(spark, "states"))
    states.write_days(sources.read_parsed_log(spark, path))
    first = states.table("minutes").agg(F.min("day")).first()[0]
    if first is not None:
        states.compact(first)
    return states


@query("ip_features_v2_daily")
def _ip_features_v2_daily(spark, sf):
    """v2 features merged from a snapshot and daily states."""
    return finish(daily_states(spark, sf).features())


@query("approx_distinct_ips")
def _approx_distinct_ips(spark, sf):
    """Distinct addresses by day and of all days, from sketches kept per day."""
    sketches = daily.address_sketches(requests_n(spark, sf))
    by_day = sketches.select("day", F.hll_sketch_estimate("sketch").cast("long").alias("ips"))
    return by_day.select(F.lit("day").alias("scope"), F.col("day").cast("string").alias("day"), "ips").unionByName(
        daily.merge_sketches(sketches).select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("day"), "ips"))


@query("resource_share")
def _resource_share(spark, sf):
    return finish(features.resource_share(requests_n(spark, sf)))


@query("periodicity")
def _periodicity(spark, sf):
    return finish(features.periodicity(requests_n(spark, sf)))


@query("session_depth")
def _session_depth(spark, sf):
    return finish(features.session_depth(requests_n(spark, sf)))


@query("time_bin_10min_local")
def _time_bin_local(spark, sf):
    """Ten-minute bins on the wall clock of the log's own offset."""
    from botlog.functions import traits
    r = requests_n(spark, sf)
    return finish(r.select("ip", "timestamp", traits.local_time_bin(F.col("timestamp"), F.col("tz_offset")).alias("time_bin")))


# --- scores, marts and evaluation on the deterministic stand-in score ------------
#
# The SQL-checked mart and evaluation keys run on a score that both engines
# can compute exactly: round(0.5 - 0.1 * max_requests_per_minute -
# error_rate_4xx, 6), with is_anomaly = score below the rounded 5 % cut.
# The model-backed keys further down use the isolation forest.


DRILLDOWN_IP = "10.0.0.10"
IFOREST_SAMPLE = 64  # rows of a tree in the sample query: fewer than addresses, so that the rule decides
LEVELS = (0.01, 0.02, 0.05, 0.10)


def unlabelled_scores(r: DataFrame) -> DataFrame:
    """Features of the request table ``r`` with the score, without the cut."""
    f = jobs.feature_table(r)  # checkpointed: read by the cut and the query
    return f.withColumn("anomaly_score", F.round(
        F.lit(0.5) - F.lit(0.1) * F.col("max_requests_per_minute") - F.col("error_rate_4xx"), 6))


def deterministic_scores(spark, sf, contamination: float = 0.05) -> DataFrame:
    """With ``is_anomaly``, for the queries that return it or count by it."""
    det = unlabelled_scores(stored(spark, sf))
    cut = exact_percentiles(det, "anomaly_score", [contamination])[0]
    return det.withColumn("is_anomaly", (F.col("anomaly_score") < F.lit(round(cut, 6))).cast("int"))


def _sus(spark, sf):
    """(requests, scores, suspicious set) from one parse; the filters read the score only."""
    r = stored(spark, sf)
    scores = unlabelled_scores(r)
    return r, scores, marts.suspicious_ips(scores)


_SUS_COLS = ("ip", "total_requests", "max_requests_per_minute", "error_rate_4xx", "ua_bot_flag",
             "anomaly_score", "is_anomaly")


@query("suspicious_ips")
def _suspicious_ips(spark, sf):
    return finish(marts.suspicious_ips(deterministic_scores(spark, sf)).select(*_SUS_COLS))


@query("drilldown_candidates")
def _drilldown_candidates(spark, sf):
    _, _, sus = _sus(spark, sf)
    return finish(marts.drilldown_candidates(sus).select("ip", "anomaly_score"))


@query("ip_drilldown_timeline")
def _ip_drilldown_timeline(spark, sf):
    return finish(marts.ip_drilldown_timeline(requests_n(spark, sf), DRILLDOWN_IP))


@query("ip_drilldown_paths")
def _ip_drilldown_paths(spark, sf):
    return marts.ip_drilldown_paths(requests_n(spark, sf), DRILLDOWN_IP)


def clustered(spark, sf) -> DataFrame:
    """The derived log in a store ordered by address, null tokens applied before
    storing so that the filter on the address is on a stored column."""
    path = scratch_path(spark, "requests-by-address")
    sources.write_clustered_log(requests_n(spark, sf), path)
    return sources.read_parsed_log(spark, path)


@query("ip_drilldown_timeline_clustered")
def _ip_drilldown_timeline_clustered(spark, sf):
    return finish(marts.ip_drilldown_timeline(clustered(spark, sf), DRILLDOWN_IP))


@query("ip_drilldown_paths_clustered")
def _ip_drilldown_paths_clustered(spark, sf):
    return marts.ip_drilldown_paths(clustered(spark, sf), DRILLDOWN_IP)


@query("overview_metrics")
def _overview_metrics(spark, sf):
    r, scores, sus = _sus(spark, sf)
    return finish(marts.overview_metrics(r, scores, sus))


@query("suspicious_requests")
def _suspicious_requests(spark, sf):
    r, _, sus = _sus(spark, sf)
    r = marts.suspicious_requests(r, sus)
    return finish(r.select("ip", "timestamp", "path", "status", "user_agent"))


@query("request_suspicious_flag")
def _request_suspicious_flag(spark, sf):
    r, _, sus = _sus(spark, sf)
    r = marts.request_suspicious_flag(r, sus)
    return finish(r.select("ip", "timestamp", "path", F.col("is_suspicious").cast("int").alias("is_suspicious")))


@query("suspicious_requests_bloom")
def _suspicious_requests_bloom(spark, sf):
    r, _, sus = _sus(spark, sf)
    return finish(membership.suspicious_requests(r, sus).select("ip", "timestamp", "path", "status", "user_agent"))


@query("request_suspicious_flag_bloom")
def _request_suspicious_flag_bloom(spark, sf):
    r, _, sus = _sus(spark, sf)
    r = membership.request_suspicious_flag(r, sus)
    return finish(r.select("ip", "timestamp", "path", F.col("is_suspicious").cast("int").alias("is_suspicious")))


@query("traffic_over_time")
def _traffic_over_time(spark, sf):
    r, _, sus = _sus(spark, sf)
    return finish(marts.traffic_over_time(r, sus))


@query("traffic_over_time_local")
def _traffic_over_time_local(spark, sf):
    """Traffic by ten minutes of the log's own wall clock."""
    r, _, sus = _sus(spark, sf)
    return finish(marts.traffic_over_time(r, sus, local=True))


@query("ua_stats")
def _ua_stats(spark, sf):
    r, _, sus = _sus(spark, sf)
    return marts.ua_stats(r, sus)


@query("top_user_agents")
def _top_user_agents(spark, sf):
    r, _, sus = _sus(spark, sf)
    return marts.top_user_agents(marts.ua_stats(r, sus))


@query("ua_category_counts")
def _ua_category_counts(spark, sf):
    return marts.ua_category_counts(requests_n(spark, sf))


@query("path_abuse")
def _path_abuse(spark, sf):
    r, _, sus = _sus(spark, sf)
    return marts.path_abuse(r, sus)


@query("score_range")
def _score_range(spark, sf):
    return finish(marts.score_range(unlabelled_scores(stored(spark, sf))))


@query("top_anomalies")
def _top_anomalies(spark, sf):
    return finish(marts.top_anomalies(deterministic_scores(spark, sf)))


@query("top20_flagged_count")
def _top20_flagged_count(spark, sf):
    return marts.top20_flagged_count(deterministic_scores(spark, sf))


def _ranked(spark, sf) -> DataFrame:
    """Labels and scores, for the queries that rank and never read the cut."""
    s = unlabelled_scores(stored(spark, sf))
    return s.select(F.col("ua_bot_flag").alias("y_true"), (-F.col("anomaly_score")).alias("score"))


def _ev(spark, sf) -> DataFrame:
    s = deterministic_scores(spark, sf)
    return s.select(F.col("ua_bot_flag").alias("y_true"), F.col("is_anomaly").alias("y_pred"),
                    (-F.col("anomaly_score")).alias("score"))


@query("confusion_matrix")
def _confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_ev(spark, sf))


@query("classification_report")
def _classification_report(spark, sf):
    return finish(evaluate.classification_report(_ev(spark, sf)))


@query("roc_auc")
def _roc_auc(spark, sf):
    return finish(evaluate.roc_auc(_ranked(spark, sf)))


@query("roc_curve")
def _roc_curve(spark, sf):
    return finish(evaluate.roc_curve(_ranked(spark, sf)))


@query("roc_curve_corners")
def _roc_curve_corners(spark, sf):
    return finish(evaluate.roc_curve_corners(_ranked(spark, sf)))


@query("label_balance")
def _label_balance(spark, sf):
    return evaluate.label_balance(features.ip_features_v2(stored(spark, sf)))


@query("scaled_features")
def _scaled_features(spark, sf):
    f = features.ip_features_v2(stored(spark, sf))
    return finish(scaling.standardize(f, features.V2_FEATURES).select("ip", *features.V2_FEATURES))


def _det_sweep(spark, sf) -> DataFrame:
    det = unlabelled_scores(stored(spark, sf))
    return evaluate.contamination_sweep(det, "anomaly_score", "ua_bot_flag", LEVELS, cut_digits=6)


@query("contamination_cut")
def _contamination_cut(spark, sf):
    det = unlabelled_scores(stored(spark, sf))
    return finish(evaluate.contamination_cuts(det, "anomaly_score", LEVELS, cut_digits=6))


_SWEEP_COLS = ("contamination", "precision", "recall", "f1", "auc")


@query("contamination_sweep")
def _contamination_sweep(spark, sf):
    return finish(_det_sweep(spark, sf).select(*_SWEEP_COLS))


@query("best_contamination")
def _best_contamination(spark, sf):
    return finish(evaluate.best_contamination(_det_sweep(spark, sf)).select(*_SWEEP_COLS))


# --- sources and sinks ------------------------------------------------------------


@query("scan_raw_log")
def _scan_raw_log(spark, sf):
    """Derived lines written as a text file in the shared folder, then
    scanned back with the raw-log reader."""
    path = scratch_path(spark, "rawlog")
    lines(spark, sf).write.mode("overwrite").text(path)
    return sources.read_log_text(spark, path)


@query("sink_parsed_log")
def _sink_parsed_log(spark, sf):
    """Request table written as date-partitioned Parquet, read back."""
    path = scratch_path(spark, "parsed")
    sources.write_parsed_log(requests(spark, sf), path)
    return finish(sources.read_parsed_log(spark, path))


@query("sink_parsed_log_csv")
def _sink_parsed_log_csv(spark, sf):
    """Request table through the CSV exchange format and back: missing-value
    tokens become null on the way, as in the reference's script chain."""
    path = scratch_path(spark, "parsed-csv")
    sources.write_parsed_log_csv(requests(spark, sf), path)
    return finish(sources.read_parsed_log_csv(spark, path))


@query("scan_parsed_log")
def _scan_parsed_log(spark, sf):
    """Typed scan of a stored request table, as features and marts read it."""
    path = scratch_path(spark, "parsed")
    sources.write_parsed_log(requests(spark, sf), path)
    return finish(parse.with_null_tokens(sources.read_parsed_log(spark, path)))


# --- models (rows-only checks; properties are covered by tests) --------------------


def _features(spark, sf):
    return jobs.feature_table(stored(spark, sf))


def _iforest(spark, sf):
    return jobs.anomaly_job(_features(spark, sf))


@query("iforest_fit")
def _iforest_fit(spark, sf):
    return _iforest(spark, sf).model.node_table(spark)


@query("iforest_sample")
def _iforest_sample(spark, sf):
    """The rows that each tree of the forest is grown on."""
    return iforest.bottom_k(_features(spark, sf), "ip", [], n_trees=100, k=IFOREST_SAMPLE, seed=42).select("tree", "ip")


@query("iforest_scores")
def _iforest_scores(spark, sf):
    s = _iforest(spark, sf).scores
    return s.select("ip", "score_samples", "anomaly_score")


@query("iforest_labels")
def _iforest_labels(spark, sf):
    s = _iforest(spark, sf).scores
    return s.select("ip", "ua_bot_flag", "anomaly_score", "is_anomaly")


@query("iforest_sweep")
def _iforest_sweep(spark, sf):
    return _iforest(spark, sf).sweep.select(*_SWEEP_COLS)


@query("stratified_split")
def _stratified_split(spark, sf):
    return forest.stratified_split(_features(spark, sf)).select("ip", "ua_bot_flag", "is_test")


@query("stratified_split_threshold")
def _stratified_split_threshold(spark, sf):
    """The split by hash thresholds, a third of the bots and a fifth of the others."""
    f = _features(spark, sf)
    return forest.threshold_split(f, test_fraction={1: 1 / 3, 0: 0.2}).select("ip", "ua_bot_flag", "is_test")


def _supervised(spark, sf):
    return jobs.supervised_job(_features(spark, sf))


@query("rf_fit")
def _rf_fit(spark, sf):
    return _supervised(spark, sf).test_metrics


@query("rf_predictions")
def _rf_predictions(spark, sf):
    return _supervised(spark, sf).predictions.select("ip", "ua_bot_flag", "bot_probability", "predicted_bot")


@query("feature_importance")
def _feature_importance(spark, sf):
    return forest.top_importances(_supervised(spark, sf).importances)


@query("sink_scores")
def _sink_scores(spark, sf):
    """Score table written as Parquet and read back."""
    path, scores = scratch_path(spark, "scores"), deterministic_scores(spark, sf).select(*_SUS_COLS)
    sources.write_scores(scores, path)
    return finish(sources.read_scores(spark, path, schema=scores.schema))


@query("scan_scores")
def _scan_scores(spark, sf):
    """Score table through CSV and back with its schema."""
    path, scores = scratch_path(spark, "scores"), deterministic_scores(spark, sf).select(*_SUS_COLS)
    sources.write_scores(scores, path, fmt="csv")
    return finish(sources.read_scores(spark, path, fmt="csv", schema=scores.schema))


@query("traffic_over_time_stream")
def _traffic_over_time_stream(spark, sf):
    """The streaming job over the derived log landed as text files: one
    incremental run (all available files, then the watermark-advancing
    batch) with a 30-minute watermark. Emitted are the 10-minute bins whose
    end is at or below the watermark (latest event time - 30 minutes)."""
    src = scratch_path(spark, "stream-src")
    lines(spark, sf).write.text(src)
    sink = scratch_path(spark, "stream-sink")
    q = start_traffic_stream(spark, src, sink, scratch_path(spark, "stream-ckpt"), watermark="30 minutes")
    q.awaitTermination()
    return finish(spark.read.parquet(sink).select("time_bin", "requests"))


def _landed(spark, sf) -> str:
    """The derived log as text files of a folder."""
    src = scratch_path(spark, "stream-src")
    lines(spark, sf).write.text(src)
    return src


@query("stream_ingest")
def _stream_ingest(spark, sf):
    """The derived log through the ingest stream, several batches, read back from the store."""
    src, store = _landed(spark, sf), scratch_path(spark, "stream-store")
    start_ingest_stream(spark, src, store, scratch_path(spark, "stream-ckpt"), max_files_per_trigger=4).awaitTermination()
    return finish(sources.read_parsed_log(spark, store))


@query("stream_flags")
def _stream_flags(spark, sf):
    """Requests flagged as they arrive, by a stored score table."""
    scores, store = scratch_path(spark, "scores"), scratch_path(spark, "flag-store")
    unlabelled_scores(stored(spark, sf)).write.parquet(scores)
    start_flag_stream(spark, _landed(spark, sf), scores, store, scratch_path(spark, "stream-ckpt")).awaitTermination()
    r = spark.read.parquet(store)
    return finish(r.select("ip", "timestamp", "path", F.col("is_suspicious").cast("int").alias("is_suspicious")))


@query("sessions_stream")
def _sessions_stream(spark, sf):
    """Sessions of the streamed log that the watermark has closed."""
    sink = scratch_path(spark, "session-sink")
    start_session_stream(spark, _landed(spark, sf), sink).awaitTermination()
    return finish(spark.read.parquet(sink).select("ip", "first_request", "last_request", "requests"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Access log -> requests -> per-IP features -> isolation forest (best
    contamination by F1 against the user-agent flag) -> the 20 most
    anomalous addresses."""
    ensure_utc(spark)
    return marts.top_anomalies(jobs.anomaly_job(_features(spark, sf)).scores)


@query("top_suspicious_ips")
def _top_suspicious_ips(spark, sf):
    return flagship(spark, sf)


@query("iforest_v1_scores")
def _iforest_v1_scores(spark, sf):
    """The first detector: v1 features, forest at contamination 0.05."""
    f = jobs.feature_table(stored(spark, sf), version=1)
    return jobs.anomaly_job_v1(f).select("ip", "ua_bot_flag", "anomaly_score", "is_anomaly")


@query("iforest_v1_report")
def _iforest_v1_report(spark, sf):
    """Classification report of the first detector against the UA flag."""
    f = jobs.feature_table(stored(spark, sf), version=1)
    s = jobs.anomaly_job_v1(f)
    ev = s.select(F.col("ua_bot_flag").alias("y_true"), F.col("is_anomaly").alias("y_pred"),
                  (-F.col("anomaly_score")).alias("score"))
    return evaluate.classification_report(ev)


@query("rf_test_report")
def _rf_test_report(spark, sf):
    return _supervised(spark, sf).test_report


@query("rf_test_confusion")
def _rf_test_confusion(spark, sf):
    return _supervised(spark, sf).test_confusion


@query("rf_roc_curve")
def _rf_roc_curve(spark, sf):
    return evaluate.roc_curve(_supervised(spark, sf).test_evaluation)


@query("iforest_confusion")
def _iforest_confusion(spark, sf):
    """Confusion matrix of the second detector at its best level."""
    return evaluate.confusion_matrix(jobs.evaluation_input(_iforest(spark, sf).scores))


@query("iforest_roc_curve")
def _iforest_roc_curve(spark, sf):
    return evaluate.roc_curve(jobs.evaluation_input(_iforest(spark, sf).scores))


@query("iforest_v1_evaluation")
def _iforest_v1_evaluation(spark, sf):
    """Confusion matrix, AUC and flagged share of the first detector's top 20, in one row."""
    s = jobs.anomaly_job_v1(jobs.feature_table(stored(spark, sf), version=1))
    return jobs.detector_evaluation(s)


@query("hybrid_detection")
def _hybrid_detection(spark, sf):
    """Rule hits, and a forest fitted on the addresses no rule flags."""
    return jobs.hybrid_job(_features(spark, sf)).select("ip", "ua_bot_flag", "anomaly_score", "is_bot", "detected_by")


@query("rf_cross_validation")
def _rf_cross_validation(spark, sf):
    return jobs.cross_validate(_features(spark, sf))


@query("hybrid_rule_hits")
def _hybrid_rule_hits(spark, sf):
    """The rule part of the hybrid detection: what the forest is not asked about."""
    return jobs.rule_hits(_features(spark, sf)).select("ip", "ua_bot_flag", "anomaly_score", "is_bot", "detected_by")


@query("cross_validation_folds")
def _cross_validation_folds(spark, sf):
    """The fold of every address."""
    return jobs.with_folds(_features(spark, sf)).select("ip", F.col("_fold").alias("fold"))
