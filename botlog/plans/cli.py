"""Command-line jobs (``python -m botlog.plans.cli <command> ...``).

  ingest      raw log text -> date-partitioned Parquet request table, and
              with --summary the counts of parsed, rejected and
              suspicious-agent lines
  reports     rule-based reports (top IPs, repeated paths, error IPs,
              suspicious user agents) -> one Parquet table each
  detect      request table -> per-IP features -> isolation forest
              (v1: six features at one contamination; v2: thirteen
              features, best of the contamination sweep) -> score table,
              evaluation against the user-agent flag and ROC curve
  marts       request table and score table -> the dashboard's tables
  supervised  request table -> random forest -> predictions, test metrics,
              importances

Paths may be any Hadoop-supported URI. The session comes from
``spark-submit`` / the environment; the checkpoint folder is taken from
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from botlog.operators import evaluate, reports
from botlog.plans import jobs
from botlog.session import ensure_utc
from botlog.sources import read_log_text, read_parsed_log, read_scores, write_scores


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("botlog").getOrCreate()
    ensure_utc(spark)
    return spark


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="botlog")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("log")
    p.add_argument("out")
    p.add_argument("--summary")
    p = sub.add_parser("marts")
    p.add_argument("requests")
    p.add_argument("scores")
    p.add_argument("out")
    p = sub.add_parser("reports")
    p.add_argument("requests")
    p.add_argument("out")
    p = sub.add_parser("detect")
    p.add_argument("requests")
    p.add_argument("out")
    p.add_argument("--version", type=int, choices=(1, 2), default=2)
    p.add_argument("--contamination", type=float, default=0.05)
    p = sub.add_parser("supervised")
    p.add_argument("requests")
    p.add_argument("out")
    a = ap.parse_args(argv)

    spark = _spark()
    if a.cmd == "ingest":
        jobs.ingest(read_log_text(spark, a.log), a.out)
        if a.summary:
            reports.parse_summary(read_log_text(spark, a.log)).write.mode("overwrite").parquet(a.summary)
        return
    req = read_parsed_log(spark, a.requests)
    if a.cmd == "reports":
        for name, df in (("top_ips", reports.top_ips(req)), ("top_repeated_paths", reports.top_repeated_paths(req)),
                         ("top_error_ips", reports.top_error_ips(req)),
                         ("suspicious_ua_sample", reports.suspicious_ua_sample(req))):
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.cmd == "detect":
        feats = jobs.feature_table(req, version=a.version)
        if a.version == 1:
            scores = jobs.anomaly_job_v1(feats, a.contamination)
        else:
            res = jobs.anomaly_job(feats)
            scores = res.scores
            res.sweep.write.mode("overwrite").parquet(f"{a.out}/sweep")
        write_scores(scores, f"{a.out}/scores")
        jobs.detector_evaluation(scores).write.mode("overwrite").parquet(f"{a.out}/evaluation")
        evaluate.roc_curve(jobs.evaluation_input(scores)).write.mode("overwrite").parquet(f"{a.out}/roc_curve")
    elif a.cmd == "marts":
        for name, df in jobs.mart_tables(req, read_scores(spark, a.scores)).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.cmd == "supervised":
        res = jobs.supervised_job(jobs.feature_table(req))
        write_scores(res.predictions, f"{a.out}/predictions")
        res.test_metrics.write.mode("overwrite").parquet(f"{a.out}/test_metrics")
        res.test_report.write.mode("overwrite").parquet(f"{a.out}/test_report")
        evaluate.roc_curve(res.test_evaluation).write.mode("overwrite").parquet(f"{a.out}/roc_curve")
        res.importances.write.mode("overwrite").parquet(f"{a.out}/importances")


if __name__ == "__main__":
    main()
