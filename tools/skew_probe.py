"""Skew probe: how much of a shuffle lands in one task when one address
owns a third of all requests.

The request table is the sf access log (derived from ``events``) replicated
``--copies`` times (each copy shifted by a day), with every third request
re-assigned to one hot address, stored as Parquet in a scratch folder. The
per-IP feature plan and, for contrast, a naive ``lag`` over
``partitionBy(ip)`` run with the event log on; for every shuffle-reading
stage the largest task's shuffle records are reported, also as a share of
all requests.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _stage_shares(log_dir: str, job_group: str, n_rows: int) -> list[dict]:
    files = glob.glob(f"{log_dir}/*/events*")
    with open(files[0], "rb") as fh:
        text = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True).read().decode()
    jobs, stage_job, tasks = {}, {}, {}
    for line in text.splitlines():
        try:
            e = json.loads(line)
        except ValueError:
            continue
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            grp = (e.get("Properties") or {}).get("spark.jobGroup.id")
            jobs[e["Job ID"]] = grp
            for sid in e["Stage IDs"]:
                stage_job[sid] = grp
        elif ev == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            rec = e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
            tasks.setdefault(e["Stage ID"], []).append(rec)
    out = []
    for sid, recs in sorted(tasks.items()):
        total = sum(recs)
        if stage_job.get(sid) == job_group and total > 0:
            out.append({"stage": sid, "tasks": len(recs), "records": total, "max_task_records": max(recs),
                        "max_task_share_of_rows": round(max(recs) / n_rows, 3)})
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=20)
    a = ap.parse_args()
    scratch = tempfile.mkdtemp(prefix="botlog-skew-")
    logs = os.path.join(scratch, "events")
    os.makedirs(logs)
    spark = (SparkSession.builder.master("local[8]").appName("skew-probe")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
             .config("spark.sql.shuffle.partitions", "32").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    from botlog.operators import features, parse
    from botlog.plans import catalog

    req = catalog.requests(spark, a.sf)
    big = (req.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(a.copies - 1))))
           .withColumn("timestamp", F.timestamp_seconds(F.unix_seconds("timestamp") + F.col("_copy") * 86400))
           .withColumn("ip", F.when(F.xxhash64("ip", "timestamp", "path", "_copy") % 3 == 0, F.lit("10.9.9.9"))
                       .otherwise(F.col("ip")))
           .drop("_copy"))
    path = os.path.join(scratch, "requests")
    big.write.parquet(path)
    stored = parse.with_null_tokens(spark.read.parquet(path))
    n = stored.count()
    hot = stored.filter(F.col("ip") == "10.9.9.9").count()

    sc = spark.sparkContext
    sc.setJobGroup("features", "features")
    features.ip_features_v2(stored).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("naive", "naive")
    (stored.withColumn("prev", F.lag("timestamp").over(Window.partitionBy("ip").orderBy("timestamp")))
     .groupBy("ip").agg(F.avg(F.unix_seconds("timestamp") - F.unix_seconds("prev")))
     .write.format("noop").mode("overwrite").save())
    # request-level join with a suspicious set too large to broadcast: the
    # shuffle join relies on adaptive skew splitting (thresholds scaled down
    # to this data size; the defaults apply at cluster scale)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    from botlog.operators import marts
    # a score table: one row per address, checkpointed as the jobs do
    sus = stored.select("ip").distinct().withColumn("total_requests", F.lit(100).cast("long")) \
        .withColumn("anomaly_score", F.lit(-1.0)).withColumn("is_anomaly", F.lit(1)).checkpoint(eager=True)
    sc.setJobGroup("flag_join", "flag_join")
    marts.request_suspicious_flag(stored, marts.suspicious_ips(sus)).write.format("noop").mode("overwrite").save()
    spark.stop()
    feat, naive = _stage_shares(logs, "features", n), _stage_shares(logs, "naive", n)
    join = _stage_shares(logs, "flag_join", n)
    print(json.dumps({"rows": n, "hot_share": round(hot / n, 3),
                      "features_max_task_share_of_rows": max(s["max_task_share_of_rows"] for s in feat),
                      "naive_window_max_task_share_of_rows": max(s["max_task_share_of_rows"] for s in naive),
                      "flag_join_max_task_share_of_rows": max(s["max_task_share_of_rows"] for s in join),
                      "flag_join_stages": join,
                      "features_stages": feat, "naive_stages": naive}, indent=1))


if __name__ == "__main__":
    main()
