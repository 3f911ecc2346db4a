"""Streams that write by batch: request ingest, flagged requests, sessions.

The file source gives each micro-batch a number and, from its checkpoint, the
same files again when that batch is repeated after a failure. Writers here put
a batch into partitions of its own (``date=.../batch=...``) and overwrite
exactly these, so a repeated batch replaces what its first attempt left: every
line is in the store once, whenever the driver or an executor was lost.

Sessions are closed under a watermark: state is one row for each open session
(address, first and last second, count), merged by Spark's session windows;
requests older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from botlog.operators import marts, parse
from botlog.operators.daily import FeatureStates
from botlog.operators.features import SESSION_GAP_SECONDS
from botlog.session import ensure_utc, scratch_path
from botlog.streaming.traffic import log_stream


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Puts a batch of requests into its own partitions, replacing them."""
    (rows.withColumn("date", F.to_date("timestamp")).withColumn("batch", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path))


def start_ingest_stream(spark: SparkSession, directory: str, store: str, checkpoint: str, states: FeatureStates | None = None,
                        available_now: bool = True, max_files_per_trigger: int | None = None,
                        on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Log files arriving in ``directory`` -> the date-partitioned request
    store, which :func:`botlog.sources.read_parsed_log` reads. With ``states``
    the daily feature states of the days in a batch are brought up to date, each from
    its own partition. ``on_batch`` is called when a batch is written."""
    ensure_utc(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_batch(batch, batch_id, store)
            if states is not None:  # one date for each day in the batch
                for r in batch.select(F.to_date("timestamp").alias("d")).distinct().collect():
                    states.update_day(store, r["d"])
            if on_batch:
                on_batch(batch_id)
        finally:
            batch.unpersist()

    return _run(log_stream(spark, directory, max_files_per_trigger), write, checkpoint, available_now)


def start_flag_stream(spark: SparkSession, directory: str, scores_path: str, store: str, checkpoint: str,
                      min_requests: int = 10, threshold: float = 0.0, only_anomalies: bool = False, available_now: bool = True,
                      max_files_per_trigger: int | None = None, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Arriving requests with ``is_suspicious``, by the score table at
    ``scores_path`` as it is when the batch starts: the table is listed and read
    again for each batch, so flags follow a table that was replaced."""
    ensure_utc(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        suspicious = marts.suspicious_ips(spark.read.parquet(scores_path), min_requests, threshold, only_anomalies)
        write_batch(marts.request_suspicious_flag(parse.with_null_tokens(batch), suspicious.select("ip")), batch_id, store)
        if on_batch:
            on_batch(batch_id)

    return _run(log_stream(spark, directory, max_files_per_trigger), write, checkpoint, available_now)


def sessions(requests: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, watermark: str = "30 minutes") -> DataFrame:
    """(ip, first_request, last_request, requests) of a stream's sessions, once
    closed: no request within ``gap_seconds`` of the last one, as in
    :func:`botlog.operators.features.session_depth`."""
    r = parse.with_null_tokens(requests).filter(F.col("ip").isNotNull() & F.col("timestamp").isNotNull())
    # Spark's session windows merge where one starts at the very end of another: a gap of gap_seconds stays inside
    s = (r.withWatermark("timestamp", watermark)
         .groupBy("ip", F.session_window("timestamp", f"{gap_seconds} seconds").alias("s")).agg(F.count(F.lit(1)).alias("requests")))
    return s.select("ip", F.col("s.start").alias("first_request"),
                    (F.col("s.end") - F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("last_request"), "requests")


def start_session_stream(spark: SparkSession, directory: str, sink_path: str | None = None, checkpoint: str | None = None,
                         gap_seconds: int = SESSION_GAP_SECONDS, watermark: str = "30 minutes", available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Closed sessions of the log files in ``directory``, appended as Parquet."""
    ensure_utc(spark)
    out = sessions(log_stream(spark, directory, max_files_per_trigger), gap_seconds, watermark)
    w = (out.writeStream.format("parquet").outputMode("append").option("path", sink_path or scratch_path(spark, "session-stream"))
         .option("checkpointLocation", checkpoint or scratch_path(spark, "session-stream-ckpt")))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
