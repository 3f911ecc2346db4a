"""Investigation marts over the request table and a score table.

The score table has exactly one row per address with at least ``ip``,
``total_requests``, ``anomaly_score`` (lower = more anomalous) and
``is_anomaly``. The suspicious set is the score table after the global
filters (minimum requests, score threshold, optional anomaly flag).

Request-level marts pre-aggregate the requests by (ip, key) before they
meet the suspicious set, so the join sees one row per (address, bin / agent
/ path) rather than one per request, and partial aggregation absorbs hot
addresses. The join carries no broadcast hint: the suspicious set can be
large, and adaptive execution broadcasts it only when its measured size is
under the threshold (otherwise it shuffles, splitting skewed partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlog.functions import traits

DRILLDOWN_CANDIDATES = 50


def suspicious_ips(scores: DataFrame, min_requests: int = 10, threshold: float = 0.0,
                   only_anomalies: bool = False) -> DataFrame:
    """Filtered score table, most anomalous first."""
    s = scores.filter((F.col("total_requests") >= min_requests) & (F.col("anomaly_score") <= threshold))
    if only_anomalies:
        s = s.filter(F.col("is_anomaly") == 1)
    return s.orderBy(F.col("anomaly_score").asc(), F.col("ip").asc())


def drilldown_candidates(suspicious: DataFrame, n: int = DRILLDOWN_CANDIDATES) -> DataFrame:
    return suspicious.orderBy(F.col("anomaly_score").asc(), F.col("ip").asc()).limit(n)


def _flagged(sus: DataFrame) -> DataFrame:
    # The suspicious set is a filtered score table: one row per address. No
    # dedup aggregate here, so the join's inputs are plain shuffles and
    # adaptive execution can split a hot address's partition on the request
    # side.
    return sus.select("ip", F.lit(True).alias("_sus"))


def suspicious_requests(requests: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Requests made by suspicious addresses (left semi join)."""
    return requests.join(suspicious.select("ip"), "ip", "left_semi")


def request_suspicious_flag(requests: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Every request with ``is_suspicious``."""
    j = requests.join(_flagged(suspicious), "ip", "left")
    return j.withColumn("is_suspicious", F.coalesce(F.col("_sus"), F.lit(False))).drop("_sus")


def _counts_by(requests: DataFrame, suspicious: DataFrame, key: str, key_expr) -> DataFrame:
    per_ip = requests.groupBy("ip", key_expr.alias(key)).agg(F.count(F.lit(1)).alias("_c"))
    j = per_ip.join(_flagged(suspicious), "ip", "left")
    return j.groupBy(key).agg(F.sum("_c").alias("total_requests"),
                              F.coalesce(F.sum(F.when(F.col("_sus"), F.col("_c"))), F.lit(0)).alias("suspicious_requests"))


def traffic_over_time(requests: DataFrame, suspicious: DataFrame,
                      width_seconds: int = traits.TIME_BIN_SECONDS, local: bool = False) -> DataFrame:
    """(time_bin, total_requests, suspicious_requests) per non-empty bin; with
    ``local`` bins start on the wall clock of each request's own offset."""
    ts = F.col("timestamp")
    start = traits.local_time_bin(ts, F.col("tz_offset"), width_seconds) if local else traits.time_bin(ts, width_seconds)
    t = _counts_by(requests, suspicious, "time_bin", start)
    return t.filter(F.col("time_bin").isNotNull())


def overview_metrics(requests: DataFrame, scores: DataFrame, suspicious: DataFrame) -> DataFrame:
    """One row: total_requests, total_ips (of the unfiltered score table),
    suspicious_ips, suspicious_requests, suspicious_traffic_pct.

    The three sources are reduced to one-row partials, stacked with a union
    and summed, so no join is needed."""
    per_ip = requests.groupBy("ip").agg(F.count(F.lit(1)).alias("_c"))
    j = per_ip.join(_flagged(suspicious), "ip", "left")
    zero = F.lit(0).cast("long")
    req = j.agg(F.coalesce(F.sum("_c"), zero).alias("total_requests"),
                F.coalesce(F.sum(F.when(F.col("_sus"), F.col("_c"))), zero).alias("suspicious_requests"),
                zero.alias("total_ips"), zero.alias("suspicious_ips"))
    ips = scores.agg(zero.alias("total_requests"), zero.alias("suspicious_requests"),
                     F.count_distinct("ip").alias("total_ips"), zero.alias("suspicious_ips"))
    sus = suspicious.agg(zero.alias("total_requests"), zero.alias("suspicious_requests"),
                         zero.alias("total_ips"), F.count(F.lit(1)).alias("suspicious_ips"))
    out = req.unionByName(ips).unionByName(sus).agg(
        *[F.sum(c).alias(c) for c in ("total_requests", "total_ips", "suspicious_ips", "suspicious_requests")])
    pct = F.coalesce(F.try_divide(F.col("suspicious_requests").cast("double"),
                                  F.col("total_requests").cast("double")) * 100, F.lit(0.0))
    return out.select("total_requests", "total_ips", "suspicious_ips", "suspicious_requests",
                      pct.alias("suspicious_traffic_pct"))


def ip_drilldown_timeline(requests: DataFrame, ip: str,
                          width_seconds: int = traits.TIME_BIN_SECONDS) -> DataFrame:
    """Requests of one address per bin, empty bins between its first and last
    bin included as 0."""
    r = requests.filter((F.col("ip") == ip) & F.col("timestamp").isNotNull())
    b = r.select(traits.time_bin(F.col("timestamp"), width_seconds).alias("time_bin"))
    counts = b.groupBy("time_bin").agg(F.count(F.lit(1)).alias("requests"))
    # One row per day first: a stray year makes many days, not one huge array.
    width = F.expr(f"INTERVAL {width_seconds} SECONDS")
    span = counts.agg(F.min("time_bin").alias("lo"), F.max("time_bin").alias("hi"))
    days = span.filter(F.col("lo").isNotNull()).select("lo", "hi", F.explode(F.sequence(
        F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    grid = (days.repartition("day").select("lo", "hi", F.explode(F.sequence(
        F.col("day"), F.col("day") + F.expr("INTERVAL 1 DAY") - width, width)).alias("time_bin"))
        .filter((F.col("time_bin") >= F.col("lo")) & (F.col("time_bin") <= F.col("hi"))).select("time_bin"))
    return (grid.join(counts, "time_bin", "left")
            .select("time_bin", F.coalesce(F.col("requests"), F.lit(0)).alias("requests")))


def ip_drilldown_paths(requests: DataFrame, ip: str, n: int = 10) -> DataFrame:
    return (requests.filter((F.col("ip") == ip) & F.col("path").isNotNull())
            .groupBy("path").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("path")).limit(n))


def ua_stats(requests: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Per user agent (null agents dropped): total_requests (requests with a
    known address; 0 for an agent seen only without one), ua_category,
    requests_from_anomalous_ips."""
    r = requests.filter(F.col("user_agent").isNotNull())
    per_ip = r.groupBy("ip", "user_agent").agg(F.count("ip").alias("_c"))
    j = per_ip.join(_flagged(suspicious), "ip", "left")
    t = j.groupBy("user_agent").agg(F.sum("_c").alias("total_requests"), F.coalesce(
        F.sum(F.when(F.col("_sus"), F.col("_c"))), F.lit(0)).alias("suspicious_requests"))
    return t.select("user_agent", "total_requests", traits.ua_category(F.col("user_agent")).alias("ua_category"),
                    F.col("suspicious_requests").alias("requests_from_anomalous_ips"))


def top_user_agents(stats: DataFrame, n: int = 20) -> DataFrame:
    return stats.orderBy(F.col("total_requests").desc(), F.col("user_agent")).limit(n)


def ua_category_counts(requests: DataFrame) -> DataFrame:
    """Requests per user-agent category, Unknown included."""
    return (requests.groupBy(traits.ua_category(F.col("user_agent")).alias("ua_category"))
            .agg(F.count(F.lit(1)).alias("count")))


def path_abuse(requests: DataFrame, suspicious: DataFrame, n: int | None = 20) -> DataFrame:
    """Per path (nulls dropped): requests from suspicious addresses and the
    number of distinct suspicious addresses; top ``n`` by requests."""
    per_ip = (requests.filter(F.col("path").isNotNull())
              .groupBy("ip", "path").agg(F.count(F.lit(1)).alias("_c")))
    j = per_ip.join(suspicious.select("ip"), "ip", "left_semi")
    out = j.groupBy("path").agg(F.sum("_c").alias("total_requests_from_suspicious_ips"),
                                F.count(F.lit(1)).alias("number_of_unique_suspicious_ips"))
    out = out.orderBy(F.col("total_requests_from_suspicious_ips").desc(), F.col("path"))
    return out.limit(n) if n else out


def score_range(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min("anomaly_score").alias("min_score"), F.max("anomaly_score").alias("max_score"))


TOP_ANOMALY_COLUMNS = ("ip", "total_requests", "max_requests_per_minute", "repeated_path_ratio",
                       "ua_bot_flag", "anomaly_score", "is_anomaly")


def top_anomalies(scores: DataFrame, n: int = 20) -> DataFrame:
    return (scores.orderBy(F.col("anomaly_score").asc(), F.col("ip").asc()).limit(n)
            .select(*TOP_ANOMALY_COLUMNS))


def top20_flagged_count(scores: DataFrame, n: int = 20) -> DataFrame:
    """How many of the ``n`` most anomalous addresses carry the bot flag."""
    return top_anomalies(scores, n).agg(F.count_if(F.col("ua_bot_flag") == 1).alias("flagged"))
