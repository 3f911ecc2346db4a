"""Per-request traits and per-IP behaviour features.

Scale design
------------
A single scraper can own a third of all rows, so no step may pull all rows
of one address into one task. Every per-IP feature is therefore computed
from partial aggregates whose keys include more than the address:

* chain P  (ip, path) -> ip : request count, status-class counts, login/API
  count, bot-UA flag, distinct paths and the path-frequency entropy
  H = ln n - sum(c ln c) / n.  Map-side partial aggregation collapses a hot
  address to one row per (task, path) before each shuffle.
* chain T  (ip, minute) -> ip : requests per minute (mean over non-empty
  minutes, max) and inter-arrival intervals. Each (ip, minute) group keeps
  its distinct seconds as a 60-bit mask (a fixed-width hash-aggregate
  buffer), so within-minute gaps are computed locally; the gaps between
  minutes come from a ``lag`` over the per-minute rows of an address, which
  holds at most one row per minute of the log's time span whatever the
  request volume. Mean and sample standard
  deviation of the intervals then follow from exact integer sums:
  n - 1 intervals, sum d = last - first, sum d^2 from the gaps (ties give
  zero-length intervals).

The two chains meet in one join on ``ip`` whose sides are both already
hash-partitioned by ``ip``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botlog.functions import traits

V1_FEATURES = ("total_requests", "unique_paths", "repeated_path_ratio",
               "avg_requests_per_minute", "max_requests_per_minute", "error_rate_4xx")
V2_FEATURES = ("total_requests", "unique_paths", "repeated_path_ratio",
               "avg_requests_per_minute", "max_requests_per_minute",
               "error_rate_4xx", "rate_5xx", "rate_3xx",
               "mean_interval_sec", "std_interval_sec", "burstiness",
               "path_entropy", "login_api_ratio")

_BURST_EPS = 1e-6


# --------------------------------------------------------------------------
# Row-level traits
# --------------------------------------------------------------------------

def with_minute(requests: DataFrame) -> DataFrame:
    return requests.withColumn("minute", traits.minute_bucket(F.col("timestamp")))


def with_status_flags(requests: DataFrame) -> DataFrame:
    s = F.col("status")
    return requests.withColumns({"is_4xx": traits.is_4xx(s), "is_5xx": traits.is_5xx(s),
                                 "is_3xx": traits.is_3xx(s)})


def with_ua_bot_flag(requests: DataFrame) -> DataFrame:
    return requests.withColumn("ua_bot_flag", traits.ua_bot_flag(F.col("user_agent")))


def with_login_api_flag(requests: DataFrame) -> DataFrame:
    return requests.withColumn("is_login_api", traits.login_api_flag(F.col("path")))


def with_time_bin(requests: DataFrame, width_seconds: int = traits.TIME_BIN_SECONDS) -> DataFrame:
    return requests.withColumn("time_bin", traits.time_bin(F.col("timestamp"), width_seconds))


def with_ua_category(requests: DataFrame) -> DataFrame:
    return requests.withColumn("ua_category", traits.ua_category(F.col("user_agent")))


def request_traits(requests: DataFrame) -> DataFrame:
    """What the aggregates need of every request with an address."""
    s, p = F.col("status"), F.col("path")
    return requests.filter(F.col("ip").isNotNull()).select(
        "ip",
        p.alias("path"),
        F.unix_seconds(F.col("timestamp")).alias("ts"),
        traits.is_4xx(s).cast("long").alias("n4"),
        traits.is_5xx(s).cast("long").alias("n5"),
        traits.is_3xx(s).cast("long").alias("n3"),
        traits.login_api_flag(p).cast("long").alias("nl"),
        traits.ua_bot_flag(F.col("user_agent")).alias("ua"),
    )


# --------------------------------------------------------------------------
# Chain T: (ip, minute) -> ip
# --------------------------------------------------------------------------

def requests_per_minute(requests: DataFrame) -> DataFrame:
    """(ip, minute, req_count); requests without a time stamp are left out."""
    return (requests.filter(F.col("ip").isNotNull() & F.col("timestamp").isNotNull())
            .groupBy("ip", traits.minute_bucket(F.col("timestamp")).alias("minute"))
            .agg(F.count(F.lit(1)).alias("req_count")))


def minute_masks(t: DataFrame, by=("ip", "minute"), with_seconds: bool = True) -> DataFrame:
    """(ip, minute, c, mask) from traits rows: requests of an address in a
    minute and its distinct seconds as a 60-bit mask built with ``bit_or``, a
    fixed-width buffer, so the partial aggregation over the raw rows is a plain
    codegen'd hash aggregate. Counts add and masks unite, so these rows merge
    under any split of the requests."""
    t = t.filter(F.col("ts").isNotNull()).withColumn("minute", F.col("ts") - F.pmod(F.col("ts"), F.lit(60)))
    aggs = [F.count(F.lit(1)).alias("c")]
    if with_seconds:
        aggs.append(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(ts - minute AS INT))")).alias("mask"))
    return t.groupBy(*by).agg(*aggs)


def minute_runs(g: DataFrame, *keep: str) -> DataFrame:
    """(ip, ``keep``, minute, c, first, last, sq) of :func:`minute_masks` rows: the first
    and last second used and the sum of squared gaps between consecutive
    distinct seconds inside the minute."""
    mask = F.col("mask")
    low = mask.bitwiseAND(-mask)                    # lowest set bit
    first_off = F.bit_count(low - 1)                # its index
    bits = F.bin(mask)                              # binary text, most significant bit first
    last_off = F.length(bits) - 1
    # zero runs between consecutive ones: each inner run of k zeros is a gap of k + 1 seconds
    runs = F.split(bits, "1")
    inner = F.slice(runs, 2, F.greatest(F.size(runs) - 2, F.lit(0)))
    sq = F.aggregate(inner, F.lit(0).cast("long"),
                     lambda acc, r: acc + (F.length(r) + 1).cast("long") * (F.length(r) + 1).cast("long"))
    return g.select("ip", *keep, "minute", "c",
                    (F.col("minute") + first_off).alias("first"),
                    (F.col("minute") + last_off).alias("last"),
                    sq.alias("sq"))


def merge_runs(runs: DataFrame, by=("ip",)) -> DataFrame:
    """One run for each ``by`` group. A run is a stretch of an address's time
    that no other run of it overlaps: ``first`` and ``last`` second, ``n_ts``
    requests in ``n_min`` minutes, ``max_rpm`` in the busiest, ``ssq`` the sum
    of squared gaps inside. Runs merge into runs (the gaps between them are
    added), so minutes, days and whole histories are merged alike."""
    w = Window.partitionBy(*by).orderBy("first")
    # Gaps of centuries fit: squares and their sum are decimals, not longs.
    gap = (F.col("first") - F.lag("last").over(w)).cast("decimal(18,0)")
    return (runs.withColumn("gap2", (gap * gap).cast("decimal(28,0)")).groupBy(*by)
            .agg(F.sum("n_ts").alias("n_ts"), F.sum("n_min").alias("n_min"), F.max("max_rpm").alias("max_rpm"),
                 F.min("first").alias("first"), F.max("last").alias("last"),
                 (F.sum(F.col("ssq").cast("decimal(28,0)")) + F.coalesce(F.sum("gap2"), F.lit(0))).cast("decimal(38,0)").alias("ssq")))


def runs_of_minutes(g: DataFrame, *keep: str) -> DataFrame:
    """The runs of :func:`minute_masks` rows, one for each minute."""
    return minute_runs(g, *keep).select("ip", *keep, "first", "last", F.col("c").alias("n_ts"), F.lit(1).cast("long").alias("n_min"),
                            F.col("c").alias("max_rpm"), F.col("sq").cast("decimal(38,0)").alias("ssq"))


def run_stats(stats: DataFrame, with_intervals: bool = True) -> DataFrame:
    """Rates and intervals of addresses from their merged runs."""
    out = [F.col("ip"),
           (F.col("n_ts") / F.col("n_min")).alias("avg_requests_per_minute"),
           F.col("max_rpm").alias("max_requests_per_minute")]
    if with_intervals:
        m = F.col("n_ts") - 1                # number of intervals
        span = F.col("last") - F.col("first")  # sum of intervals
        # m * sum(d^2) - (sum d)^2 exactly in decimal, then to double
        num = (m.cast("decimal(38,0)") * F.col("ssq")
               - span.cast("decimal(38,0)") * span.cast("decimal(38,0)")).cast("double")
        var = num / (m.cast("double") * (m - 1).cast("double"))
        out += [F.when(m >= 1, span.cast("double") / m.cast("double")).alias("mean_interval_sec"),
                F.when(m >= 2, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std_interval_sec")]
    return stats.select(*out)


def _minute_stats(t: DataFrame, with_intervals: bool) -> DataFrame:
    if with_intervals:
        return run_stats(merge_runs(runs_of_minutes(minute_masks(t))))
    g = minute_masks(t, with_seconds=False)
    return run_stats(g.groupBy("ip").agg(F.sum("c").alias("n_ts"), F.count(F.lit(1)).alias("n_min"), F.max("c").alias("max_rpm")),
                     with_intervals=False)


def ip_rpm_stats(requests: DataFrame) -> DataFrame:
    """(ip, avg_requests_per_minute, max_requests_per_minute) over the
    minutes in which the address made requests."""
    return _minute_stats(request_traits(requests), with_intervals=False)


def ip_interval_stats(requests: DataFrame) -> DataFrame:
    """(ip, mean_interval_sec, std_interval_sec); null when an address has
    fewer than two (mean) or three (sample std) time-stamped requests."""
    return _minute_stats(request_traits(requests), with_intervals=True).select(
        "ip", "mean_interval_sec", "std_interval_sec")


def ip_intervals(requests: DataFrame) -> DataFrame:
    """Per request: (ip, timestamp, prev_timestamp, interval_sec), the gap to
    the previous request of the same address in time order, in whole seconds
    like every other interval here (the log has no finer time).

    Skew-safe form of ``lag(ts) over (partition by ip order by ts)``: requests
    are first counted per (ip, second), so a flood is one row. The lag runs
    over the at most 60 seconds of an (ip, minute), the first second of a
    minute takes the last one of the address's previous non-empty minute from
    the small per-minute table, and the counts are expanded again: all but the
    first request of a second follow one of the same second."""
    ts = F.unix_seconds(F.col("timestamp"))
    per_sec = (requests.filter(F.col("ip").isNotNull() & F.col("timestamp").isNotNull())
               .groupBy("ip", ts.alias("ts")).agg(F.count(F.lit(1)).alias("c"))
               .withColumn("minute", F.col("ts") - F.pmod(F.col("ts"), F.lit(60))))
    per_min = per_sec.groupBy("ip", "minute").agg(F.max("ts").alias("last"))
    per_min = per_min.select("ip", "minute", F.lag("last").over(
        Window.partitionBy("ip").orderBy("minute")).alias("prev_minute_last"))
    inner = per_sec.withColumn("in_minute", F.lag("ts").over(Window.partitionBy("ip", "minute").orderBy("ts")))
    j = (inner.join(per_min, ["ip", "minute"], "left")
         .select("ip", "ts", F.coalesce("in_minute", "prev_minute_last").alias("before"),
                 F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("k")))
    prev = F.when(F.col("k") == 1, F.col("before")).otherwise(F.col("ts"))
    return j.select("ip", F.timestamp_seconds("ts").alias("timestamp"), F.timestamp_seconds(prev).alias("prev_timestamp"),
                    (F.col("ts") - prev).cast("double").alias("interval_sec"))


# --------------------------------------------------------------------------
# Chain P: (ip, path) -> ip
# --------------------------------------------------------------------------

def path_groups(t: DataFrame, with_v2: bool = True, by=("ip", "path")) -> DataFrame:
    """(ip, path, c, n4, ua, n5, n3, nl) from traits rows: sums and a maximum,
    which merge under any split of the requests."""
    aggs = [F.count(F.lit(1)).alias("c"), F.sum("n4").alias("n4"), F.max("ua").alias("ua")]
    if with_v2:
        aggs += [F.sum("n5").alias("n5"), F.sum("n3").alias("n3"), F.sum("nl").alias("nl")]
    return t.groupBy(*by).agg(*aggs)


def path_totals(per_path: DataFrame, with_v2: bool = True) -> DataFrame:
    """Per-address counts, rates and path entropy from one row per (ip, path)."""
    has_path = F.col("path").isNotNull()
    c = F.col("c")
    aggs2 = [F.sum(c).alias("total_requests"),
             F.count("path").alias("unique_paths"),
             F.sum("n4").alias("n4"),
             F.max("ua").alias("ua_bot_flag")]
    if with_v2:
        aggs2 += [F.sum("n5").alias("n5"), F.sum("n3").alias("n3"), F.sum("nl").alias("nl"),
                  F.sum(F.when(has_path, c)).alias("n_path"),
                  F.sum(F.when(has_path, c * F.log(c))).alias("clnc")]
    per_ip = per_path.groupBy("ip").agg(*aggs2)
    total = F.col("total_requests").cast("double")
    out = [F.col("ip"), F.col("total_requests"), F.col("unique_paths"),
           (F.col("n4") / total).alias("error_rate_4xx")]
    if with_v2:
        n = F.col("n_path").cast("double")
        out += [(F.col("n5") / total).alias("rate_5xx"), (F.col("n3") / total).alias("rate_3xx"),
                (F.col("nl") / total).alias("login_api_ratio")]
    out.append(F.col("ua_bot_flag"))
    if with_v2:
        out.append(F.coalesce(F.when(n > 0, F.log(n) - F.col("clnc") / n), F.lit(0.0)).alias("path_entropy"))
    return per_ip.select(*out)


def _path_stats(t: DataFrame, with_v2: bool) -> DataFrame:
    return path_totals(path_groups(t, with_v2), with_v2)


def ip_path_entropy(requests: DataFrame) -> DataFrame:
    """(ip, path_entropy): natural-log Shannon entropy of an address's path
    frequencies (null paths not counted; none -> 0)."""
    return _path_stats(request_traits(requests), with_v2=True).select("ip", "path_entropy")


# --------------------------------------------------------------------------
# Further behaviour measures
# --------------------------------------------------------------------------

SESSION_GAP_SECONDS = 1800


def resource_share(requests: DataFrame) -> DataFrame:
    """(ip, resource_share): share of an address's requests that load page
    resources (style sheets, scripts, images, fonts); null paths count as none."""
    return (requests.filter(F.col("ip").isNotNull()).groupBy("ip")
            .agg(F.avg(traits.is_resource(F.col("path")).cast("double")).alias("resource_share")))


def periodicity(requests: DataFrame) -> DataFrame:
    """(ip, periodicity): standard deviation of the intervals over their mean;
    near 0 for machine-like regularity, null without two intervals or when
    all requests fall in one second."""
    return ip_interval_stats(requests).select("ip", F.when(
        F.col("mean_interval_sec") > 0, F.col("std_interval_sec") / F.col("mean_interval_sec")).alias("periodicity"))


def session_depth(requests: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """(ip, sessions, avg_session_depth, max_session_depth): a session ends
    where no request follows within ``gap_seconds`` (60 at least); its depth
    is its number of requests.

    Sessions are cut on the per-minute table, one row for each address and
    minute however many requests it holds, so no address's requests meet in
    one task."""
    if gap_seconds < 60:
        raise ValueError("gap_seconds must be 60 or more: sessions are cut between minutes")
    g = minute_runs(minute_masks(request_traits(requests)))
    w = Window.partitionBy("ip").orderBy("minute")
    new = F.coalesce(F.col("first") - F.lag("last").over(w) > gap_seconds, F.lit(True))
    per = (g.withColumn("_new", new.cast("long")).withColumn("session", F.sum("_new").over(w))
           .groupBy("ip", "session").agg(F.sum("c").alias("depth")))
    return per.groupBy("ip").agg(F.count(F.lit(1)).alias("sessions"), F.avg("depth").alias("avg_session_depth"),
                                 F.max("depth").alias("max_session_depth"))


# --------------------------------------------------------------------------
# Feature tables
# --------------------------------------------------------------------------

def ip_features_v1(requests: DataFrame) -> DataFrame:
    """ip, total_requests, unique_paths, error_rate_4xx, ua_bot_flag,
    avg_requests_per_minute, max_requests_per_minute, repeated_path_ratio."""
    t = request_traits(requests)
    p = _path_stats(t, with_v2=False)
    m = _minute_stats(t, with_intervals=False)
    j = p.join(m, "ip", "left")
    return j.select(
        "ip", "total_requests", "unique_paths", "error_rate_4xx", "ua_bot_flag",
        F.coalesce(F.col("avg_requests_per_minute"), F.lit(0.0)).alias("avg_requests_per_minute"),
        F.coalesce(F.col("max_requests_per_minute"), F.lit(0).cast("long")).alias("max_requests_per_minute"),
        (1 - F.col("unique_paths") / F.col("total_requests")).alias("repeated_path_ratio"),
    )


def ip_features_v2(requests: DataFrame) -> DataFrame:
    """v1 plus rate_5xx, rate_3xx, login_api_ratio, mean_interval_sec,
    std_interval_sec, path_entropy and burstiness (missing values -> 0)."""
    t = request_traits(requests)
    return join_v2(_path_stats(t, with_v2=True), _minute_stats(t, with_intervals=True))


def join_v2(p: DataFrame, m: DataFrame) -> DataFrame:
    """The v2 feature table of :func:`path_totals` and :func:`run_stats`."""
    j = p.join(m, "ip", "left")
    z = F.lit(0.0)
    avg_rpm = F.coalesce(F.col("avg_requests_per_minute"), z)
    max_rpm = F.coalesce(F.col("max_requests_per_minute"), F.lit(0).cast("long"))
    return j.select(
        "ip", "total_requests", "unique_paths", "error_rate_4xx", "rate_5xx", "rate_3xx",
        "login_api_ratio", "ua_bot_flag",
        avg_rpm.alias("avg_requests_per_minute"),
        max_rpm.alias("max_requests_per_minute"),
        F.coalesce(F.col("mean_interval_sec"), z).alias("mean_interval_sec"),
        F.coalesce(F.col("std_interval_sec"), z).alias("std_interval_sec"),
        "path_entropy",
        (1 - F.col("unique_paths") / F.col("total_requests")).alias("repeated_path_ratio"),
        (max_rpm / (avg_rpm + F.lit(_BURST_EPS))).alias("burstiness"),
    )
