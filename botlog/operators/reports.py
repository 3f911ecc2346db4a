"""Rule-based reports on the parsed (pre-CSV) request table: top talkers,
repeated (ip, path) pairs, error-heavy addresses, suspicious user agents.

Each top-k is a grouped count followed by ``orderBy(...).limit(k)``, which
Spark plans as a partial/final hash aggregate and a TakeOrderedAndProject
(per-partition top-k, then a k-row merge), so no full sort happens. Ties are
broken by the grouping key ascending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlog.functions import logformat as lf
from botlog.functions import traits

ERROR_STATUSES = (401, 403, 404)


def top_ips(requests: DataFrame, n: int = 20) -> DataFrame:
    return (requests.groupBy("ip").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("ip").asc_nulls_last()).limit(n))


def top_repeated_paths(requests: DataFrame, n: int = 20) -> DataFrame:
    return (requests.groupBy("ip", "path").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("ip").asc_nulls_last(), F.col("path").asc_nulls_last())
            .limit(n))


def top_error_ips(requests: DataFrame, n: int = 10, statuses=ERROR_STATUSES) -> DataFrame:
    return (requests.filter(F.col("status").isin(*statuses))
            .groupBy("ip").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("ip").asc_nulls_last()).limit(n))


def suspicious_ua_requests(requests: DataFrame) -> DataFrame:
    """Requests whose user agent carries a bot keyword."""
    return requests.filter(traits.ua_bot_flag(F.col("user_agent")) == 1)


def suspicious_ua_sample(requests: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` distinct suspicious user agents, ordered by when they
    were first seen (then by text)."""
    return (suspicious_ua_requests(requests)
            .groupBy("user_agent").agg(F.min("timestamp").alias("first_seen"))
            .orderBy(F.col("first_seen").asc_nulls_last(), F.col("user_agent"))
            .limit(n))


def parse_summary(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """One row: parsed_records, rejected_lines, suspicious_ua_requests, from
    a single pass over the raw lines (one regex evaluation per line)."""
    fields = lines.select(lf.raw_field_array(F.col(value_col)).alias("_f"))
    ok = F.coalesce(F.size(F.col("_f")) == len(lf.RAW_FIELDS), F.lit(False))
    ua = F.col("_f")[len(lf.RAW_FIELDS) - 1]
    return fields.agg(F.count_if(ok).alias("parsed_records"), F.count_if(~ok).alias("rejected_lines"),
                      F.count_if(ok & (traits.ua_bot_flag(ua) == 1)).alias("suspicious_ua_requests"))
