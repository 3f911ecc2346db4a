"""Access log derived from the driver's ``events`` table.

The reference ships no sample log, so the test and benchmark input is a
combined-format access log computed from ``events`` with plain Spark SQL
expressions (the same rules are written for DuckDB in ``oracles.py``, and
the two engines produce byte-identical lines). The rules are described in
FIXTURES.md §2: ``user_id`` -> client address, compressed time so request
rates are visible, three UTC offsets, ``props.k`` -> path, ``event_type`` /
``event_id`` -> status, ``user_id`` -> user agent, every 97th event has an
empty user agent (rejected by the parser) and every 13th a ``-`` size.

The result has the shape of ``spark.read.text``: one string column
``value``. It is a pure projection of ``events`` (no shuffle), so it scales
with that table and keeps its partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from botlog.session import ensure_utc, spread

_STAGE1 = [
    "event_id",
    "user_id",
    "event_type",
    "value",
    "CAST(REGEXP_EXTRACT(props, '[0-9]+', 0) AS INT) AS k",
    "1704067200 + CAST(FLOOR((UNIX_SECONDS(CAST(ts AS TIMESTAMP)) - 1704067200)"
    " / CASE WHEN user_id % 10 = 0 THEN 2000 ELSE 50 END) AS BIGINT) AS ep",
    "CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 39600 ELSE 20700 END AS off_s",
    "CASE user_id % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '+1100' ELSE '+0545' END AS off_txt",
]

_STAGE2 = [
    "event_id",
    "ep",
    "off_s",
    "off_txt",
    "CONCAT('10.0.', CAST(FLOOR(user_id / 256) AS INT), '.', CAST(user_id % 256 AS INT)) AS ip",
    "CASE WHEN k % 10 = 0 THEN '/login' WHEN k % 10 = 1 THEN CONCAT('/api/v1/items/', k)"
    " WHEN k % 10 = 2 THEN CONCAT('/search?q=', k) WHEN k % 10 < 6 THEN CONCAT('/product/', k)"
    " WHEN k % 10 < 8 THEN '/static/site.css' ELSE '/' END AS path",
    "CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 403"
    " WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 503 END"
    " WHEN event_id % 11 = 0 THEN 301 ELSE 200 END AS status",
    "CASE WHEN event_id % 13 = 0 THEN '-'"
    " ELSE CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING) END AS size_txt",
    "CASE WHEN event_id % 97 = 0 THEN ''"
    " WHEN user_id % 10 = 0 THEN 'Googlebot/2.1 (+http://www.google.com/bot.html)'"
    " WHEN user_id % 10 = 1 THEN 'python-requests/2.31' WHEN user_id % 10 = 2 THEN 'curl/8.4.0'"
    " WHEN user_id % 10 = 3 THEN 'Go-http-Requests/1.1' WHEN user_id % 50 = 4 THEN 'null'"
    " ELSE CONCAT('Mozilla/5.0 (X11) rv:', CAST(user_id % 7 AS INT)) END AS ua",
]

_LINE = (
    "CONCAT(ip, ' - - [', DATE_FORMAT(TIMESTAMP_SECONDS(ep + off_s), 'dd/MMM/yyyy:HH:mm:ss'),"
    " ' ', off_txt, '] \"', CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'GET' END, ' ', path,"
    " ' HTTP/1.1\" ', status, ' ', size_txt, ' \"-\" \"', ua, '\"') AS value"
)


# Odd lines that follow the derived ones (fixed values): a missing address,
# one-digit days, hours, minutes and seconds, an offset with a colon, no
# offset and two of them, junk time, odd sizes.
EDGE_LINES = (
    'NULL - - [05/Jan/2024:06:31:10 +0000] "GET / HTTP/1.1" 200 12 "-" "GhostAgent/1.0"',
    '10.9.0.1 - - [5/Jan/2024:06:31:10 +0000] "GET /a HTTP/1.1" 200 1e3 "-" "Edge/1.0"',
    '10.9.0.1 - - [05/Jan/2024:6:31:11 +0000] "GET /a HTTP/1.1" 404 0x1p3 "-" "Edge/1.0"',
    '10.9.0.1 - - [05/Jan/2024:17:31:12 +11:00] "GET /b HTTP/1.1" 200 12d "-" "Edge/1.0"',
    '10.9.0.1 - - [yesterday] "GET /b HTTP/1.1" 500 7.9 "-" "Edge/1.0"',
    '10.9.0.2 - - [05/Jan/2024:06:31:10 +0000] "GET /c HTTP/1.1" 200 .5 "-" "Edge/1.0"',
    '10.9.0.3 - - [5/Jan/2024:6:3:1 +0000] "GET /c HTTP/1.1" 200 1 "-" "Edge/1.0"',
    '10.9.0.3 - - [05/Jan/2024:06:31:10 ] "GET /d HTTP/1.1" 200 1 "-" "Edge/1.0"',
    '10.9.0.3 - - [05/Jan/2024:06:31:10 +11:00+1100] "GET /d HTTP/1.1" 200 1 "-" "Edge/1.0"',
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def access_log_lines(spark: SparkSession, sf_dir: str, with_event_id: bool = False) -> DataFrame:
    """Raw access-log lines (``value string``) derived from ``events``, and
    the edge lines (not with ``with_event_id``)."""
    ensure_utc(spark)  # DATE_FORMAT / CAST(ts AS TIMESTAMP) use the session zone
    events = spread(read_events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value", "props"))
    lines = events.selectExpr(*_STAGE1).selectExpr(*_STAGE2).selectExpr("event_id", _LINE)
    if with_event_id:
        return lines
    return lines.select("value").union(spark.createDataFrame([(x,) for x in EDGE_LINES], "value string"))
