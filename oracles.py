"""DuckDB oracle SQL for the correctness gate.

Each oracle is one SELECT over the pre-registered ``events`` view. The
access log is derived inline with the same rules as
``botlog.sources.events_log`` (FIXTURES.md §2), parsed with DuckDB's own
regex and strptime, and then the query under test is written in plain SQL.
Doubles are rounded to 6 places and instants are rendered as UTC
``TIMESTAMP`` values, as in the Spark side of each key.
"""

from __future__ import annotations

# Fixed values, written out here and not taken from the code under test:
# the log pattern, the missing-value tokens and the keyword lists.
LOG_PATTERN = r'(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d+) (\S+) "([^"]+)" "([^"]+)"'
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BOT_KEYWORDS = ("bot", "crawl", "spider", "python", "curl", "monitoring", "googlebot")
KNOWN_BOT_KEYWORDS = ("bot", "crawl", "spider", "monitoring", "googlebot")
LOGIN_API_KEYWORDS = ("/login", "/user", "/signin", "/api", "/search")
SCRIPT_KEYWORDS = ("python", "curl", "requests")

# Odd lines that follow the derived ones (fixed values of the test input).
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

DRILLDOWN_IP = "10.0.0.10"
LEVELS = (0.01, 0.02, 0.05, 0.10)

_PAT = "^" + LOG_PATTERN
_NULLS = ", ".join("'" + t + "'" for t in NULL_TOKENS)


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def _nt(col: str) -> str:
    return f"CASE WHEN {col} IN ({_NULLS}) THEN NULL ELSE {col} END"


UA_FLAG = f"CAST(COALESCE({_any('user_agent', BOT_KEYWORDS)}, FALSE) AS INTEGER)"
LOGIN_FLAG = f"CAST(COALESCE({_any('path', LOGIN_API_KEYWORDS)}, FALSE) AS INTEGER)"
UA_CATEGORY = (f"CASE WHEN user_agent IS NULL THEN 'Unknown' "
               f"WHEN {_any('user_agent', KNOWN_BOT_KEYWORDS)} THEN 'Known Bot' "
               f"WHEN {_any('user_agent', SCRIPT_KEYWORDS)} THEN 'Suspicious Script' "
               f"ELSE 'Likely Browser' END")


def _flag(lo: int, hi: int) -> str:
    return f"COALESCE(status >= {lo} AND status < {hi}, FALSE)"


_EDGES = ", ".join("'" + x + "'" for x in EDGE_LINES)

BASE_CTES = f"""
e0 AS (
  SELECT event_id, user_id, event_type, value,
    CAST(REGEXP_EXTRACT(props, '[0-9]+', 0) AS INT) AS k,
    1704067200 + CAST(FLOOR((FLOOR(EPOCH(ts)) - 1704067200)
      / CASE WHEN user_id % 10 = 0 THEN 2000 ELSE 50 END) AS BIGINT) AS ep,
    CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 39600 ELSE 20700 END AS off_s,
    CASE user_id % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '+1100' ELSE '+0545' END AS off_txt
  FROM events),
e1 AS (
  SELECT event_id, ep, off_s, off_txt,
    CONCAT('10.0.', CAST(FLOOR(user_id / 256) AS INT), '.', CAST(user_id % 256 AS INT)) AS ip,
    CASE WHEN k % 10 = 0 THEN '/login' WHEN k % 10 = 1 THEN CONCAT('/api/v1/items/', k)
         WHEN k % 10 = 2 THEN CONCAT('/search?q=', k) WHEN k % 10 < 6 THEN CONCAT('/product/', k)
         WHEN k % 10 < 8 THEN '/static/site.css' ELSE '/' END AS path,
    CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 403
                                     WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 503 END
         WHEN event_id % 11 = 0 THEN 301 ELSE 200 END AS status,
    CASE WHEN event_id % 13 = 0 THEN '-' ELSE CAST(CAST(FLOOR(value * 100) AS BIGINT) AS VARCHAR) END AS size_txt,
    CASE WHEN event_id % 97 = 0 THEN ''
         WHEN user_id % 10 = 0 THEN 'Googlebot/2.1 (+http://www.google.com/bot.html)'
         WHEN user_id % 10 = 1 THEN 'python-requests/2.31' WHEN user_id % 10 = 2 THEN 'curl/8.4.0'
         WHEN user_id % 10 = 3 THEN 'Go-http-Requests/1.1' WHEN user_id % 50 = 4 THEN 'null'
         ELSE CONCAT('Mozilla/5.0 (X11) rv:', CAST(user_id % 7 AS INT)) END AS ua
  FROM e0),
derived AS (
  SELECT CONCAT(ip, ' - - [',
    STRFTIME(MAKE_TIMESTAMP(CAST((ep + off_s) * 1000000 AS BIGINT)), '%d/%b/%Y:%H:%M:%S'),
    ' ', off_txt, '] "', CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'GET' END, ' ', path,
    ' HTTP/1.1" ', status, ' ', size_txt, ' "-" "', ua, '"') AS value
  FROM e1),
loglines AS (
  SELECT value FROM derived UNION ALL SELECT UNNEST([{_EDGES}]) AS value),
rawf AS (
  SELECT regexp_extract(value, '{_PAT}',
    ['ip', 'dt', 'method', 'path', 'protocol', 'status', 'size', 'referrer', 'user_agent']) AS g
  FROM loglines WHERE regexp_matches(value, '{_PAT}')),
req0 AS (
  SELECT g.ip AS ip, g.dt AS dt, TRY_STRPTIME(g.dt, '%d/%b/%Y:%H:%M:%S %z') AS tstz,
    g.method AS method, g.path AS path, g.protocol AS protocol, g.status AS status_txt,
    g.size AS size_txt, g.referrer AS referrer, g.user_agent AS user_agent
  FROM rawf),
req AS (
  SELECT ip, CAST(EPOCH(tstz) AS BIGINT) AS ts,
    MAKE_TIMESTAMP(CAST(EPOCH(tstz) AS BIGINT) * 1000000) AS "timestamp",
    method, path, protocol, TRY_CAST(status_txt AS BIGINT) AS status,
    COALESCE(TRY_CAST(TRUNC(TRY_CAST(size_txt AS DOUBLE)) AS BIGINT), 0) AS bytes_sent,
    referrer, user_agent,
    CASE WHEN tstz IS NOT NULL THEN replace(regexp_extract(dt, '[^ ]*$', 0), ':', '') END AS tz_offset,
    dt, status_txt, size_txt
  FROM req0),
reqn AS (
  SELECT {_nt('ip')} AS ip, ts, "timestamp", {_nt('method')} AS method, {_nt('path')} AS path,
    {_nt('protocol')} AS protocol, status, bytes_sent, {_nt('referrer')} AS referrer,
    {_nt('user_agent')} AS user_agent, tz_offset
  FROM req),
t AS (
  SELECT ip, ts, "timestamp", path, status, user_agent,
    CAST({_flag(400, 500)} AS INTEGER) AS n4, CAST({_flag(500, 600)} AS INTEGER) AS n5,
    CAST({_flag(300, 400)} AS INTEGER) AS n3, {LOGIN_FLAG} AS nl, {UA_FLAG} AS ua
  FROM reqn WHERE ip IS NOT NULL),
rpm AS (
  SELECT ip, ts - (ts % 60) AS minute_s, COUNT(*) AS req_count FROM t WHERE ts IS NOT NULL GROUP BY 1, 2),
rpm_ip AS (
  SELECT ip, CAST(AVG(req_count) AS DOUBLE) AS avg_requests_per_minute,
    CAST(MAX(req_count) AS BIGINT) AS max_requests_per_minute FROM rpm GROUP BY ip),
iv AS (
  SELECT ip, CAST(ts - LAG(ts) OVER (PARTITION BY ip ORDER BY ts) AS DOUBLE) AS d FROM t WHERE ts IS NOT NULL),
iv_ip AS (
  SELECT ip, AVG(d) AS mean_interval_sec, STDDEV_SAMP(d) AS std_interval_sec FROM iv GROUP BY ip),
pc AS (
  SELECT ip, path, COUNT(*) AS c FROM t WHERE path IS NOT NULL GROUP BY ip, path),
ent AS (
  SELECT ip, 0.0 - SUM((c / tot) * LN(c / tot)) AS path_entropy
  FROM (SELECT ip, c, CAST(SUM(c) OVER (PARTITION BY ip) AS DOUBLE) AS tot FROM pc) GROUP BY ip),
base_ip AS (
  SELECT ip, COUNT(*) AS total_requests, COUNT(DISTINCT path) AS unique_paths,
    AVG(n4) AS error_rate_4xx, AVG(n5) AS rate_5xx, AVG(n3) AS rate_3xx, AVG(nl) AS login_api_ratio,
    MAX(ua) AS ua_bot_flag
  FROM t GROUP BY ip),
f2 AS (
  SELECT b.ip, b.total_requests, b.unique_paths, b.error_rate_4xx, b.rate_5xx, b.rate_3xx,
    b.login_api_ratio, b.ua_bot_flag,
    COALESCE(r.avg_requests_per_minute, 0.0) AS avg_requests_per_minute,
    COALESCE(r.max_requests_per_minute, 0) AS max_requests_per_minute,
    COALESCE(i.mean_interval_sec, 0.0) AS mean_interval_sec,
    COALESCE(i.std_interval_sec, 0.0) AS std_interval_sec,
    COALESCE(e.path_entropy, 0.0) AS path_entropy,
    1 - b.unique_paths / b.total_requests AS repeated_path_ratio,
    COALESCE(r.max_requests_per_minute, 0) / (COALESCE(r.avg_requests_per_minute, 0.0) + 1e-6) AS burstiness
  FROM base_ip b LEFT JOIN rpm_ip r USING (ip) LEFT JOIN iv_ip i USING (ip) LEFT JOIN ent e USING (ip)),
det AS (
  SELECT *, ROUND(0.5 - 0.1 * max_requests_per_minute - error_rate_4xx, 6) AS anomaly_score FROM f2),
cut AS (
  SELECT ROUND(QUANTILE_CONT(anomaly_score, 0.05), 6) AS c FROM det),
scores AS (
  SELECT det.*, CAST(anomaly_score < cut.c AS INTEGER) AS is_anomaly FROM det, cut),
sus AS (
  SELECT * FROM scores WHERE total_requests >= 10 AND anomaly_score <= 0.0)
"""


def _q(body: str) -> str:
    body = body.strip()
    if body.startswith(","):
        return "WITH " + BASE_CTES.strip() + body
    return "WITH " + BASE_CTES.strip() + "\n" + body


def _r(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 6)"


_ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    _ORACLES[name] = _q(body)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


# --- sources and parsing ----------------------------------------------------
oracle("scan_raw_log", "SELECT value FROM loglines")
oracle("parse_log_lines", """
SELECT ip, "timestamp", method, path, protocol, status, bytes_sent, referrer, user_agent, tz_offset FROM req""")
oracle("rejected_lines", f"SELECT value FROM loglines WHERE NOT regexp_matches(value, '{_PAT}')")
oracle("parse_timestamp", 'SELECT dt AS datetime, "timestamp", tz_offset FROM req')
oracle("coerce_status", "SELECT status_txt AS status_text, status FROM req")
oracle("coerce_bytes", "SELECT size_txt AS size_text, bytes_sent FROM req")
oracle("null_tokens", "SELECT ip, method, path, protocol, referrer, user_agent FROM reqn")
oracle("scan_parsed_log", """
SELECT ip, "timestamp", method, path, protocol, status, bytes_sent, referrer, user_agent, tz_offset FROM reqn""")
oracle("sink_parsed_log_csv", """
SELECT ip, "timestamp", method, path, protocol, status, bytes_sent, referrer, user_agent, tz_offset FROM reqn""")
oracle("sink_parsed_log", """
SELECT ip, "timestamp", method, path, protocol, status, bytes_sent, referrer, user_agent, tz_offset FROM req""")

# --- heuristic reports (pre-CSV table) ----------------------------------------
oracle("top_ips", "SELECT ip, COUNT(*) AS count FROM req GROUP BY ip ORDER BY count DESC, ip LIMIT 20")
oracle("top_repeated_paths", """
SELECT ip, path, COUNT(*) AS count FROM req GROUP BY ip, path ORDER BY count DESC, ip, path LIMIT 20""")
oracle("top_error_ips", """
SELECT ip, COUNT(*) AS count FROM req WHERE status IN (401, 403, 404)
GROUP BY ip ORDER BY count DESC, ip LIMIT 10""")
oracle("suspicious_ua_requests", f"""
SELECT ip, "timestamp", method, path, protocol, status, bytes_sent, referrer, user_agent, tz_offset
FROM req WHERE {UA_FLAG} = 1""")
oracle("parse_summary", f"""
SELECT (SELECT COUNT(*) FROM req) AS parsed_records,
  (SELECT COUNT(*) FROM loglines WHERE NOT regexp_matches(value, '{_PAT}')) AS rejected_lines,
  (SELECT COUNT(*) FROM req WHERE {UA_FLAG} = 1) AS suspicious_ua_requests""")
oracle("suspicious_ua_sample", f"""
SELECT user_agent, MIN("timestamp") AS first_seen FROM req WHERE {UA_FLAG} = 1
GROUP BY user_agent ORDER BY first_seen NULLS LAST, user_agent LIMIT 10""")

# --- row-level traits -----------------------------------------------------------
_MIN = "MAKE_TIMESTAMP((ts - ts % 60) * 1000000)"
_BIN = "MAKE_TIMESTAMP((ts - ts % 600) * 1000000)"
oracle("minute_bucket", f'SELECT ip, "timestamp", {_MIN} AS minute FROM reqn')
oracle("status_class_flags", f"""
SELECT ip, status, CAST({_flag(400, 500)} AS INTEGER) AS is_4xx, CAST({_flag(500, 600)} AS INTEGER) AS is_5xx,
  CAST({_flag(300, 400)} AS INTEGER) AS is_3xx FROM reqn""")
oracle("ua_bot_flag", f"SELECT ip, user_agent, {UA_FLAG} AS ua_bot_flag FROM reqn")
oracle("login_api_flag", f"SELECT ip, path, {LOGIN_FLAG} AS is_login_api FROM reqn")
oracle("time_bin_10min", f'SELECT ip, "timestamp", {_BIN} AS time_bin FROM reqn')
oracle("ua_category", f"SELECT ip, user_agent, {UA_CATEGORY} AS ua_category FROM reqn")

# --- per-IP features --------------------------------------------------------------
oracle("requests_per_minute", "SELECT ip, MAKE_TIMESTAMP(minute_s * 1000000) AS minute, req_count FROM rpm")
oracle("ip_rpm_stats", f"""
SELECT ip, {_r('avg_requests_per_minute')} AS avg_requests_per_minute, max_requests_per_minute FROM rpm_ip""")
oracle("ip_intervals", """
SELECT ip, "timestamp", LAG("timestamp") OVER (PARTITION BY ip ORDER BY ts) AS prev_timestamp,
  ROUND(CAST(ts - LAG(ts) OVER (PARTITION BY ip ORDER BY ts) AS DOUBLE), 6) AS interval_sec
FROM t WHERE ts IS NOT NULL""")
oracle("ip_interval_stats", f"""
SELECT ip, {_r('mean_interval_sec')} AS mean_interval_sec, {_r('std_interval_sec')} AS std_interval_sec FROM iv_ip""")
oracle("periodicity", f"""
SELECT ip, CASE WHEN mean_interval_sec > 0 THEN {_r('std_interval_sec / mean_interval_sec')} END AS periodicity FROM iv_ip""")
oracle("resource_share", """
SELECT ip, ROUND(AVG(CASE WHEN regexp_matches(path, '(?i)\\.(css|js|png|jpe?g|gif|svg|ico|webp|woff2?)([?#]|$)') THEN 1.0 ELSE 0.0 END), 6)
  AS resource_share FROM t GROUP BY ip""")
oracle("session_depth", """
, cut AS (SELECT ip, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY ip ORDER BY ts) <= 1800 THEN 0 ELSE 1 END AS b
  FROM t WHERE ts IS NOT NULL),
sess AS (SELECT ip, SUM(b) OVER (PARTITION BY ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM cut),
depth AS (SELECT ip, s, COUNT(*) AS d FROM sess GROUP BY ip, s)
SELECT ip, COUNT(*) AS sessions, ROUND(AVG(d), 6) AS avg_session_depth, MAX(d) AS max_session_depth FROM depth GROUP BY ip""".replace("cut AS", "cuts AS").replace("FROM cut)", "FROM cuts)"))
oracle("time_bin_10min_local", """
, w AS (SELECT ip, ts, "timestamp", CASE WHEN left(tz_offset, 1) = '-' THEN -1 ELSE 1 END
    * (CAST(substr(tz_offset, 2, 2) AS INT) * 3600 + CAST(substr(tz_offset, 4, 2) AS INT) * 60) AS off FROM reqn)
SELECT ip, "timestamp", MAKE_TIMESTAMP((CAST(FLOOR((ts + off) / 600) AS BIGINT) * 600 - off) * 1000000) AS time_bin FROM w""")
oracle("stratified_split", """
, h AS (SELECT ip, ua_bot_flag, md5(ip || ':42')[1:13] AS h FROM f2),
k AS (SELECT ua_bot_flag, CAST(round_even(0.3 * COUNT(*), 0) AS BIGINT) AS n FROM h GROUP BY 1),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ua_bot_flag ORDER BY h) AS r FROM h)
SELECT ip, ua_bot_flag, CAST(r <= n AS INT) AS is_test FROM o JOIN k USING (ua_bot_flag)""")
oracle("stratified_split_threshold", """
SELECT ip, ua_bot_flag, CAST(CAST('0x' || md5(ip || ':42')[1:13] AS BIGINT)
  < CAST(FLOOR((CASE WHEN ua_bot_flag = 1 THEN 1.0::DOUBLE / 3 ELSE 0.2::DOUBLE END) * 4503599627370496.0::DOUBLE) AS BIGINT) AS INT) AS is_test FROM f2""")
oracle("iforest_sample", """
, tr AS (SELECT CAST(UNNEST(RANGE(100)) AS INT) AS tree),
h AS (SELECT tree, ip, md5(ip || ':42:' || CAST(tree // 2 AS VARCHAR))[(1 + 13 * (tree % 2)):(13 + 13 * (tree % 2))] AS h FROM base_ip, tr),
o AS (SELECT tree, ip, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY h, ip) AS r FROM h)
SELECT tree, ip FROM o WHERE r <= 64""")
oracle("ip_path_entropy", f"""
SELECT b.ip, {_r('COALESCE(e.path_entropy, 0.0)')} AS path_entropy FROM base_ip b LEFT JOIN ent e USING (ip)""")
_F1 = ("ip, total_requests, unique_paths, {e4}, ua_bot_flag, {avg}, max_requests_per_minute, {rpr}").format(
    e4=_r("error_rate_4xx") + " AS error_rate_4xx", avg=_r("avg_requests_per_minute") + " AS avg_requests_per_minute",
    rpr=_r("repeated_path_ratio") + " AS repeated_path_ratio")
oracle("ip_features_v1", f"SELECT {_F1} FROM f2")
_F2_DOUBLES = ("error_rate_4xx", "rate_5xx", "rate_3xx", "login_api_ratio", "avg_requests_per_minute",
               "mean_interval_sec", "std_interval_sec", "path_entropy", "repeated_path_ratio", "burstiness")
_F2 = "ip, total_requests, unique_paths, ua_bot_flag, max_requests_per_minute, " + ", ".join(
    f"{_r(c)} AS {c}" for c in _F2_DOUBLES)
oracle("ip_features_v2", f"SELECT {_F2} FROM f2")
oracle("ip_features_v2_daily", f"SELECT {_F2} FROM f2")
oracle("approx_distinct_ips", """
SELECT 'day' AS scope, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, COUNT(DISTINCT ip) AS ips FROM t GROUP BY 2
UNION ALL SELECT 'all', NULL, COUNT(DISTINCT ip) FROM t""")

# --- marts on the deterministic score --------------------------------------------
_SUS = ("ip, total_requests, max_requests_per_minute, " + _r("error_rate_4xx") + " AS error_rate_4xx, "
        "ua_bot_flag, " + _r("anomaly_score") + " AS anomaly_score, is_anomaly")
oracle("suspicious_ips", f"SELECT {_SUS} FROM sus")
oracle("sink_scores", f"SELECT {_SUS} FROM scores")
oracle("scan_scores", f"SELECT {_SUS} FROM scores")
oracle("drilldown_candidates", f"""
SELECT ip, {_r('anomaly_score')} AS anomaly_score FROM sus ORDER BY anomaly_score, ip LIMIT 50""")
oracle("ip_drilldown_timeline", f"""
, b AS (SELECT ts - ts % 600 AS b FROM reqn WHERE ip = '{DRILLDOWN_IP}' AND ts IS NOT NULL),
g AS (SELECT UNNEST(RANGE(MIN(b), MAX(b) + 1, 600)) AS b FROM b),
c AS (SELECT b, COUNT(*) AS n FROM b GROUP BY b)
SELECT MAKE_TIMESTAMP(g.b * 1000000) AS time_bin, COALESCE(c.n, 0) AS requests FROM g LEFT JOIN c USING (b)""")
oracle("ip_drilldown_paths", f"""
SELECT path, COUNT(*) AS count FROM reqn WHERE ip = '{DRILLDOWN_IP}' AND path IS NOT NULL
GROUP BY path ORDER BY count DESC, path LIMIT 10""")
oracle("overview_metrics", """
, m AS (SELECT (SELECT COUNT(*) FROM reqn) AS total_requests,
  (SELECT COUNT(DISTINCT ip) FROM scores) AS total_ips,
  (SELECT COUNT(*) FROM sus) AS suspicious_ips,
  (SELECT COUNT(*) FROM reqn WHERE ip IN (SELECT ip FROM sus)) AS suspicious_requests)
SELECT total_requests, total_ips, suspicious_ips, suspicious_requests,
  ROUND(COALESCE(100.0 * suspicious_requests / NULLIF(total_requests, 0), 0.0), 6) AS suspicious_traffic_pct FROM m""")
oracle("suspicious_requests", """
SELECT ip, "timestamp", path, status, user_agent FROM reqn WHERE ip IN (SELECT ip FROM sus)""")
oracle("request_suspicious_flag", """
SELECT ip, "timestamp", path, CAST(COALESCE(ip IN (SELECT ip FROM sus), FALSE) AS INTEGER) AS is_suspicious FROM reqn""")
oracle("traffic_over_time", """
SELECT MAKE_TIMESTAMP((ts - ts % 600) * 1000000) AS time_bin, COUNT(*) AS total_requests,
  COUNT(*) FILTER (WHERE ip IN (SELECT ip FROM sus)) AS suspicious_requests
FROM reqn WHERE ts IS NOT NULL GROUP BY 1""")
_UA_STATS = f"""
, us AS (SELECT user_agent, COUNT(ip) AS total_requests, {UA_CATEGORY} AS ua_category,
  COUNT(*) FILTER (WHERE ip IN (SELECT ip FROM sus)) AS requests_from_anomalous_ips
  FROM reqn WHERE user_agent IS NOT NULL GROUP BY user_agent)"""
oracle("ua_stats", _UA_STATS + " SELECT * FROM us")
oracle("top_user_agents", _UA_STATS + " SELECT * FROM us ORDER BY total_requests DESC, user_agent LIMIT 20")
oracle("ua_category_counts", f"SELECT {UA_CATEGORY} AS ua_category, COUNT(*) AS count FROM reqn GROUP BY 1")
oracle("path_abuse", """
SELECT path, COUNT(*) AS total_requests_from_suspicious_ips, COUNT(DISTINCT ip) AS number_of_unique_suspicious_ips
FROM reqn WHERE path IS NOT NULL AND ip IN (SELECT ip FROM sus)
GROUP BY path ORDER BY total_requests_from_suspicious_ips DESC, path LIMIT 20""")
oracle("score_range", f"""
SELECT {_r('MIN(anomaly_score)')} AS min_score, {_r('MAX(anomaly_score)')} AS max_score FROM scores""")
oracle("top_anomalies", f"""
SELECT ip, total_requests, max_requests_per_minute, {_r('repeated_path_ratio')} AS repeated_path_ratio, ua_bot_flag,
  {_r('anomaly_score')} AS anomaly_score, is_anomaly FROM scores ORDER BY anomaly_score, ip LIMIT 20""")
oracle("top20_flagged_count", """
SELECT COUNT(*) FILTER (WHERE ua_bot_flag = 1) AS flagged
FROM (SELECT * FROM scores ORDER BY anomaly_score, ip LIMIT 20)""")

# --- other forms of the same questions: one oracle each
for _form, _plain in (("suspicious_requests_bloom", "suspicious_requests"), ("request_suspicious_flag_bloom", "request_suspicious_flag"),
                      ("ip_drilldown_timeline_clustered", "ip_drilldown_timeline"), ("ip_drilldown_paths_clustered", "ip_drilldown_paths")):
    _ORACLES[_form] = _ORACLES[_plain]

# --- evaluation -------------------------------------------------------------------
_EV = """
, ev AS (SELECT ua_bot_flag AS y, is_anomaly AS p, -anomaly_score AS s FROM scores),
cm AS (SELECT COUNT(*) FILTER (WHERE y = 0 AND p = 0) AS tn, COUNT(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
              COUNT(*) FILTER (WHERE y = 1 AND p = 0) AS fn, COUNT(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM ev),
sg AS (SELECT s, SUM(y) AS pos, SUM(1 - y) AS neg FROM ev GROUP BY s),
sc AS (SELECT s, pos, neg,
  SUM(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
  SUM(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM sg),
tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM sg),
auc AS (SELECT CASE WHEN MIN(P) > 0 AND MIN(N) > 0
  THEN SUM(neg * (cp - pos / 2.0)) / (MIN(P) * MIN(N)) END AS auc FROM sc, tot)"""


def _div(a: str, b: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


oracle("confusion_matrix", _EV + " SELECT tn, fp, fn, tp FROM cm")
_P1, _R1, _F1S = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
_P0, _R0, _F0S = _div("tn", "tn + fn"), _div("tn", "tn + fp"), _div("2 * tn", "2 * tn + fn + fp")
_W0, _W1 = _div("tn + fp", "tn + fp + fn + tp"), _div("tp + fn", "tn + fp + fn + tp")
oracle("classification_report", _EV + f"""
, rep AS (
  SELECT 'Likely Human' AS label, {_P0} AS precision, {_R0} AS recall, {_F0S} AS f1_score, tn + fp AS support FROM cm
  UNION ALL SELECT 'Likely Bot', {_P1}, {_R1}, {_F1S}, tp + fn FROM cm
  UNION ALL SELECT 'accuracy', NULL, NULL, {_div('tp + tn', 'tn + fp + fn + tp')}, tn + fp + fn + tp FROM cm
  UNION ALL SELECT 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0S} + {_F1S}) / 2, tn + fp + fn + tp FROM cm
  UNION ALL SELECT 'weighted avg', {_P0} * {_W0} + {_P1} * {_W1}, {_R0} * {_W0} + {_R1} * {_W1},
    {_F0S} * {_W0} + {_F1S} * {_W1}, tn + fp + fn + tp FROM cm)
SELECT label, {_r('precision')} AS precision, {_r('recall')} AS recall, {_r('f1_score')} AS f1_score, support FROM rep""")
oracle("roc_auc", _EV + f" SELECT {_r('auc')} AS auc FROM auc")
oracle("roc_curve", _EV + f"""
SELECT CASE WHEN N > 0 THEN 0.0 END AS fpr, CASE WHEN P > 0 THEN 0.0 END AS tpr, CAST('inf' AS DOUBLE) AS threshold FROM tot
UNION ALL
SELECT {_r('cn / NULLIF(CAST(N AS DOUBLE), 0)')}, {_r('cp / NULLIF(CAST(P AS DOUBLE), 0)')}, {_r('s')} FROM sc, tot""")
oracle("roc_curve_corners", _EV + f"""
, st AS (SELECT *, LEAD(pos) OVER w AS pos2, LEAD(neg) OVER w AS neg2, ROW_NUMBER() OVER w AS r, COUNT(*) OVER () AS n
  FROM sc WINDOW w AS (ORDER BY s DESC))
SELECT CASE WHEN N > 0 THEN 0.0 END AS fpr, CASE WHEN P > 0 THEN 0.0 END AS tpr, CAST('inf' AS DOUBLE) AS threshold FROM tot
UNION ALL
SELECT {_r('cn / NULLIF(CAST(tot.N AS DOUBLE), 0)')}, {_r('cp / NULLIF(CAST(tot.P AS DOUBLE), 0)')}, {_r('s')}
FROM st, tot WHERE r = 1 OR r = st.n OR pos <> pos2 OR neg <> neg2""")
oracle("label_balance", "SELECT ua_bot_flag AS label, COUNT(*) AS count FROM f2 GROUP BY 1")
_SCALED = ", ".join(
    f"{_r(f'COALESCE((CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER ()) / NULLIF(STDDEV_POP(CAST({c} AS DOUBLE)) OVER (), 0), 0.0)')} AS {c}"
    for c in ("total_requests", "unique_paths", "repeated_path_ratio", "avg_requests_per_minute",
              "max_requests_per_minute", "error_rate_4xx", "rate_5xx", "rate_3xx", "mean_interval_sec",
              "std_interval_sec", "burstiness", "path_entropy", "login_api_ratio"))
oracle("scaled_features", f"SELECT ip, {_SCALED} FROM f2")
_LV = " UNION ALL ".join(
    f"SELECT CAST({lv} AS DOUBLE) AS contamination, ROUND(QUANTILE_CONT(anomaly_score, {lv}), 6) AS cut FROM det"
    for lv in LEVELS)
_SWEEP = _EV + f"""
, lv AS ({_LV}),
lc AS (SELECT contamination, cut,
  COUNT(*) FILTER (WHERE anomaly_score < cut AND ua_bot_flag = 1) AS tp,
  COUNT(*) FILTER (WHERE anomaly_score < cut AND ua_bot_flag = 0) AS fp,
  COUNT(*) FILTER (WHERE NOT (anomaly_score < cut) AND ua_bot_flag = 1) AS fn,
  COUNT(*) FILTER (WHERE anomaly_score < cut) AS flagged
  FROM lv, det GROUP BY contamination, cut),
sweep AS (SELECT contamination, {_P1} AS precision, {_R1} AS recall, {_F1S} AS f1, (SELECT auc FROM auc) AS auc FROM lc)"""
oracle("contamination_cut", _SWEEP + f" SELECT contamination, {_r('cut')} AS cut, flagged FROM lc")
_SW_SEL = (f"contamination, {_r('precision')} AS precision, {_r('recall')} AS recall, {_r('f1')} AS f1, "
           f"{_r('auc')} AS auc")
oracle("contamination_sweep", _SWEEP + f" SELECT {_SW_SEL} FROM sweep")
oracle("best_contamination", _SWEEP + f" SELECT {_SW_SEL} FROM sweep ORDER BY f1 DESC, contamination LIMIT 1")

# --- streaming form of the traffic bins -----------------------------------------
oracle("traffic_over_time_stream", """
, mx AS (SELECT MAX(ts) AS m FROM req),
sb AS (SELECT ts - ts % 600 AS b, COUNT(*) AS requests FROM req WHERE ts IS NOT NULL GROUP BY 1)
SELECT MAKE_TIMESTAMP(b * 1000000) AS time_bin, requests FROM sb, mx WHERE b + 600 <= m - 1800""")
oracle("sessions_stream", """
, mx AS (SELECT MAX(ts) AS m FROM t),
cuts AS (SELECT ip, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY ip ORDER BY ts) <= 1800 THEN 0 ELSE 1 END AS b
  FROM t WHERE ts IS NOT NULL),
sess AS (SELECT ip, ts, SUM(b) OVER (PARTITION BY ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM cuts),
ses AS (SELECT ip, MIN(ts) AS a, MAX(ts) AS z, COUNT(*) AS requests FROM sess GROUP BY ip, s)
SELECT ip, MAKE_TIMESTAMP(a * 1000000) AS first_request, MAKE_TIMESTAMP(z * 1000000) AS last_request, requests
FROM ses, mx WHERE z + 1800 <= m - 1800""")
_ORACLES["stream_ingest"] = _ORACLES["parse_log_lines"]
_ORACLES["stream_flags"] = _ORACLES["request_suspicious_flag"]

# --- parts of the model keys that are no model -----------------------------------
oracle("traffic_over_time_local", """
, w AS (SELECT ip, ts, CASE WHEN left(tz_offset, 1) = '-' THEN -1 ELSE 1 END
    * (CAST(substr(tz_offset, 2, 2) AS INT) * 3600 + CAST(substr(tz_offset, 4, 2) AS INT) * 60) AS off FROM reqn WHERE ts IS NOT NULL)
SELECT MAKE_TIMESTAMP((CAST(FLOOR((ts + off) / 600) AS BIGINT) * 600 - off) * 1000000) AS time_bin, COUNT(*) AS total_requests,
  COUNT(*) FILTER (WHERE ip IN (SELECT ip FROM sus)) AS suspicious_requests FROM w GROUP BY 1""")
oracle("hybrid_rule_hits", """
SELECT ip, ua_bot_flag, CAST(NULL AS DOUBLE) AS anomaly_score, 1 AS is_bot, 'rule' AS detected_by FROM f2 WHERE ua_bot_flag = 1""")
oracle("cross_validation_folds", """
SELECT ip, CAST('0x' || md5(ip || ':42')[1:13] AS BIGINT) % 5 AS fold FROM f2""")
