from pyspark.sql import functions as F

from botlog.operators import marts
from botlog.plans import catalog
from conftest import SF_MID, make_requests


def test_drilldown_timeline_fills_gaps(spark):
    req = make_requests(spark, [("a", "2024-01-01 00:03:00", "/x", 200, "x"),
                                ("a", "2024-01-01 00:35:00", "/x", 200, "x"),
                                ("b", "2024-01-01 05:00:00", "/x", 200, "x")])
    got = [(r.time_bin.strftime("%H:%M"), r.requests)
           for r in marts.ip_drilldown_timeline(req, "a").orderBy("time_bin").collect()]
    assert got == [("00:00", 1), ("00:10", 0), ("00:20", 0), ("00:30", 1)]
    assert marts.ip_drilldown_timeline(req, "nobody").count() == 0


def test_semi_join_and_flag_agree_and_bins_sum(spark):
    req = catalog.requests_n(spark, SF_MID)
    scores = catalog.deterministic_scores(spark, SF_MID)
    sus = marts.suspicious_ips(scores)
    semi = marts.suspicious_requests(req, sus).count()
    flagged = marts.request_suspicious_flag(req, sus).filter("is_suspicious").count()
    assert semi == flagged > 0
    t = marts.traffic_over_time(req, sus).agg(F.sum("total_requests"), F.sum("suspicious_requests")).first()
    assert t[0] == req.filter(F.col("timestamp").isNotNull()).count()
    assert t[1] == semi


def test_path_abuse_empty_when_no_suspicious(spark):
    req = make_requests(spark, [("a", "2024-01-01 00:03:00", "/x", 200, "x")])
    empty = spark.createDataFrame([], "ip string, total_requests bigint, anomaly_score double, is_anomaly int")
    assert marts.path_abuse(req, empty).count() == 0


def test_filters(spark):
    s = spark.createDataFrame([("a", 10, -0.1, 1), ("b", 9, -0.5, 1), ("c", 50, 0.0, 0), ("d", 50, 0.01, 0)],
                              "ip string, total_requests bigint, anomaly_score double, is_anomaly int")
    assert [r.ip for r in marts.suspicious_ips(s).collect()] == ["a", "c"]
    assert [r.ip for r in marts.suspicious_ips(s, only_anomalies=True).collect()] == ["a"]
    assert [r.ip for r in marts.suspicious_ips(s, min_requests=1, threshold=-0.2).collect()] == ["b"]


def test_ua_stats_counts_known_addresses(spark):
    req = make_requests(spark, [("a", "2024-01-01 00:03:00", "/x", 200, "bot"),
                                (None, "2024-01-01 00:04:00", "/x", 200, "bot"),
                                ("b", "2024-01-01 00:05:00", "/x", 200, None)])
    s = spark.createDataFrame([("a", 10, -1.0, 1)], "ip string, total_requests bigint, anomaly_score double, is_anomaly int")
    got = {r.user_agent: r for r in marts.ua_stats(req, marts.suspicious_ips(s, min_requests=1)).collect()}
    assert list(got) == ["bot"]
    assert got["bot"].total_requests == 1 and got["bot"].requests_from_anomalous_ips == 1
    assert got["bot"].ua_category == "Known Bot"


def test_marts_with_nulls_match_pandas_rules(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(21)
    rows = []
    for _ in range(2000):
        ts = None if rng.random() < 0.1 else pd.Timestamp(1704067200 + int(rng.integers(0, 7200)), unit="s")
        rows.append((rng.choice(["a", "b", "c", None]), ts.strftime("%Y-%m-%d %H:%M:%S") if ts is not None else None,
                     rng.choice(["/x", "/y", None]), 200, rng.choice(["bot", "Mozilla", "curl", None])))
    req = make_requests(spark, rows)
    s = spark.createDataFrame([("a", 50, -1.0, 1), ("b", 50, 0.5, 0), ("c", 5, -1.0, 1)],
                              "ip string, total_requests bigint, anomaly_score double, is_anomaly int")
    sus = marts.suspicious_ips(s)          # only "a" passes both filters
    pdf = pd.DataFrame(rows, columns=["ip", "ts", "path", "status", "user_agent"])
    pdf["ts"] = pd.to_datetime(pdf["ts"])
    pdf["sus"] = pdf["ip"].isin({"a"})
    # traffic over time: every request with a time stamp, suspicious ones separately
    pdf["bin"] = pdf["ts"].dt.floor("10min")
    tot = pdf.groupby("bin").size()
    sus_bins = pdf[pdf["sus"]].groupby("bin").size()
    got = {r.time_bin: (r.total_requests, r.suspicious_requests) for r in marts.traffic_over_time(req, sus).collect()}
    assert got == {b.to_pydatetime(): (int(tot[b]), int(sus_bins.get(b, 0))) for b in tot.index}
    # UA stats: null agents dropped, total counts requests with a known address
    ua = pdf.groupby("user_agent").agg(total=("ip", "count"))
    an = pdf[pdf["sus"]]["user_agent"].value_counts()
    got = {r.user_agent: (r.total_requests, r.requests_from_anomalous_ips) for r in marts.ua_stats(req, sus).collect()}
    assert got == {u: (int(ua.loc[u, "total"]), int(an.get(u, 0))) for u in ua.index}
    # path abuse: null paths dropped
    pa = pdf[pdf["sus"]].groupby("path").agg(n=("ip", "count"), u=("ip", "nunique"))
    got = {r.path: (r.total_requests_from_suspicious_ips, r.number_of_unique_suspicious_ips)
           for r in marts.path_abuse(req, sus, n=None).collect()}
    assert got == {p: (int(pa.loc[p, "n"]), int(pa.loc[p, "u"])) for p in pa.index}
    # UA category counts keep Unknown; overview counts every request
    cats = {r.ua_category: r["count"] for r in marts.ua_category_counts(req).collect()}
    assert cats["Unknown"] == int(pdf["user_agent"].isna().sum()) and sum(cats.values()) == len(pdf)
    ov = marts.overview_metrics(req, s, sus).first()
    assert (ov.total_requests, ov.total_ips, ov.suspicious_ips, ov.suspicious_requests) == \
        (len(pdf), 3, 1, int(pdf["sus"].sum()))


def test_agent_seen_only_without_an_address_keeps_its_row(spark):
    from conftest import make_requests
    rows = [(None, "2025-01-01 00:00:00", "/", 200, "lost"), ("10.0.0.1", "2025-01-01 00:00:00", "/", 200, "seen"),
            (None, "2025-01-01 00:00:00", "/", 200, "seen")]
    sus = spark.createDataFrame([("10.0.0.1",)], "ip string")
    got = {r.user_agent: (r.total_requests, r.requests_from_anomalous_ips) for r in marts.ua_stats(make_requests(spark, rows), sus).collect()}
    assert got == {"lost": (0, 0), "seen": (1, 1)}
