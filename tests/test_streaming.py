"""Incremental runs of the streaming traffic job: bins are emitted once the
watermark passes them, late requests are dropped, restarts resume."""
import datetime as dt

import pytest

from botlog.operators import features, parse
from botlog.operators.daily import FeatureStates
from botlog.sources import read_log_text, read_parsed_log
from botlog.streaming import start_flag_stream, start_ingest_stream, start_session_stream, start_traffic_stream


def _line(ts: dt.datetime, ip="1.1.1.1"):
    return f'{ip} - - [{ts.strftime("%d/%b/%Y:%H:%M:%S")} +0000] "GET /a HTTP/1.1" 200 1 "-" "x"\n'


def test_stream_bins_watermark_and_restart(spark, tmp_path):
    src, sink, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)

    def run():
        q = start_traffic_stream(spark, str(src), str(sink), str(ck), watermark="10 minutes",
                                 max_files_per_trigger=1)
        q.awaitTermination(120)

    # batch 1: bins 00:00 (2 requests) and 00:10 (1)
    (src / "a.log").write_text(_line(t0 + dt.timedelta(minutes=1)) + _line(t0 + dt.timedelta(minutes=2))
                               + _line(t0 + dt.timedelta(minutes=12)))
    run()
    # batch 2 moves the watermark past 00:20: a late 00:05 request is dropped
    (src / "b.log").write_text(_line(t0 + dt.timedelta(minutes=45)))
    run()
    (src / "c.log").write_text(_line(t0 + dt.timedelta(minutes=5)) + _line(t0 + dt.timedelta(minutes=90)))
    run()
    got = {r.time_bin.strftime("%H:%M"): r.requests for r in spark.read.parquet(str(sink)).collect()}
    assert got["00:00"] == 2
    assert got["00:10"] == 1
    assert "01:30" not in got  # still open: watermark has not passed it


T0 = dt.datetime(2024, 1, 1, 23, 50, 0)


def _land(src, name, rows):
    (src / name).write_text("".join(_line(T0 + dt.timedelta(seconds=s), ip) for ip, s in rows) + "not a log line\n")


def test_ingest_is_exactly_once_over_failures(spark, tmp_path):
    """The driver dies after a batch is written and before it is committed; the restart replays that batch."""
    src, store, ck = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    src.mkdir()
    for i in range(5):
        _land(src, f"{i}.log", [(f"10.0.0.{j}", 400 * i + 60 * j) for j in range(12)] + [("hot", 400 * i)] * 30)
    states = FeatureStates(spark, str(tmp_path / "states"))
    died = []

    def die_once(batch_id):
        if batch_id in (1, 3) and batch_id not in died:
            died.append(batch_id)
            raise RuntimeError("driver lost")

    for attempt in range(3):
        q = start_ingest_stream(spark, str(src), store, ck, states, max_files_per_trigger=1, on_batch=die_once)
        if attempt < 2:
            with pytest.raises(Exception):
                q.awaitTermination(120)
        else:
            q.awaitTermination(120)
    assert died == [1, 3]
    batch = parse.parse_log_lines(read_log_text(spark, str(src)))
    got = read_parsed_log(spark, store)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str) and got.count() == 210
    assert spark.read.parquet(store).select("batch").distinct().count() == 5
    assert spark.read.parquet(store).select("date").distinct().count() == 2   # the log crosses midnight
    a = features.ip_features_v2(batch).orderBy("ip").toPandas()
    b = states.features().orderBy("ip").toPandas()
    assert a.round(9).equals(b.round(9))


def test_flags_follow_a_replaced_score_table(spark, tmp_path):
    src, store, ck, scores = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck"), str(tmp_path / "scores")
    src.mkdir()

    def put(bad):
        rows = [(ip, 100, -1.0 if ip == bad else 1.0, int(ip == bad)) for ip in ("a", "b", "c")]
        spark.createDataFrame(rows, "ip string, total_requests long, anomaly_score double, is_anomaly int").write.mode("overwrite").parquet(scores)

    for i in range(2):
        _land(src, f"{i}.log", [("a", 10 * i), ("b", 10 * i), ("new", 10 * i)])
    put("a")
    start_flag_stream(spark, str(src), scores, store, ck, max_files_per_trigger=1,
                      on_batch=lambda k: put("b") if k == 0 else None).awaitTermination(120)
    got = {(r.ip, r.batch): r.is_suspicious for r in spark.read.parquet(store).collect()}
    assert got == {("a", 0): True, ("b", 0): False, ("new", 0): False, ("a", 1): False, ("b", 1): True, ("new", 1): False}


def test_sessions_close_under_the_watermark(spark, tmp_path):
    src, sink, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def run(name, rows):
        _land(src, name, rows)
        start_session_stream(spark, str(src), sink, ck, gap_seconds=600, watermark="10 minutes").awaitTermination(120)
        return {(r.ip, int((r.first_request - T0).total_seconds()), int((r.last_request - T0).total_seconds()), r.requests)
                for r in spark.read.parquet(sink).collect()}

    # a gap of exactly 600 s stays in the session, one of 601 s ends it; a session goes on over files
    # (the watermark, 601, is past the end of the session of b, 600)
    assert run("0.log", [("a", 0), ("a", 600), ("a", 1201), ("b", 0)]) == {("b", 0, 0, 1)}
    assert run("1.log", [("a", 1300), ("c", 2400)]) == {("a", 0, 600, 2), ("b", 0, 0, 1)}
    # late for a closed session: dropped; the open one of a closes when time passes it
    got = run("2.log", [("b", 100), ("d", 9000)])
    assert got == {("a", 0, 600, 2), ("b", 0, 0, 1), ("a", 1201, 1300, 2), ("c", 2400, 2400, 1)}
    batch = features.session_depth(parse.parse_log_lines(read_log_text(spark, str(src))).where("ip = 'a'"), gap_seconds=600).first()
    assert (batch.sessions, batch.max_session_depth) == (2, 2)
