"""Edge lines of the combined log format (FIXTURES.md §3)."""
import datetime as dt

from botlog.operators import parse

T = "[25/Nov/2025:06:31:10 +1100]"


def _parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return parse.parse_log_lines(df).collect()


def test_basic_line_parses_to_utc_instant(spark):
    rows = _parse(spark, [f'1.1.1.1 - - {T} "GET /a HTTP/1.1" 200 12 "-" "Mozilla"'])
    assert len(rows) == 1
    r = rows[0]
    assert r.ip == "1.1.1.1" and r.method == "GET" and r.path == "/a" and r.protocol == "HTTP/1.1"
    assert r.status == 200 and r.bytes_sent == 12 and r.referrer == "-" and r.user_agent == "Mozilla"
    assert r.timestamp.replace(tzinfo=None) == dt.datetime(2025, 11, 24, 19, 31, 10)
    assert r.tz_offset == "+1100"


def test_rejects(spark):
    bad = [
        f'1.1.1.1 - - {T} "GET /a HTTP/1.1" 200 12 "-" ""',          # empty user agent
        f'1.1.1.1 - - {T} "-" 400 12 "-" "x"',                       # no path / protocol
        f'junk junk 1.1.1.1 - - {T} "GET /a HTTP/1.1" 200 - "-" "z"',  # anchored at the start
        "",
        "garbage",
    ]
    assert _parse(spark, bad) == []
    df = spark.createDataFrame([(x,) for x in bad], "value string")
    assert parse.rejected_lines(df).count() == len(bad)


def test_user_agent_stops_at_first_quote_and_trailing_text_ignored(spark):
    rows = _parse(spark, [f'1.1.1.1 - - {T} "GET /a HTTP/1.1" 200 - "-" "M \\"q\\" x" trailing'])
    assert len(rows) == 1
    assert rows[0].user_agent == "M \\"
    assert rows[0].bytes_sent == 0


def test_bad_timestamp_is_null_not_rejected(spark):
    rows = _parse(spark, ['1.1.1.1 - - [junk] "GET /a HTTP/1.1" 200 5 "-" "x"'])
    assert len(rows) == 1 and rows[0].timestamp is None and rows[0].tz_offset is None


def test_size_coercion(spark):
    lines = [f'1.1.1.1 - - {T} "GET /a HTTP/1.1" 200 {s} "-" "x"' for s in ("1e3", "1.9", "-", "12d", "abc")]
    got = [r.bytes_sent for r in _parse(spark, lines)]
    assert sorted(got) == sorted([1000, 1, 0, 0, 0])


def test_unicode_digit_status_matches_but_is_null(spark):
    rows = _parse(spark, [f'1.1.1.1 - - {T} "GET /a HTTP/1.1" ٢٠٠ 5 "-" "x"'])
    assert len(rows) == 1 and rows[0].status is None


def test_separator_char_in_line_takes_exact_path(spark):
    rows = _parse(spark, [f'1.1.1.1 - - {T} "GET /a\u0001b HTTP/1.1" 200 5 "-" "x"'])
    assert len(rows) == 1 and rows[0].path == "/a\u0001b"


def test_null_tokens(spark):
    from pyspark.sql import functions as F
    toks = ["null", "None", "NA", "none", "Null", "-", "", "nan"]
    df = spark.createDataFrame([(t,) for t in toks], "user_agent string")
    out = parse.with_null_tokens(df, ["user_agent"]).select(F.col("user_agent")).collect()
    got = [r.user_agent for r in out]
    assert got == [None, None, None, "none", "Null", "-", None, None]


def test_invalid_utf8_bytes_dropped(spark, tmp_path):
    from botlog.sources import read_log_text
    p = tmp_path / "log.txt"
    p.write_bytes(b"ok\xff\xfeend\nline2\r\nline3\rline4\n")
    vals = [r.value for r in read_log_text(spark, str(p)).collect()]
    assert sorted(vals) == sorted(["okend", "line2", "line3", "line4"])


def test_time_stamps_and_sizes_the_format_accepts(spark):
    from pyspark.sql import functions as F
    from botlog.functions import logformat as lf
    stamps = [("25/Nov/2025:06:31:10 +1100", 1764012670, "+1100"), ("5/Nov/2025:06:31:10 +0000", 1762324270, "+0000"),
              ("05/Nov/2025:6:31:10 +0000", 1762324270, "+0000"), ("05/Nov/2025:06:31:10 +11:00", 1762284670, "+1100"),
              ("05/Nov/2025:06:31:10 Z", 1762324270, "+0000"), ("05/Nov/2025:06:31:10", None, None), ("junk", None, None),
              ("32/Nov/2025:06:31:10 +0000", None, None), ("05/Nov/2025:06:31:10 +1100 x", None, None)]
    df = spark.createDataFrame([(s,) for s, _, _ in stamps], "s string")
    got = df.select("s", F.unix_seconds(lf.parse_timestamp(F.col("s"))).alias("t"), lf.tz_offset(F.col("s")).alias("o")).collect()
    assert [(r.s, r.t, r.o) for r in got] == stamps
    sizes = {"12": 12, "1e3": 1000, "3.9": 3, "-": 0, "0x1p3": 0, "12d": 0, "12f": 0, ".5": 0, "5.": 5, "1e400": 0, "NaN": 0, "+7": 7}
    df = spark.createDataFrame([(s,) for s in sizes], "s string")
    assert {r.s: r.b for r in df.select("s", lf.coerce_bytes(F.col("s")).alias("b")).collect()} == sizes
