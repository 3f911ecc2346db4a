import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from botlog.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


def make_requests(spark, rows):
    """Request table from (ip, 'YYYY-mm-dd HH:MM:SS' UTC or None, path, status, user_agent) tuples."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "ip string, ts string, path string, status bigint, user_agent string")
    return df.select("ip", F.to_timestamp("ts").alias("timestamp"), F.lit("GET").alias("method"), "path",
                     F.lit("HTTP/1.1").alias("protocol"), "status", F.lit(0).cast("bigint").alias("bytes_sent"),
                     F.lit("-").alias("referrer"), "user_agent", F.lit("+0000").alias("tz_offset"))
