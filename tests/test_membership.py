"""Bloom-filtered membership and the address-ordered store."""
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from botlog.operators import marts, membership
from botlog.sources import read_parsed_log, write_clustered_log
from conftest import make_requests


def _data(spark, n=20_000, ips=4000):
    """Requests, one third of them by one address, and a set of a tenth of the others."""
    r = (spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None).cast("string"))
                               .otherwise(F.concat(F.lit("10."), F.pmod(F.xxhash64("id"), F.lit(ips)))).alias("ip"),
                               F.timestamp_seconds(F.lit(1709251200) + F.col("id")).alias("timestamp"), F.lit("/a").alias("path"), "id"))
    sus = spark.range(0, ips, 10).select(F.concat(F.lit("10."), "id").alias("ip"))
    return r, sus


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("expected", [None, 1, 10 ** 9])
def test_same_rows_as_the_plain_joins(spark, expected):
    r, sus = _data(spark)
    a = membership.suspicious_requests(r, sus, expected)
    assert sorted(x.id for x in a.collect()) == sorted(x.id for x in marts.suspicious_requests(r, sus).collect())
    b = membership.request_suspicious_flag(r, sus, expected).select("id", "is_suspicious")
    c = marts.request_suspicious_flag(r, sus).select("id", "is_suspicious")
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, c.collect()))


def test_what_is_shuffled_falls_to_the_suspicious_share(spark):
    r, sus = _data(spark)
    words = membership.filter_words(sus.count())
    kept = membership.maybe_in(r, membership.bloom_filter(sus, words), words)
    exact = marts.suspicious_requests(r, sus).count()
    passed = kept.count()
    assert exact <= passed <= exact + 0.02 * r.count()
    assert passed + membership.surely_not_in(r, membership.bloom_filter(sus, words), words).count() == r.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(membership.suspicious_requests(r, sus))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # from the top: exact join by shuffle, and below the requests' exchange the filter's broadcast join
    exact_join, exchange, bloom = p.index("SortMergeJoin [ip"), p.index("Exchange hashpartitioning(ip"), p.index("BroadcastHashJoin")
    assert exact_join < exchange < bloom and p.count("BroadcastHashJoin") == 1


def test_empty_sets_and_bounds(spark):
    r, sus = _data(spark, 300, 20)
    assert membership.suspicious_requests(r, sus.limit(0)).count() == 0
    assert membership.request_suspicious_flag(r, sus.limit(0)).where("is_suspicious").count() == 0
    assert membership.request_suspicious_flag(r.limit(0), sus).count() == 0
    assert membership.filter_words(10 ** 12) == membership.MAX_WORDS and membership.filter_words(0) == 64
    b = membership.bloom_filter(spark.range(5000).select(F.col("id").cast("string").alias("ip")), 64)
    assert b.count() <= 64


def test_one_address_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(1)
    rows = [("10.0.0.%03d" % rng.randrange(200) if rng.random() < 0.7 else "10.0.0.777", f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}",
             "/a" * 50 + str(rng.random()), 200, "x" * 40 + str(rng.random())) for i in range(12_000)]
    req = make_requests(spark, rows)
    out = str(tmp_path / "clustered")
    write_clustered_log(req, out, files=8, row_group_bytes=64 << 10)
    files = [str(f) for f in (tmp_path / "clustered").glob("*.parquet")]
    assert len(files) == 8
    groups = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = [i for i in range(meta.num_columns) if meta.schema.column(i).name == "ip"][0]
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups.append((s.min, s.max, meta.row_group(g).num_rows))
    holds = [n for lo, hi, n in groups if lo <= "10.0.0.042" <= hi]
    assert len(holds) <= 2 < len(groups) // 4
    assert sum(lo <= "10.0.0.777" <= hi for lo, hi, _ in groups) >= 2   # a hot address is split
    one = read_parsed_log(spark, out).filter(F.col("ip") == "10.0.0.042")
    qe = one._jdf.queryExecution()
    assert "PushedFilters: [IsNotNull(ip), EqualTo(ip,10.0.0.042)]" in qe.executedPlan().toString()
    assert qe.toRdd().count() == sum(r[0] == "10.0.0.042" for r in rows)
    read = qe.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read <= sum(holds)
    assert sorted(map(tuple, read_parsed_log(spark, out).collect()), key=str) == sorted(map(tuple, req.collect()), key=str)
