"""Daily feature states: merges under any split, snapshots, pruning, sketches."""
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from botlog.operators import daily, features, parse
from botlog.plans import jobs
from botlog.sources import write_parsed_log
from conftest import make_requests

DAY = dt.date(2024, 3, 1)


def _rows(seed=3, n=900):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        ip = rng.choice(["hot", "hot", "b", "c", "d", None])
        at = dt.datetime(2024, 3, 1) + dt.timedelta(seconds=rng.choice([rng.randrange(5 * 86400), rng.randrange(600)]))
        ts = None if rng.random() < 0.05 else at.strftime("%Y-%m-%d %H:%M:%S")
        rows.append((ip, ts, rng.choice(["/a", "/b", "/login", None]), rng.choice([200, 301, 404, 503, None]), rng.choice(["x", "curl/8", None])))
    return rows + [("once", None, "/z", 200, "x"), ("pair", "2024-03-02 23:59:59", "/p", 200, "x"), ("pair", "2024-03-03 00:00:00", "/p", 200, "x")]


def _frame(df):
    return df.orderBy("ip").toPandas()


def _same(a, b):
    pd.testing.assert_frame_equal(_frame(a), _frame(b), check_exact=False, rtol=1e-9)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_merge_under_any_split(spark, seed):
    """Not only days: any dealing of the requests to parts gives the same features."""
    rows, rng = _rows(seed), random.Random(seed)
    parts = [[] for _ in range(4)]
    for r in rows:
        rng.choice(parts).append(r)
    paths = minutes = None
    for p in parts:
        r = make_requests(spark, p) if p else make_requests(spark, rows).limit(0)
        a, b = daily.path_state(r), daily.minute_state(r)
        paths, minutes = (a, b) if paths is None else (paths.unionByName(a), minutes.unionByName(b))
    _same(daily.features_from_states(paths.drop("day"), minutes), features.ip_features_v2(make_requests(spark, rows)))


def test_store_by_day_equals_one_scan(spark, tmp_path):
    store, root = str(tmp_path / "requests"), str(tmp_path / "states")
    rows = _rows()
    req = make_requests(spark, rows)
    write_parsed_log(req, store)
    states = daily.FeatureStates(spark, root)
    for i in [*range(5), None]:
        states.update_day(store, None if i is None else DAY + dt.timedelta(days=i))
    want = features.ip_features_v2(parse.with_null_tokens(req))
    _same(states.features(), want)
    states.compact(DAY)
    states.compact(DAY + dt.timedelta(days=2))
    assert states.snapshots() == [DAY, DAY + dt.timedelta(days=2)]
    _same(states.features(), want)
    # a day that is written again replaces itself; a snapshot that held it goes
    states.update_day(store, DAY + dt.timedelta(days=3))
    assert len(states.snapshots()) == 2
    _same(states.features(), want)
    more = req.unionByName(make_requests(spark, [("late", "2024-03-02 10:00:00", "/late", 404, "x")] * 3))
    write_parsed_log(more, store)
    states.update_day(store, DAY + dt.timedelta(days=1))
    assert states.snapshots() == [DAY]
    _same(states.features(), features.ip_features_v2(parse.with_null_tokens(more)))
    bulk = daily.FeatureStates(spark, str(tmp_path / "bulk"))
    bulk.write_days(more)
    bulk.write_days(more)
    _same(bulk.features(), states.features())


def test_only_the_new_day_is_read(spark, tmp_path):
    """An update scans one date folder of the requests, and the features only
    the snapshot and later days of the states."""
    store, root = str(tmp_path / "requests"), str(tmp_path / "states")
    req = make_requests(spark, _rows())
    write_parsed_log(req, store)
    states = daily.FeatureStates(spark, root)
    states.write_days(req)
    states.compact(DAY + dt.timedelta(days=3))
    day = DAY + dt.timedelta(days=4)
    new = states.requests_of(store, day)
    assert "PartitionFilters: [isnotnull(date" in _plan(new)
    files = {f.rsplit("date=", 1)[1].split("/")[0] for f in (r[0] for r in new.select(F.input_file_name()).distinct().collect())}
    assert files == {day.isoformat()}
    scans = [x for x in _plan(states.features()).splitlines() if "FileScan parquet" in x]
    by_day = [x for x in scans if "(day#" in x]
    assert len(scans) == 4 and len(by_day) == 2
    assert all("> 2024-03-04)" in x.split("PartitionFilters")[1] for x in by_day), by_day
    files = {r[0] for name in ("paths", "minutes") for r in states.table(name).where(F.col("day") > F.lit(DAY + dt.timedelta(days=3)))
             .select(F.input_file_name()).distinct().collect()}
    assert files and all("day=2024-03-05" in f for f in files)


def test_update_job_day_by_day(spark, tmp_path):
    store, root = str(tmp_path / "requests"), str(tmp_path / "states")
    rows = [r for r in _rows() if r[1]]
    write_parsed_log(make_requests(spark, rows), store)
    states = daily.FeatureStates(spark, root)
    states.update_day(store, DAY)
    for i in range(1, 5):
        day = DAY + dt.timedelta(days=i)
        got = jobs.update_features(spark, store, root, day)
        past = [r for r in rows if r[1] < (day + dt.timedelta(days=1)).isoformat()]
        _same(got, features.ip_features_v2(make_requests(spark, past)))
    assert len(states.snapshots()) == 4


def test_empty_store_and_empty_day(spark, tmp_path):
    store = str(tmp_path / "requests")
    none = make_requests(spark, [("a", "2024-03-01 00:00:00", "/", 200, "x")]).limit(0)
    write_parsed_log(make_requests(spark, [("a", "2024-03-01 00:00:00", "/", 200, "x")]), store)
    states = daily.FeatureStates(spark, str(tmp_path / "states"))
    states.update_day(store, DAY + dt.timedelta(days=9))
    assert states.features().count() == 0 and states.distinct_addresses().first().ips == 0
    assert daily.features_from_states(daily.path_state(none).drop("day"), daily.minute_state(none)).count() == 0


@pytest.mark.parametrize("n", [150, 60_000])
def test_sketches_within_two_percent_for_any_split(spark, tmp_path, n):
    """Union of any grouping of the days stays within 2 % (3.5 standard errors of the bound) of the exact count."""
    ids = spark.range(n * 2).select(F.concat(F.lit("10."), (F.col("id") % n).cast("string")).alias("ip"),
                                    F.timestamp_seconds(1709251200 + (F.xxhash64("id") % 10 + 10) % 10 * 86400).alias("timestamp"))
    sketches = daily.address_sketches(ids).cache()
    assert sketches.count() == 10
    rng = random.Random(n)
    for _ in range(4):
        days = [DAY + dt.timedelta(days=i) for i in rng.sample(range(10), rng.randint(1, 10))]
        mine = F.to_date("timestamp").isin(days)
        exact = ids.where(mine).select("ip").distinct().count()
        cut = rng.randint(0, len(days) - 1)
        part = F.when(F.col("day").isin(days[cut:]), 1).otherwise(0)
        parts = sketches.where(F.col("day").isin(days)).groupBy(part).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))
        got = daily.merge_sketches(parts).first().ips
        assert abs(got - exact) <= 0.02 * exact
    sketches.unpersist()


def test_sketches_of_a_store_by_dates(spark, tmp_path):
    states = daily.FeatureStates(spark, str(tmp_path / "states"))
    req = make_requests(spark, _rows())
    states.write_days(req)
    for first, last in [(None, None), (DAY, DAY), (dt.date(2024, 3, 2), dt.date(2024, 3, 3)), (None, DAY)]:
        ok = F.lit(True)
        if first:
            ok = ok & (F.to_date("timestamp") >= F.lit(first))
        if last:
            ok = ok & (F.to_date("timestamp") <= F.lit(last))
        assert states.distinct_addresses(first, last).first().ips == req.where(ok).agg(F.count_distinct("ip")).first()[0]
