"""Plan-shape checks: no row-at-a-time Python, Python only in the model
operators, no whole-table single-partition window."""
from pyspark.sql import functions as F

from botlog.operators import evaluate, features, marts
from botlog.plans import catalog
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_is_native(spark):
    p = _plan(features.ip_features_v2(catalog.requests_n(spark, SF_SMALL)))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "FlatMapGroupsInPandas" not in p


def test_scan_is_pruned(spark, tmp_path):
    """Features over a stored request table read only the five columns they use."""
    from botlog.sources import read_parsed_log, write_parsed_log
    out = str(tmp_path / "req")
    write_parsed_log(catalog.requests(spark, SF_SMALL), out)
    df = features.ip_features_v2(read_parsed_log(spark, out))
    df.collect()
    scans = [line for line in _plan(df).splitlines() if "FileScan parquet" in line]
    assert scans
    for line in scans:
        schema = line.split("ReadSchema: ")[1]
        for col in ("method", "protocol", "bytes_sent", "referrer", "tz_offset"):
            assert col not in schema, (col, schema)


def test_marts_have_no_python(spark):
    req = catalog.requests_n(spark, SF_SMALL)
    sus = marts.suspicious_ips(catalog.deterministic_scores(spark, SF_SMALL))
    for df in (marts.traffic_over_time(req, sus), marts.ua_stats(req, sus), marts.path_abuse(req, sus)):
        p = _plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_prefix_pass_moves_nothing(spark):
    ev = spark.createDataFrame([(i % 2, 0, float(i % 97)) for i in range(2000)], "y_true int, y_pred int, score double")
    st = evaluate._score_table(ev, n_buckets=4)
    st.collect()
    p = _plan(st)
    # the stored range partitions are read as they lie: no window, join or
    # shuffle of any kind, and the totals of four buckets came from one aggregate
    assert "MapInArrow" in p and "Scan ExistingRDD" in p
    for op in ("Window", "Exchange", "Join", "CartesianProduct", "Sort"):
        assert op not in p, p


def _ip_only_exchange_children(plan: str):
    """For every exchange hash-partitioned on the address alone, the first
    real operator below it."""
    import re
    lines = plan.splitlines()
    skip = ("Project", "Filter", "InputAdapter", "WholeStageCodegen", "AQEShuffleRead", "ShuffleQueryStage",
            "ColumnarToRow")
    out = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(ip#\d+, \d+\)", line):
            for nxt in lines[i + 1:]:
                op = nxt.strip().lstrip(":+- *").lstrip("(0123456789) ")
                if not op.startswith(skip):
                    out.append(op.split("(")[0].split(" ")[0])
                    break
    return out


def test_no_raw_rows_shuffled_by_address_alone(spark):
    """Skew safety of the feature plan: a hot address reaches an ip-keyed
    exchange only as partially aggregated rows."""
    df = features.ip_features_v2(catalog.requests_n(spark, SF_SMALL))
    df.collect()
    kids = _ip_only_exchange_children(_plan(df))
    assert kids, "expected ip-keyed exchanges"
    assert all(k in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") for k in kids), kids


def _single_partition_children(plan: str):
    lines = plan.splitlines()
    skip = ("Project", "Filter", "InputAdapter", "WholeStageCodegen", "AQEShuffleRead", "ShuffleQueryStage")
    bare = lambda x: x.strip().lstrip(":+- *").lstrip("(0123456789) ")
    return [next(bare(x) for x in lines[i + 1:] if not bare(x).startswith(skip))
            for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


def test_ranking_queries_as_registered_have_no_single_task_pass(spark):
    """Without forced buckets, only totals meet in one partition."""
    for key in ("roc_auc", "roc_curve", "contamination_sweep"):
        df = catalog.all_queries()[key](spark, SF_SMALL)
        df.collect()
        for child in _single_partition_children(_plan(df)):
            assert child.startswith("HashAggregate") and ("keys=[_b" in child or "keys=[]" in child), (key, child)


def test_buckets_stay_balanced_with_ties_and_skew(spark):
    """Half of all rows share one value; distinct values spread over the buckets."""
    from botlog.operators.ranking import prefix_counts
    rows = spark.range(20000).selectExpr("case when id % 2 = 0 then 7.0 else cast(id as double) / 3 end as v")
    pc = prefix_counts(rows, "v", {"c": F.lit(1).cast("long")}, n_buckets=8)
    assert pc.agg(F.max("cum_c")).first()[0] == 20000
    sizes = (rows.groupBy("v").count().repartitionByRange(8, "v").groupBy(F.spark_partition_id()).count()
             .agg(F.max("count")).first()[0])
    assert sizes < 2 * 10001 / 8


def test_one_parse_for_features_and_marts(spark):
    """Queries that read the requests more than once scan the stored table, not the raw lines."""
    for key in ("ip_features_v2", "traffic_over_time", "ua_stats", "path_abuse"):
        p = _plan(catalog.all_queries()[key](spark, SF_SMALL))
        assert "regexp_replace" not in p and "events.parquet" not in p, key
