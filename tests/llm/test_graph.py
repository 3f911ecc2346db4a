import random
import re

from pyspark.sql import functions as F

from botlog.llm import graph as G


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {x: find(x) for x in list(root)}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    star = [(-5, i) for i in range(100, 900)]
    chain = [(i, i + 1) for i in range(2000, 2060)]
    loose = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(180)]
    edges = star + chain + loose + [(7, 7), (None, 3), (3, None), *star[:5], (chain[0][1], chain[0][0])]
    got = [tuple(r) for r in G.components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)
    assert G.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_hot_key_is_dealt_into_parts(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"),
                                      F.when(F.col("id") > 5, F.col("id")).alias("v"), F.col("id").alias("i"))
    out = G.with_least(rows, "k", "v", "i", "m")
    assert out.columns == ["k", "v", "i", "m"]
    got = {(r.k, r.i): r.m for r in out.collect()}
    assert len(got) == 20_000 and {m for (k, _), m in got.items() if k == 1} == {6}
    assert got[5, 5] is None and got[7, 7] == 7
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # a large table's plan: the rows themselves are only ever dealt by key and part
        plan = G.with_least(rows, "k", "v", "i", "m")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    lines = [x for x in plan.split("\n") if "hashpartitioning(" in x]
    dealt = [re.search(r"hashpartitioning\(([^)]*?), \d+\)", x)[1] for x in lines]
    assert any("part#" in x for x in dealt) and re.search(r"SortMergeJoin \[k#\d+L?, part#\d+L?\]", plan)
