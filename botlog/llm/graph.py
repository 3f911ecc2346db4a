"""Connected components of an edge table by alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", SoCC 2014). Every round is two aggregates with map-side combine and
two equi-joins on pairs of longs; nothing is gathered on the driver but one
row of totals. A node with a third of all edges, and a root with a third of
all nodes, meets its rows in ``PARTS`` tasks, not in one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlog.session import checkpoint_root


#: Parts into which the rows of one key are dealt.
PARTS = 64


def with_least(rows: DataFrame, key: str, value: str, by: str, out: str) -> DataFrame:
    """``rows`` and in ``out`` the smallest ``value`` (nulls aside) of all rows of their ``key``.

    The rows of a key are dealt by ``by`` into ``PARTS``: smallest values are found by part, then
    by key, and joined back by part, so no task sees more of a key than one part of it."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    parts = dealt.groupBy(key, "part").agg(F.min(value).alias("least"))
    least = parts.groupBy(key).agg(F.min("least").alias(out))
    known = parts.select(key, "part").join(least, key)  # at most PARTS rows a key
    return dealt.join(known, [key, "part"]).drop("part")


def _totals(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = with_least(both, "u", "v", "v", "m").where("v > u").select("v", F.least("u", "m").alias("m"))
    return least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The smallest neighbour keeps its edge, the others move to it.
    least = with_least(down, "u", "v", "v", "m")
    return least.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (columns u, v
    of type long; self-loops and nulls are ignored): root is the smallest node
    reachable. Roots themselves are included. Empty edges give no rows."""
    checkpoint_root(edges.sparkSession)
    now = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
           .where("u > v").distinct().checkpoint())
    before = _totals(now)
    while before[0]:
        now = _small_star(_large_star(now)).checkpoint()
        after = _totals(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
