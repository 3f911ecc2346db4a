"""Global order statistics without a single-task pass over the rows.

``Window.orderBy`` with no partition pulls every row into one task, and the
exact ``percentile`` aggregate keeps every distinct value in one buffer.
Both are avoided here, in the same way at every size:

1. collapse to one row per distinct value (partial aggregation),
2. range-partition these rows by value, sort inside the partitions and store
   them; the partition number is the bucket, so buckets are balanced by Spark's
   range sampling,
3. one aggregate gives the totals of each bucket (one row per bucket and group,
   collected),
4. running totals inside each bucket start from the sum of the earlier buckets:
   one streaming pass over the stored partitions as they lie, without a
   shuffle, window or join, and with a state of one row of totals.

The result is exact; the sampling only balances the buckets. Distinct values
are never tied across buckets, so no bucket outgrows its range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.session import checkpoint_root


def prefix_counts(df: DataFrame, value: str, counts: dict[str, object], descending: bool = False,
                  n_buckets: int | None = None, by=()) -> DataFrame:
    return prefix_counts_with_totals(df, value, counts, descending, n_buckets, by)[0]


def prefix_counts_with_totals(df: DataFrame, value: str, counts: dict[str, object], descending: bool = False,
                              n_buckets: int | None = None, by=(), neighbours: bool = False) -> tuple[DataFrame, dict]:
    """One row per distinct (``by``..., ``value``) with its summed ``counts``
    (name -> column expression) and ``cum_<name>``: the running total over
    the rows of the same ``by`` group whose value comes before or equals this
    one in the chosen order. With ``neighbours`` also ``below_<name>``: the
    counts of the next smaller value of the group (null for the smallest).

    Returns the prefix table and the grand totals (``_distinct`` and each
    count; with ``by``, also ``_groups``: group key tuple -> totals, so ``by``
    is meant for a few classes).

    ``n_buckets`` fixes the number of range partitions; by default it is
    ``spark.sql.shuffle.partitions``."""
    names, by = list(counts), list(by)
    spark = df.sparkSession
    checkpoint_root(spark)
    nb = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
         .agg(*[F.sum(expr).cast("long").alias(n) for n, expr in counts.items()])
         .repartitionByRange(nb, value).sortWithinPartitions(*by, value)
         .withColumn("_b", F.spark_partition_id()).checkpoint(eager=True))
    last = F.max_by(F.struct(*names), F.col(value)).alias("_last")
    rows = g.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_distinct"), *[F.sum(n).alias(n) for n in names], last).collect()

    keys = ["_distinct", *names]
    groups: dict[tuple, dict] = {}
    start: dict[tuple, list[int]] = {}   # (group, bucket) -> totals of the group's earlier buckets
    below: dict[tuple, list] = {}        # (group, bucket) -> counts of the group's last row before it
    ends: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["_b"]):
        grp = tuple(r[b] for b in by)
        tot = groups.setdefault(grp, dict.fromkeys(keys, 0))
        start[grp, r["_b"]] = [tot[n] for n in names]
        below[grp, r["_b"]] = ends.get(grp, [None] * len(names))
        ends[grp] = [r["_last"][n] for n in names]
        for k in keys:
            tot[k] += r[k] or 0
    grand = {k: sum(t[k] for t in groups.values()) for k in keys}
    if by:
        grand["_groups"] = groups
    whole = {grp: [t[n] for n in names] for grp, t in groups.items()}

    out = [*[g.schema[c] for c in [*by, value, *names]], *[T.StructField(f"cum_{n}", T.LongType()) for n in names]]
    if neighbours:
        out += [T.StructField(f"below_{n}", T.LongType()) for n in names]
    columns, width = [f.name for f in out], len(names)

    def run(batches):
        at = None
        for b in batches:
            grps = list(zip(*[b.column(i).to_pylist() for i in range(len(by))])) if by else [()] * b.num_rows
            buckets = b.column(b.num_columns - 1).to_pylist()
            own = [b.column(len(by) + 1 + j).to_numpy(zero_copy_only=False) for j in range(width)]
            cum = [np.empty(b.num_rows, np.int64) for _ in names]
            low: list[list] = [[None] * b.num_rows for _ in names]
            i = 0
            while i < b.num_rows:
                k = i + 1
                while by and k < b.num_rows and grps[k] == grps[i]:
                    k += 1
                k = k if by else b.num_rows
                key = (grps[i], buckets[i])
                if key != at:
                    at, carry, before = key, list(start[key]), list(below[key])
                for j in range(width):
                    upto = np.cumsum(own[j][i:k]) + carry[j]
                    cum[j][i:k] = whole[grps[i]][j] - upto + own[j][i:k] if descending else upto
                    low[j][i:k] = [before[j], *own[j][i:k - 1].tolist()]
                    carry[j], before[j] = int(upto[-1]), int(own[j][k - 1])
                i = k
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *[pa.array(c) for c in cum], *([pa.array(c, pa.int64()) for c in low] if neighbours else [])], names=columns)

    return g.mapInArrow(run, T.StructType(out)), grand


def _lerp(a: float, b: float, t: float) -> float:
    # linear interpolation between neighbouring order statistics, evaluated
    # from the nearer end as numpy's "linear" percentile method does
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def exact_percentiles(df: DataFrame, value: str, probs, n_buckets: int | None = None) -> list[float | None]:
    """Exact linearly interpolated percentiles (fractions in [0, 1]) of a
    column, nulls ignored. Returns one float per probability (None when the
    column has no values). Only the few order statistics needed reach the
    driver."""
    pc, totals = prefix_counts_with_totals(df, value, {"c": F.lit(1).cast("long")}, n_buckets=n_buckets)
    return percentiles_from_prefix(pc, value, totals["c"], probs)


def percentiles_from_prefix(pc: DataFrame, value: str, n: int, probs) -> list[float | None]:
    """Percentiles from a prefix table with ``c`` / ``cum_c`` (ascending)
    over ``n`` rows."""
    if not n:
        return [None for _ in probs]
    plan = []
    for p in probs:
        pos = float(p) * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        plan.append((lo, hi, pos - lo))
    ranks = sorted({r for lo, hi, _ in plan for r in (lo, hi)})
    at = dict(zip(ranks, _pick_ranks(pc, value, ranks)))
    return [_lerp(float(at[lo]), float(at[hi]), t) for lo, hi, t in plan]


def _pick_ranks(pc: DataFrame, value: str, ranks) -> list:
    cond = None
    for r in ranks:
        term = (F.col("cum_c") - F.col("c") <= r) & (F.lit(r) < F.col("cum_c"))
        cond = term if cond is None else cond | term
    rows = pc.filter(cond).select(value, "c", "cum_c").collect()
    out = []
    for r in ranks:
        hit = [row[value] for row in rows if row["cum_c"] - row["c"] <= r < row["cum_c"]]
        out.append(hit[0] if hit else None)
    return out


def order_statistics(df: DataFrame, value: str, ranks, n_buckets: int | None = None) -> list:
    """The values at 0-based ``ranks`` of ``value`` in ascending order (nulls
    ignored); None for a rank past the end."""
    pc = prefix_counts(df, value, {"c": F.lit(1).cast("long")}, n_buckets=n_buckets)
    return _pick_ranks(pc, value, list(ranks))


def order_statistics_by(df: DataFrame, by: str, value: str, ranks_for, n_buckets: int | None = None) -> dict:
    """Per group of ``by``: the values at 0-based ranks of ``value``
    (ascending). ``ranks_for(group_value, n_rows)`` gives the ranks of a
    group from its size. One pass for all groups."""
    pc, grand = prefix_counts_with_totals(df, value, {"c": F.lit(1).cast("long")}, n_buckets=n_buckets, by=[by])
    wanted = {key[0]: list(ranks_for(key[0], t["c"])) for key, t in grand["_groups"].items()}
    cond = F.lit(False)
    for grp, ranks in wanted.items():
        for r in ranks:
            cond = cond | ((F.col(by) == F.lit(grp)) & (F.col("cum_c") - F.col("c") <= r) & (F.lit(r) < F.col("cum_c")))
    rows = pc.filter(cond).select(by, value, "c", "cum_c").collect()
    out = {}
    for grp, ranks in wanted.items():
        vals = []
        for r in ranks:
            hit = [row[value] for row in rows
                   if row[by] == grp and row["cum_c"] - row["c"] <= r < row["cum_c"]]
            vals.append(hit[0] if hit else None)
        out[grp] = vals
    return out
