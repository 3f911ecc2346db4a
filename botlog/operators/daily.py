"""Feature states kept by day: new requests are aggregated once, and the
per-address features of all history come from the stored aggregates.

A store under one root folder holds, partitioned by UTC day,

* ``paths``: one row per (day, ip, path) with request and status counts,
* ``minutes``: one row per (day, ip, minute) with the request count and the
  mask of used seconds,
* ``addresses``: one HLL sketch of the day's distinct addresses.

All three merge under any split of the requests (sums, maxima, bit-or, sketch
union), so a day's rows are computed from that day's requests alone, and
writing a day again replaces it (safe to repeat after a failure).

A snapshot folds all days up to one of them: ``paths`` per (ip, path) and
``runs`` per address (first and last second, requests, minutes, busiest minute,
sum of squared gaps). A run of history and the minutes of later days merge
exactly, since days do not overlap; so the daily cost is the new days' states
and one row per address and path, whatever the length of the history. Changing
a day inside a snapshot drops that snapshot first.

Requests without a time stamp have no day; they are a partition of their own,
counted in the path features and never folded.

No step gathers rows: every merge is a grouped aggregate with map-side combine
on (ip, path), (ip, minute) or ip over rows that are already aggregated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.operators import features, parse
from botlog.session import ensure_utc
from botlog.sources.files import REQUEST_SCHEMA

#: Log2 of the sketch's buckets: relative standard error 1.04 / sqrt(2^15) = 0.57 %, at most 32 kB a day.
SKETCH_LG_K = 15

_COUNTS = "c long, n4 long, ua int, n5 long, n3 long, nl long"
_RUNS = "n_ts long, n_min long, max_rpm long, first long, last long, ssq decimal(38,0)"
_SCHEMAS = {
    "paths": f"ip string, path string, {_COUNTS}, day date",
    "minutes": "ip string, minute long, c long, mask long, day date",
    "addresses": "sketch binary, day date",
}


def _day_of(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts / 86400).cast("int"))


def path_state(requests: DataFrame) -> DataFrame:
    """(day, ip, path, counts) of post-CSV requests."""
    t = features.request_traits(requests).withColumn("day", _day_of(F.col("ts")))
    return features.path_groups(t, by=("day", "ip", "path"))


def minute_state(requests: DataFrame) -> DataFrame:
    """(day, ip, minute, c, mask) of post-CSV requests with a time stamp."""
    t = features.request_traits(requests).withColumn("day", _day_of(F.col("ts")))
    return features.minute_masks(t, by=("day", "ip", "minute"))


def address_sketches(requests: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(day, sketch) of the distinct addresses of each day."""
    t = requests.filter(F.col("ip").isNotNull())
    return t.groupBy(_day_of(F.unix_seconds("timestamp")).alias("day")).agg(F.hll_sketch_agg("ip", F.lit(lg_k)).alias("sketch"))


def merge_paths(states: DataFrame) -> DataFrame:
    """One row per (ip, path) from any number of partial ones."""
    return states.groupBy("ip", "path").agg(*[(F.max if c == "ua" else F.sum)(c).alias(c) for c in ("c", "n4", "ua", "n5", "n3", "nl")])


def merge_minutes(states: DataFrame) -> DataFrame:
    """One row per (ip, minute) from any number of partial ones."""
    return states.groupBy("ip", "minute").agg(F.sum("c").alias("c"), F.bit_or("mask").alias("mask"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row ``ips``: distinct addresses of all the sketched days, about."""
    union = F.hll_union_agg("sketch", F.lit(False))
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(union), F.lit(0)).cast("long").alias("ips"))


def features_from_states(paths: DataFrame, minutes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The v2 feature table of partial states; ``runs`` are merged runs of
    times before all of ``minutes``."""
    now = features.runs_of_minutes(merge_minutes(minutes))
    if runs is not None:
        now = now.unionByName(runs.select(*now.columns))
    return features.join_v2(features.path_totals(merge_paths(paths)), features.run_stats(features.merge_runs(now)))


class FeatureStates:
    """The daily states under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        ensure_utc(spark)
        self.spark, self.root = spark, root.rstrip("/")

    # --- writing -----------------------------------------------------------

    def _states(self, requests: DataFrame) -> dict[str, DataFrame]:
        r = parse.with_null_tokens(requests)
        return {"paths": path_state(r), "minutes": minute_state(r), "addresses": address_sketches(r)}

    def write_days(self, requests: DataFrame) -> None:
        """States of all days that ``requests`` holds in full; days that it
        does not hold are left as they are."""
        if self.snapshots():
            self._drop_snapshots(requests.agg(F.min(F.to_date("timestamp"))).first()[0])
        for name, state in self._states(requests).items():
            # a few files a day, with a busy day or address dealt over all of them
            part = F.pmod(F.xxhash64(*[c for c in ("ip", "path", "minute", "sketch") if c in state.columns]), F.lit(self._files()))
            (state.repartition("day", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("day").parquet(f"{self.root}/{name}"))

    def update_day(self, requests_path: str, day: dt.date | None) -> None:
        """(Re)writes one day's states from the date-partitioned request store
        at ``requests_path``, reading that day's folder only. None: the
        requests without a time stamp."""
        self._drop_snapshots(day)
        folder = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
        for name, state in self._states(self.requests_of(requests_path, day)).items():
            state.drop("day").write.mode("overwrite").parquet(f"{self.root}/{name}/day={folder}")

    def requests_of(self, requests_path: str, day: dt.date | None) -> DataFrame:
        """The stored requests of one day (partition-pruned)."""
        stored = self.spark.read.schema(REQUEST_SCHEMA).parquet(requests_path)
        mine = F.col("date").isNull() if day is None else F.col("date") == F.lit(day)
        return stored.filter(mine).select(*REQUEST_SCHEMA.fieldNames())

    def compact(self, through: dt.date) -> None:
        """Folds all days up to ``through`` into a snapshot, starting from the
        latest earlier one."""
        before = max((s for s in self.snapshots() if s < through), default=None)
        old = self._snapshot(before)
        upto = F.col("day") <= F.lit(through)
        if before is not None:
            upto = upto & (F.col("day") > F.lit(before))
        paths = self.table("paths").filter(upto).drop("day")
        runs = features.runs_of_minutes(merge_minutes(self.table("minutes").filter(upto)))
        if old:
            paths = paths.unionByName(old["paths"])
            runs = runs.unionByName(old["runs"].select(*runs.columns))
        base = f"{self.root}/snapshots/through={through.isoformat()}"
        merge_paths(paths).write.mode("overwrite").parquet(f"{base}/paths")
        features.merge_runs(runs).write.mode("overwrite").parquet(f"{base}/runs")

    # --- reading -----------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """One of the state tables, all days."""
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def features(self) -> DataFrame:
        """v2 features of all history: the latest snapshot and the days after it."""
        through = max(self.snapshots(), default=None)
        paths, minutes = self.table("paths"), self.table("minutes")
        if through is None:
            return features_from_states(paths.drop("day"), minutes)
        snap = self._snapshot(through)
        later = F.col("day") > F.lit(through)
        return features_from_states(paths.filter(later | F.col("day").isNull()).drop("day").unionByName(snap["paths"]),
                                    minutes.filter(later), snap["runs"])

    def distinct_addresses(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """One row ``ips``: distinct addresses between two days (both
        included, either may be open), from the sketches alone."""
        s = self.table("addresses")
        if first is not None:
            s = s.filter(F.col("day") >= F.lit(first))
        if last is not None:
            s = s.filter(F.col("day") <= F.lit(last))
        return merge_sketches(s)

    # --- snapshots ---------------------------------------------------------

    def _folder(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def snapshots(self) -> list[dt.date]:
        """Days that a complete snapshot runs through."""
        fs, p = self._folder(f"{self.root}/snapshots")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(self._folder(f"{self.root}/snapshots/{n}/runs/_SUCCESS")[1])]
        return sorted(dt.date.fromisoformat(n.split("=", 1)[1]) for n in done if n.startswith("through="))

    def _snapshot(self, through: dt.date | None) -> dict[str, DataFrame]:
        if through is None:
            return {}
        base = f"{self.root}/snapshots/through={through.isoformat()}"
        return {"paths": self.spark.read.schema(f"ip string, path string, {_COUNTS}").parquet(f"{base}/paths"),
                "runs": self.spark.read.schema(f"ip string, {_RUNS}").parquet(f"{base}/runs")}

    def _drop_snapshots(self, day: dt.date | None) -> None:
        """Snapshots that hold ``day`` are no longer true once it changes."""
        for s in self.snapshots():
            if day is not None and s >= day:
                fs, p = self._folder(f"{self.root}/snapshots/through={s.isoformat()}")
                fs.delete(p, True)

    def _files(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
