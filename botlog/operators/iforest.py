"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) as Spark jobs.

fit
  1. Sample: tree t takes the ``psi`` rows with the smallest md5 hash of id,
     seed and tree (sampling without replacement, independent of partitioning,
     and computable by any engine). Each task keeps the ``psi`` smallest of
     every tree in a bounded buffer; the buffers of all tasks merge by the
     same rule.
  2. Grow: ``groupBy(tree).applyInPandas`` builds each tree from its
     ``psi`` rows (sorted by hash, numpy generator seeded by (seed, tree)):
     random non-constant feature, uniform threshold between its min and max,
     depth limit ceil(log2 psi). One task per tree.
  3. The node table (at most trees * (2 psi - 1) rows) is collected.

score
  The node arrays are broadcast and a vectorised ``pandas_udf`` walks all
  trees for an Arrow batch of rows at once:
  h(x) = leaf depth + c(leaf size), score_samples = -2^(-mean h / c(psi)).

cut
  offset = exact ``contamination`` percentile of score_samples;
  anomaly_score = score_samples - offset (lower = more anomalous),
  is_anomaly = anomaly_score < 0.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.operators.ranking import exact_percentiles
from botlog.session import ship_package

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
])


def average_path_length(n):
    """c(n): average path length of an unsuccessful search in a BST of n."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def grow_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size, depth) of one
    isolation tree over the rows of X; leaves have feature = left = right = -1."""
    nodes: list[list] = []
    stack = [(np.arange(X.shape[0]), 0, 0)]
    nodes.append(None)
    while stack:
        idx, depth, nid = stack.pop()
        size = idx.shape[0]
        leaf = [nid, -1, 0.0, -1, -1, size, depth]
        if depth >= max_depth or size <= 1:
            nodes[nid] = leaf
            continue
        Xn = X[idx]
        lo, hi = Xn.min(axis=0), Xn.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            nodes[nid] = leaf
            continue
        f = int(candidates[rng.integers(candidates.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:
            thr = float(lo[f])
        go_left = Xn[:, f] <= thr
        left_id, right_id = len(nodes), len(nodes) + 1
        nodes.extend([None, None])
        nodes[nid] = [nid, f, thr, left_id, right_id, size, depth]
        stack.append((idx[~go_left], depth + 1, right_id))
        stack.append((idx[go_left], depth + 1, left_id))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    features: list[str]
    psi: int
    n_trees: int
    seed: int
    nodes: pd.DataFrame = field(repr=False)

    @property
    def max_depth(self) -> int:
        return int(math.ceil(math.log2(max(self.psi, 2))))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def _arrays(self):
        nd = self.nodes.sort_values(["tree", "node"])
        width = int(nd.groupby("tree")["node"].max().max()) + 1
        shape = (self.n_trees, width)
        out = {k: np.full(shape, -1, dtype=np.int32) for k in ("feature", "left", "right", "size", "depth")}
        out["threshold"] = np.zeros(shape, dtype=np.float64)
        t, n = nd["tree"].to_numpy(), nd["node"].to_numpy()
        for k in ("feature", "left", "right", "size", "depth"):
            out[k][t, n] = nd[k].to_numpy()
        out["threshold"][t, n] = nd["threshold"].to_numpy()
        out["leaf_len"] = out["depth"] + average_path_length(np.maximum(out["size"], 0))
        out["c_psi"] = float(average_path_length([self.psi])[0])
        out["steps"] = self.max_depth + 1
        return out

    def score_samples(self, df: DataFrame, output: str = "score_samples") -> DataFrame:
        """Adds ``output``: minus the anomaly score of the paper (higher =
        more normal), computed by a vectorised pandas UDF."""
        spark = df.sparkSession
        ship_package(spark)
        bc = spark.sparkContext.broadcast(self._arrays())

        @F.pandas_udf(T.DoubleType())
        def _score(*cols: pd.Series) -> pd.Series:
            a = bc.value
            X = np.column_stack([c.to_numpy(dtype=np.float64, na_value=0.0) for c in cols])
            n = X.shape[0]
            rows = np.arange(n)
            total = np.zeros(n)
            for t in range(a["feature"].shape[0]):
                feat, thr, left, right = a["feature"][t], a["threshold"][t], a["left"][t], a["right"][t]
                node = np.zeros(n, dtype=np.int64)
                for _ in range(a["steps"]):
                    f = feat[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    x = X[rows, np.where(inner, f, 0)]
                    nxt = np.where(x <= thr[node], left[node], right[node])
                    node = np.where(inner, nxt, node)
                total += a["leaf_len"][t][node]
            mean_h = total / a["feature"].shape[0]
            return pd.Series(-np.power(2.0, -mean_h / a["c_psi"]) if a["c_psi"] > 0 else -np.ones(n))

        return df.withColumn(output, _score(*[F.col(c).cast("double") for c in self.features]))


def tree_hashes(ids, n_trees: int, seed: int) -> np.ndarray:
    """rows x trees: 52 bits of ``md5(id:seed:pair)``, where trees 2p and
    2p + 1 take hexadecimal digits 1-13 and 14-26 of the digest of pair p."""
    pairs = [f":{seed}:{p}".encode() for p in range((n_trees + 1) // 2)]
    out = np.empty((len(ids), 2 * len(pairs)), dtype=np.int64)
    for i, x in enumerate(ids):
        start = hashlib.md5(str(x).encode())
        for p, tail in enumerate(pairs):
            h = start.copy()
            h.update(tail)
            v = int.from_bytes(h.digest()[:13], "big")
            out[i, 2 * p], out[i, 2 * p + 1] = v >> 52, v & ((1 << 52) - 1)
    return out[:, :n_trees]


def bottom_k(df: DataFrame, id_col: str, features, n_trees: int, k: int, seed: int) -> DataFrame:
    """(tree, h, id, features): for each tree the ``k`` rows with the smallest
    hash (ties by id), all rows where there are fewer.

    Every task keeps a buffer of k rows for each tree and drops what is beyond
    it after each batch, so its state is trees x k rows however many rows it
    reads, and at most that leaves the task. Buffers merge by the same rule (a
    rank that streams over sorted rows and stops at k); no count or threshold
    is needed."""
    features = list(features)
    ship_package(df.sparkSession)
    fields = [T.StructField("tree", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField(id_col, T.StringType()),
              *[T.StructField(f, T.DoubleType()) for f in features]]

    def run(batches):
        # per tree: ascending hashes, and where their rows are among the kept ones
        kept_ids, kept_x = np.empty(0, object), np.empty((0, len(features)))
        buffers = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n_trees)]
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]) if features else np.empty((len(ids), 0))
            hashes = tree_hashes(ids, n_trees, seed)
            kept_ids, kept_x = np.concatenate([kept_ids, ids]), np.concatenate([kept_x, x])
            base, used = len(kept_ids) - len(ids), np.zeros(len(kept_ids), bool)
            for t, (h, rows) in enumerate(buffers):
                new = np.arange(len(ids)) if len(h) < k else np.flatnonzero(hashes[:, t] <= h[-1])
                if len(new):
                    h, rows = np.concatenate([h, hashes[new, t]]), np.concatenate([rows, new + base])
                    order = np.argsort(h, kind="stable")
                    if (np.diff(h[order]) == 0).any():
                        order = np.array(sorted(order, key=lambda i: (h[i], kept_ids[rows[i]].encode())))
                    h, rows = h[order[:k]], rows[order[:k]]
                    buffers[t] = (h, rows)
                used[rows] = True
            place = np.cumsum(used) - 1
            kept_ids, kept_x = kept_ids[used], kept_x[used]
            buffers = [(h, place[rows]) for h, rows in buffers]
        for t, (h, rows) in enumerate(buffers):
            if len(h):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), t), pa.int32()), pa.array(h), pa.array(kept_ids[rows], pa.string()),
                     *[pa.array(kept_x[rows, j]) for j in range(len(features))]], names=[f.name for f in fields])

    local = (df.select(F.col(id_col).cast("string").alias(id_col), *[F.col(c).cast("double").alias(c) for c in features])
             .filter(F.col(id_col).isNotNull()).mapInArrow(run, T.StructType(fields)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", id_col))
    return local.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def fit_isolation_forest(df: DataFrame, features, id_col: str = "ip", n_trees: int = 100,
                         max_samples: int = 256, seed: int = 42) -> IsolationForestModel:
    """Fit on the rows of ``df`` (one per entity, ``id_col`` unique and not
    null), which is read once."""
    features = list(features)
    schema_fields = list(NODE_SCHEMA.fields)
    sample = bottom_k(df, id_col, features, n_trees, max_samples, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["h", id_col])
        X = pdf[features].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, t])
        rows = grow_tree(X, rng, int(math.ceil(math.log2(max(len(X), 2)))))
        out = pd.DataFrame(rows, columns=[f.name for f in schema_fields[1:]])
        out.insert(0, "tree", t)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int32", "depth": "int32"})

    nodes = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    if nodes.empty:
        raise ValueError("cannot fit an isolation forest on an empty table")
    # every tree holds all rows or max_samples of them
    psi = int(nodes.loc[nodes["node"] == 0, "size"].iloc[0])
    return IsolationForestModel(features, psi, n_trees, seed, nodes)


def score(model: IsolationForestModel, df: DataFrame, contamination: float = 0.05,
          raw_col: str = "score_samples", materialize: bool = True) -> DataFrame:
    """Adds ``score_samples``, ``anomaly_score`` and ``is_anomaly``.

    The cut needs every score before any label, so the scored table is read
    twice; with ``materialize`` it is checkpointed to the shared checkpoint
    folder once, so the Python scorer runs once per row and lineage is cut."""
    scored = model.score_samples(df, raw_col)
    if materialize:
        scored = scored.checkpoint(eager=True)
    offset = exact_percentiles(scored, raw_col, [contamination])[0]
    return apply_offset(scored, offset, raw_col)


def apply_offset(scored: DataFrame, offset: float, raw_col: str = "score_samples") -> DataFrame:
    a = F.col(raw_col) - F.lit(float(offset))
    return scored.withColumn("anomaly_score", a).withColumn("is_anomaly", (a < 0).cast("int"))
