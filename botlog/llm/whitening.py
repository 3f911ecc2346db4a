"""Embedding whitening on integer vectors, with repeated vectors handled once.

An entry c of a vector becomes the long x = floor(1024 c) + 100000. Equal
x-vectors are grouped with their multiplicity, which weighs them in the fit
(or one each, ``multiplicity=False``). All sums and the covariance are those
of the weighted list: sums of x exactly, then one pass that centres every
vector and adds its weighted outer product (a GEMM for each batch, one matrix
a task). Eigenvectors of the covariance are taken on the driver, whose input
is one matrix of dimension x dimension. Every distinct vector is whitened
once and joined back to the rows that hold it.

* Copies collapse map-side before the only shuffle of vectors. The join back
  moves a SHA-256 key of the x-vector and the whitened entries, not vectors. A
  vector held by at least one row in ``HOT`` is joined in ``SALTS`` parts; there
  are at most ``HOT`` such vectors, so their keys may be broadcast.
* Nothing but matrices, sums and these keys is gathered.

Defined results: rows whose vector is null, empty, or holds a null, a NaN, an
infinity or an entry of ``LARGEST`` or more in size do not remain; neither do
vectors of another length than the most frequent one (ties: the longer). Null
and repeated ids are returned as they are, each row on its own. An empty table
gives no rows. A component without variance (at most ``FLAT`` of the trace) has
no whitened value (null), and only the others count in ``identity_error``
(0 when there is none). ``explained`` is 0 when nothing varies. ``deviation``
is exact; where the exact value does not fit a long it is null. Only the id
and vector columns are read, so extra columns of any name change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.llm import common

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
#: Entries of this size or more do not become exact longs; such rows are left out.
LARGEST = float(1 << 40)
#: A component with this share of the trace or less has no variance to divide by.
FLAT = 1e-11
#: Vectors held by a row in HOT or more are joined in SALTS parts.
HOT, SALTS = 256, 64
#: Sums of longs are kept in two limbs of this many bits, so that they stay exact.
_LIMB = 20


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole, before the choice of a length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    return (df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
            .select("id", F.transform("v", lambda c: F.try_add(F.floor(c * SCALE), F.lit(SHIFT).cast("long"))).alias("x")))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(groups: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, sums by dimension) of the weighted vectors (x, w), exactly."""
    def run(batches):
        n, hi, lo = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x, w = _matrix(b.column(0)), b.column(1).to_numpy()
            n += int(w.sum())
            hi += w @ (x >> _LIMB)
            lo += w @ (x & ((1 << _LIMB) - 1))
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim), -1], pa.int32()), pa.array([*hi, n], pa.int64()),
                                          pa.array([*lo, 0], pa.int64())], names=["i", "hi", "lo"])

    wide = "decimal(38,0)"
    rows = (groups.select("x", "w").mapInArrow(run, "i int, hi long, lo long").groupBy("i")
            .agg(F.sum(F.col("hi").cast(wide)).alias("hi"), F.sum(F.col("lo").cast(wide)).alias("lo")).collect())
    at = {r["i"]: (int(r["hi"]) << (0 if r["i"] < 0 else _LIMB)) + int(r["lo"]) for r in rows}
    return at.get(-1, 0), [at.get(i, 0) for i in range(dim)]


def weighted_gram(vectors: DataFrame, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sum over (v, w) of w times the outer product of v - whole - part; the
    centre is given in two parts so that integers are subtracted first."""
    dim = len(part)
    held = vectors.sparkSession.sparkContext.broadcast((whole, part))

    def run(batches):
        first, rest = held.value
        g = np.zeros((dim, dim))
        for b in batches:
            y = (_matrix(b.column(0)) - first) - rest
            g += (y * b.column(1).to_numpy()[:, None]).T @ y
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], names=["i", "j", "g"])

    rows = vectors.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros((dim, dim))
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    out[i, j] = out[j, i] = rows.column("g").to_numpy()
    return out


def principal_axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as
    columns; the largest entry of each is positive."""
    e, u = np.linalg.eigh(covariance)
    e, u = np.maximum(e[::-1][:k], 0.0), u[:, ::-1][:, :k]
    top = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    return e, u * np.where(top < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: list[int], whole: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for every row, exactly; None beyond a long."""
    left = np.array([s - n * int(q) for s, q in zip(sums, whole)], object)
    near = ((x - whole).astype(np.float64) * n - left.astype(np.float64)) ** 2
    safe = near.sum(axis=1) < 2.0 ** 61
    out: list[int | None] = [None] * len(x)
    if safe.any():
        d = n * (x[safe] - whole) - left.astype(np.int64)
        for i, v in zip(np.flatnonzero(safe), (d * d).sum(axis=1)):
            out[i] = int(v)
    for i in np.flatnonzero(~safe):
        v = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums))
        out[i] = v if v < 1 << 63 else None
    return out


def _key(x: str) -> F.Column:
    return F.sha2(F.concat_ws(",", F.col(x).cast("array<string>")), 256)


def _join_back(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Rows (id, key) with the columns of their group (key, w, ...)."""
    hot = F.col("w") * HOT >= n
    heavy = groups.where(hot).select("key", F.lit(True).alias("hot"))
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = rows.join(F.broadcast(heavy), "key", "left").select("id", "key", salt.alias("salt"))
    return left.join(groups.withColumn("salt", F.explode(parts)), ["key", "salt"])


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           multiplicity: bool = True) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for
    every remaining row and component."""
    spark = df.sparkSession
    common.prepare(spark)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    rows = integer_vectors(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("x") == dim)
    groups = common.written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "whitening-groups")
    groups = groups.withColumn("w", F.col("copies") if multiplicity else F.lit(1).cast("long"))

    n, sums = exact_sums(groups, dim)
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    covariance = weighted_gram(groups.select("x", "w"), whole, part) / n
    e, axes = principal_axes(covariance, min(components, dim))
    trace = float(np.trace(covariance))
    live = e > FLAT * trace
    k, use = len(e), int(live.sum())
    scaled = axes[:, :use] / np.sqrt(e[:use])

    held = spark.sparkContext.broadcast((scaled, whole, part, n, sums))

    def run(batches):
        p, first, rest, total, s = held.value
        for b in batches:
            x = _matrix(b.column(1))
            z = ((x - first) - rest) @ p
            at = pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(deviations(x, total, s, first), pa.int64()),
                                              pa.ListArray.from_arrays(at, pa.array(z.ravel()))],
                                             names=["key", "copies", "w", "deviation", "z"])

    white = common.written(groups.select(_key("x").alias("key"), "x", "copies", "w").mapInArrow(
        run, "key string, copies long, w long, deviation long, z array<double>"), "whitening-vectors")
    error = 0.0
    if use:
        mean = np.array(white.agg(*[F.sum(F.col("w") * F.col("z")[i]) / n for i in range(use)]).first())
        error = float(np.abs(weighted_gram(white.select("z", "w"), np.zeros(use), mean) / n - np.eye(use)).max())

    share = [float(v) / trace if trace > 0 else 0.0 for v in e]
    comps = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.col("z")[i] if i < use else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(share[i]).alias("explained")) for i in range(k)])
    total = n if multiplicity else rows_of(white)
    back = _join_back(rows.select("id", _key("x").alias("key")), white.select("key", F.col("copies").alias("w"), "deviation", "z"), total)
    return back.select("id", "deviation", F.inline(comps)).select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"))


def rows_of(groups: DataFrame) -> int:
    """Rows behind the groups."""
    return groups.agg(F.sum("copies")).first()[0]


@common.query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every embedding."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
