"""Near-duplicate vectors by collision-counting projections.

Vectors of one label are compared by cosine. Every unit vector is projected
on ``N_PROJECTIONS`` random directions. Two vectors whose cosine reaches the
threshold fall close together on most of them: sorted on one projection, the
window centred on a vector's value holds its partner with a known
probability. A pair is verified, in double precision, when it collides in at
least ``needed_collisions`` windows; that count is calibrated so that a pair
exactly at the threshold passes with probability ``RECALL``, and pairs above
it more often.

Equal vectors are one row from the start. The rows of a label are dealt into
tiles of bounded size by hash, and every two tiles meet in a task of their
own: a label that holds a third of all rows is many small tasks. A task
returns counts of links per vector and one edge from each vector to the root
of the component it saw,
never all pairs of a dense group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common
from botlog.llm.graph import components, with_least

N_PROJECTIONS = 32
#: Half width of a window, in units of the projected distance at the threshold.
WINDOW = 1.6
#: Least probability that a pair at the threshold is verified.
RECALL = 0.995
#: Rows of a tile; a task holds two.
TILE = 2048


def needed_collisions(m: int = N_PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability
    ``recall``: its projected differences are normal with the threshold's
    distance as deviation, so collisions are binomial."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p ** k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def directions(dim: int, m: int = N_PROJECTIONS, seed: int = 42) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((m, dim))


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of pairs of raw vectors with cosine >= threshold
    that pass the collision count; i < j where ``same``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    half = WINDOW * math.sqrt(max(0.0, 2 - 2 * threshold))
    need, r = needed_collisions(), directions(a.shape[1])
    pa_, pb = (a / na[:, None]) @ r.T, (b / nb[:, None]) @ r.T
    order = np.argsort(pb, axis=0, kind="stable")
    out_i, out_j = [], []
    step = max(1, (4 << 20) // max(1, len(b)))
    for lo in range(0, len(a), step):
        q = pa_[lo:lo + step]
        count = np.zeros((len(q), len(b)), np.uint8)
        for k in range(r.shape[0]):
            col = pb[order[:, k], k]
            first = np.searchsorted(col, q[:, k] - half, "left").astype(np.int32)
            last = np.searchsorted(col, q[:, k] + half, "right").astype(np.int32)
            place = np.empty(len(b), np.int32)
            place[order[:, k]] = np.arange(len(b), dtype=np.int32)
            count += (place >= first[:, None]) & (place < last[:, None])
        i, j = np.nonzero(count >= need)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 18):
            x, y = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
            good = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            out_i.append(x[good])
            out_j.append(y[good])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component in the graph of pairs (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, e, node): e in double precision with one zero; node is a
    hash of label and vector, null for vectors that link with nothing."""
    e = F.col("e")
    usable = (F.col("label").isNotNull() & e.isNotNull() & (F.size("e") > 0)
              & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
              & F.exists("e", lambda x: x != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(
        F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"))
    return rows.withColumn("node", F.when(usable, F.xxhash64("label", "e")))


def vector_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    n_links counts the other rows of the label with cosine >= threshold,
    copies included; component_id is the smallest id reachable. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows
    without a label, link with nothing and are their own component. Vectors
    of different lengths never link. Rows with a null id take part; a row
    alone keeps its own id, null or not, as its component, and kept says that
    the id is its component's (null counts as equal to null). Rows that repeat
    an id each get a row. Other columns are not read; an empty table gives no
    rows."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = _keyed(vectors, id_col, vector_col, label_col)
    classes = common.written(rows.where("node is not null").groupBy("label", "e", "node")
                             .agg(F.min("id").alias("rep"), F.count("*").alias("n"))
                             .withColumn("dim", F.size("e")), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = (classes.join(sizes, ["label", "dim"])
             .withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("label", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     "own", "node", "n", "e"))
    out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        x = group["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        own, node, n = (group[c].to_numpy() for c in ("own", "node", "n"))
        ia, ib = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        i, j = linked_pairs(x[ia], x[ib], threshold, lo == hi) if len(ia) and len(ib) else (ia[:0], ib[:0])
        i, j = ia[i], ib[j]
        links = np.bincount(i, weights=n[j], minlength=len(node)) + np.bincount(j, weights=n[i], minlength=len(node))
        root, at = _roots(i, j, len(node)), np.flatnonzero(links)
        held = at[root[at] != at]
        return pa.table([np.concatenate([node[at], node[held]]), np.concatenate([node[at], node[root[held]]]),
                         np.concatenate([links[at].astype(np.int64), np.zeros(len(held), np.int64)])], schema=out)

    found = common.written(dealt.groupBy("label", "dim", "lo", "hi").applyInArrow(compare, "u long, v long, links long"),
                           "vector-links")
    roots = components(found.where("u <> v").select("u", "v"))
    linked = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    rooted = (classes.select("node", "rep", "n").join(roots, "node", "left").join(linked, "node", "left")
              .select("node", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("root", "node").alias("root")))
    known = with_least(common.written(rooted, "vector-roots"), "root", "rep", "node", "component_id")
    known = known.select("node", "n_links", "component_id")
    return (rows.join(known, "node", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


@common.query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at cosine 0.93 within their label."""
    return vector_links(common.table(spark, sf_dir, "embeddings"))
