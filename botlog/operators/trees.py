"""Random-forest growth whose work follows the rows of each node.

Spark ML sums a full set of bin counts for every open node in every partition;
the nodes of a forest without a depth limit grow with its rows, and most hold
a handful of them. Here the wide nodes are split that way and the
narrow ones where their rows are:

1. the rows are binned (at most ``max_bins`` per feature, candidate thresholds
   by Spark ML's rule, midpoints between values, but from all rows and not from
   its sample) and stored in blocks spread over the cluster;
2. while nodes hold more than :func:`narrow_rows` rows, a task counts (feature,
   bin, class) of the rows it reads for them, the counts of a node are added
   after a shuffle and its split is chosen there;
3. each row then goes to the narrow node it reaches in each tree, and the
   subtree of a node is grown by the task that has its rows;
4. up to ``HELD_NODES`` nodes the driver holds the forest and scoring broadcasts
   it; beyond, the subtrees stay where they are stored and the rows to score go
   to them, so the driver holds the wide nodes only.

Draws and feature subsets are hashes (of row key and tree; of tree and path)
and votes are summed as integers, so the forest and its scores depend neither on
partitioning nor on where a node is grown or kept. As in Spark ML: Poisson(1)
bootstrap counts, Gini impurity over weighted classes, a split needs a gain
above zero, and sibling leaves of one predicted class merge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlog.operators.ranking import prefix_counts_with_totals
from botlog.session import ship_package

LOCAL_ROWS = 16_384      # bootstrap rows of a node whose subtree one task grows, at least
TOP_NODES = 1_024        # of a table's rows, the share that such a node may hold: bounds the wide nodes
SORTED_ROWS = 16_384     # rows whose values the driver sorts for the thresholds
HELD_NODES = 8_000_000   # nodes of a forest that the driver holds (15 bytes each)
VOTE = 2 ** 48           # a tree's whole vote
BLOCK_ROWS = 16_384      # rows of a stored block
LEVEL_NODES = 8_192      # nodes that one pass over the rows counts for
CHUNK_NODES = 32        # nodes whose counts are laid out at once
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
MIN_GAIN = 1e-12         # of rounding: below it nothing is gained


@dataclass
class Plan:
    """What the tasks need to know of a forest."""
    n_trees: int
    seed: int
    max_depth: int
    max_bins: int
    n_features: int
    subset: int              # features tried at a node
    weights: np.ndarray      # by class

    @property
    def code(self):
        """Type of a stored bin, class or draw."""
        return np.uint8 if max(self.max_bins, len(self.weights)) <= 256 else np.uint16


def narrow_rows(n_rows: int) -> int:
    """Bootstrap rows up to which one task grows a node's subtree."""
    return max(LOCAL_ROWS, n_rows // TOP_NODES)


def mix(x) -> np.ndarray:
    """64-bit finaliser of splitmix64."""
    z = np.atleast_1d(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap sample: Poisson(1) by a hash of key and tree."""
    u = (mix(keys.view(np.uint64) ^ mix(mix(seed) + np.uint64(tree))) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(POISSON, u, side="right").astype(np.uint8)


def subsets(plan: Plan, tree: int, paths: np.ndarray) -> np.ndarray:
    """nodes x ``plan.subset``: the features tried at each node, by a hash of tree and path."""
    base = mix(mix(mix(plan.seed + 1) + np.uint64(tree)) ^ paths.view(np.uint64))
    h = mix((base[:, None] + np.arange(plan.n_features, dtype=np.uint64)).ravel()).reshape(len(paths), -1)
    return np.sort(np.argsort(h, axis=1)[:, :plan.subset], axis=1)


def candidates(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of one feature: the midpoints of neighbouring values, or where there are
    too many, of those next to ``max_bins`` - 1 equal steps of the weight."""
    v, at = np.unique(values, return_inverse=True)
    mid = v[:-1] + (v[1:] - v[:-1]) / 2
    if len(mid) < max_bins:
        return mid
    upto = np.cumsum(np.bincount(at, weights=weights))
    stride, out, target = upto[-1] / max_bins, [], upto[-1] / max_bins
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out[:max_bins - 1])


def all_thresholds(data: DataFrame, plan: Plan) -> list[np.ndarray]:
    """:func:`candidates` of every feature over all rows of (_x, _y), without gathering them: prefix sums
    over the distinct values give the ranks of the chosen values, and only those values are collected."""
    own = [f"n{c}" for c in range(len(plan.weights))]
    cells = data.select("_y", F.posexplode("_x").alias("f", "v")).groupBy("f", "v").agg(
        *[F.count_if(F.col("_y") == c).alias(n) for c, n in enumerate(own)])
    table, totals = prefix_counts_with_totals(cells, "v", {**{n: F.col(n) for n in own}, "d": F.lit(1)}, by=["f"])
    distinct = {f: t["d"] for (f,), t in totals["_groups"].items()}
    stride = sum(w * totals["_groups"][0,][n] for w, n in zip(plan.weights.tolist(), own)) / plan.max_bins

    def weight(column):
        return sum((F.lit(w) * column(n) for w, n in zip(plan.weights.tolist(), own)), F.lit(0.0))

    at = table.select("f", "v", (F.col("cum_d") - 1).alias("rank"), weight(lambda n: F.col(f"cum_{n}") - F.col(n)).alias("before"),
                      weight(lambda n: F.col(f"cum_{n}")).alias("upto"))
    # the rows where the weight passes a multiple of the stride, up to rounding
    passes = F.floor(F.col("upto") / stride + 1e-9) > F.floor(F.col("before") / stride - 1e-9)
    found: dict[int, list] = {}
    for r in at.filter(passes & F.col("f").isin([f for f, d in distinct.items() if d > plan.max_bins])).collect():
        found.setdefault(r["f"], []).append(r)
    ranks = {f: _step_ranks(sorted(found[f], key=lambda r: r["rank"]), d, stride, plan.max_bins) if d > plan.max_bins else range(d - 1)
             for f, d in distinct.items()}
    wanted = [(f, r) for f, chosen in ranks.items() for r in sorted({x for j in chosen for x in (j, j + 1)})]
    if not wanted:
        return [np.empty(0)] * plan.n_features
    value = {(r["f"], r["rank"]): r["v"] for r in at.join(
        F.broadcast(data.sparkSession.createDataFrame(wanted, "f int, rank long")), ["f", "rank"]).select("f", "rank", "v").collect()}
    return [np.array([value[f, j] + (value[f, j + 1] - value[f, j]) / 2 for j in ranks[f]]) for f in range(plan.n_features)]


def _step_ranks(passing: list, distinct: int, stride: float, max_bins: int) -> list[int]:
    """The ranks :func:`candidates` puts a threshold after: next to each step the value whose weight up to it is
    nearest, the later of two; a value that several steps share leaves the next ones to the values after it."""
    upto = np.array([r["upto"] for r in passing])
    out: list[int] = []
    last, target = -1, stride
    while len(out) < max_bins - 1:
        i = int(np.searchsorted(upto, target))
        if i == len(passing):
            break
        r = passing[i]
        lower = r["rank"] > 0 and abs(r["before"] - target) < abs(r["upto"] - target)
        last = max(last + 1, r["rank"] - lower)
        if last > distinct - 2:
            break
        out.append(last)
        target += stride
    return out


def count(plan: Plan, bins, y, w, at, feats) -> np.ndarray:
    """classes x nodes x subset x bins: bootstrap rows; ``at`` is the node of each row."""
    m, k, c = len(feats), plan.subset, len(plan.weights)
    b = np.take_along_axis(bins, feats[at], axis=1)
    cell = ((y * m + at) * k)[:, None] + np.arange(k)
    return np.bincount((cell * plan.max_bins + b).ravel(), weights=np.repeat(w, k),
                       minlength=c * m * k * plan.max_bins).reshape(c, m, k, plan.max_bins)


def choose(plan: Plan, counts: np.ndarray, feats: np.ndarray):
    """(feature, bin, gain, left, total) of each node's best split; feature -1 without any gain.
    Rows of the bin or a lower one go left; left and total are bootstrap rows by class."""
    left = np.cumsum(counts, axis=3)
    total = left[:, :, 0, -1]                      # classes x nodes

    def purity(by_class):
        n = q = 0.0
        for c, weight in zip(by_class, plan.weights):
            x = c * weight
            n, q = n + x, q + x * x
        return q / np.maximum(n, 1e-300), n

    pl, nl = purity(left)
    pr, nr = purity(total[:, :, None, None] - left)
    pt, n = purity(total)
    both = np.where((nl > 0) & (nr > 0), pl + pr, -1.0).reshape(len(feats), -1)
    best, i = both.argmax(1), np.arange(len(feats))
    j, b = np.divmod(best, plan.max_bins)
    g = np.where(both[i, best] >= 0, (both[i, best] - pt) / np.maximum(n, 1e-300), -1.0)
    return np.where(g > MIN_GAIN, feats[i, j], -1), b, g, left[:, i, j, b].T, total.T


@dataclass
class Nodes:
    """Nodes of a tree or subtree; the children of node i are ``child[i]`` and the next. A leaf with a
    negative child stands for the subtree stored for node -1 - ``child[i]``."""
    feature: np.ndarray                       # -1: leaf
    bin: np.ndarray
    child: np.ndarray
    counts: np.ndarray                        # bootstrap rows by class
    gain: np.ndarray = field(repr=False)

    @property
    def numNodes(self) -> int:  # noqa: N802 - as Spark ML's trees name it
        return len(self.feature)

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(live):
            at = node[live]
            f = self.feature[at]
            live, at, f = live[f >= 0], at[f >= 0], f[f >= 0]
            node[live] = self.child[at] + (bins[live, f] > self.bin[at])
        return node

    def pruned(self, weights: np.ndarray) -> Nodes:
        """Sibling leaves that predict the same class become their parent, from the bottom up."""
        feature, says = self.feature.copy(), (self.counts * weights).argmax(1)
        waiting = np.flatnonzero(feature >= 0)
        while len(waiting):
            a = self.child[waiting]
            merge = (feature[a] < 0) & (feature[a + 1] < 0) & (says[a] == says[a + 1]) & (self.child[a] >= 0) & (self.child[a + 1] >= 0)
            if not merge.any():
                break
            feature[waiting[merge]] = -1
            waiting = waiting[~merge]
        keep = np.zeros(len(feature), bool)
        level = np.zeros(1, np.int64)
        while len(level):
            keep[level] = True
            level = level[feature[level] >= 0]
            level = np.concatenate([self.child[level], self.child[level] + 1])
        new = np.cumsum(keep) - 1
        inner = feature >= 0
        child = np.where(inner, new[np.where(inner, self.child, 0)], np.minimum(self.child, 0))
        return Nodes(feature[keep], self.bin[keep], child[keep].astype(np.int32), self.counts[keep], self.gain[keep])

    def importances(self, plan: Plan) -> np.ndarray:
        inner = self.feature >= 0
        w = (self.counts[inner] * plan.weights).sum(1) * self.gain[inner]
        return np.bincount(self.feature[inner], weights=w, minlength=plan.n_features)

    def under(self, subtrees: dict[int, Nodes]) -> Nodes:
        """This tree with the subtrees in place of the nodes they are named by."""
        parts, offset, shift = [self], len(self.feature), {}
        for at, s in subtrees.items():
            shift[at] = offset - 1   # the root takes the place of the node, the others follow
            offset += len(s.feature) - 1
            parts.append(s)
        join = lambda name: np.concatenate([getattr(self, name), *[getattr(s, name)[1:] for s in parts[1:]]])
        out = Nodes(*[join(n) for n in ("feature", "bin", "child", "counts", "gain")])
        first = len(self.feature)
        for at, s in subtrees.items():
            out.child[first:first + len(s.feature) - 1] += shift[at]
            first += len(s.feature) - 1
            for n in ("feature", "bin", "counts", "gain"):
                getattr(out, n)[at] = getattr(s, n)[0]
            out.child[at] = s.child[0] + shift[at]
        return out


def grow(plan: Plan, tree: int, path: int, depth: int, bins, y, w) -> Nodes:
    """The subtree of one node from its bootstrap rows, a level at a time."""
    c = len(plan.weights)
    at = np.zeros(len(y), np.int64)                      # node of each row, among the level's
    paths = np.array([path], np.int64)
    counts = np.bincount(y, weights=w, minlength=c)[None, :]
    levels, n = [], 1
    while len(paths):
        m = len(paths)
        feature, cut, gain = np.full(m, -1, np.int16), np.zeros(m, plan.code), np.zeros(m)
        child, split_left = np.zeros(m, np.int32), np.zeros((m, c))
        mixed = np.flatnonzero((counts > 0).sum(1) > 1) if depth < plan.max_depth else np.empty(0, np.int64)
        place = np.full(m, -1, np.int64)
        place[mixed] = np.arange(len(mixed))
        at = place[at]
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], 0):]    # rows of mixed nodes, by node
        bins, y, w, at = bins[order], y[order], w[order], at[order]
        for a in range(0, len(mixed), CHUNK_NODES):
            ids = mixed[a:a + CHUNK_NODES]
            i, k = np.searchsorted(at, [a, a + len(ids)])
            feats = subsets(plan, tree, paths[ids])
            f, b, g, left, _ = choose(plan, count(plan, bins[i:k], y[i:k], w[i:k], at[i:k] - a, feats), feats)
            feature[ids], cut[ids], gain[ids], split_left[ids] = f, b, g, left
        split = np.flatnonzero(feature >= 0)
        child[split] = n + 2 * np.arange(len(split))
        levels.append(Nodes(feature, cut, child, counts, gain))
        place = np.full(m, -1, np.int64)
        place[split] = 2 * np.arange(len(split))
        node = mixed[at]
        go = feature[node] >= 0
        bins, y, w, node = bins[go], y[go], w[go], node[go]
        at = place[node] + (bins[np.arange(len(node)), feature[node]] > cut[node])
        counts = np.stack([split_left[split], counts[split] - split_left[split]], axis=1).reshape(-1, c)
        paths = np.stack([2 * paths[split], 2 * paths[split] + 1], axis=1).ravel()
        n += len(paths)
        depth += 1
    return Nodes(*[np.concatenate([getattr(x, f) for x in levels]) for f in ("feature", "bin", "child", "counts", "gain")])


# --- the forest over Spark's rows ------------------------------------------------


def _pack(plan: Plan, thresholds, batch: pa.RecordBatch):
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(plan.code), to_bins(plan, x, thresholds)


def to_bins(plan: Plan, x: np.ndarray, thresholds) -> np.ndarray:
    """rows x features: how many of the feature's thresholds each value is above."""
    return np.column_stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(thresholds)]).astype(plan.code)


def stored_blocks(data: DataFrame, plan: Plan, thresholds) -> DataFrame:
    """(keys, y, bins): the binned rows of (_k, _x, _y), ``BLOCK_ROWS`` to a block, stored."""
    spark = data.sparkSession

    def run(batches):
        held, n = [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*held)], names=["keys", "y", "bins"])
        for b in batches:
            if b.num_rows:
                held.append(_pack(plan, thresholds, b))
                n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return (data.repartition(2 * spark.sparkContext.defaultParallelism)
            .mapInArrow(run, "keys binary, y binary, bins binary").checkpoint(eager=True))


def _blocks(batches, plan: Plan):
    for b in batches:
        for keys, y, bins in zip(*(c.to_pylist() for c in b.columns)):
            yield np.frombuffer(keys, np.int64), np.frombuffer(y, plan.code), np.frombuffer(bins, plan.code).reshape(-1, plan.n_features)


def _reached(plan: Plan, tree: int, nodes: Nodes, chosen: np.ndarray, keys, y, bins):
    """(place among ``chosen`` nodes, bins, y, draws) of the tree's bootstrap rows that reach one of them."""
    w = draws(keys, tree, plan.seed)
    i = np.flatnonzero(w)
    place = np.full(nodes.numNodes, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    at = place[nodes.walk(bins[i])]
    i, at = i[at >= 0], at[at >= 0]
    return at, bins[i], y[i], w[i]


def wide_splits(blocks: DataFrame, plan: Plan, tops: dict, chosen: dict, paths: dict) -> list:
    """The best split of every chosen node (tree -> nodes), from counts added up over all blocks."""
    shape = (len(plan.weights), 1, plan.subset, plan.max_bins)

    def counted(batches):
        sums = {}
        for keys, y, bins in _blocks(batches, plan):
            for t, nodes in chosen.items():
                at, b, yy, w = _reached(plan, t, tops[t], nodes, keys, y, bins)
                yy = yy.astype(np.int64)
                if len(at):
                    c = count(plan, b, yy, w, at, subsets(plan, t, paths[t]))
                    sums[t] = sums[t] + c if t in sums else c
        for t, c in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(c.shape[1], t), pa.int32()), pa.array(np.arange(c.shape[1]), pa.int32()),
                 pa.array([c[:, i].astype(np.int32).tobytes() for i in range(c.shape[1])], pa.binary())], names=["tree", "place", "counts"])

    def best(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t, i = int(key[0]), int(key[1])
        c = sum(np.frombuffer(x, np.int32).astype(np.float64) for x in part["counts"]).reshape(shape)
        f, b, g, left, total = choose(plan, c, subsets(plan, t, paths[t][i:i + 1]))
        return pd.DataFrame({"tree": [t], "place": [i], "feature": [int(f[0])], "bin": [int(b[0])], "gain": [float(g[0])],
                             "left": [left[0].tolist()], "total": [total[0].tolist()]})

    return (blocks.mapInArrow(counted, "tree int, place int, counts binary").groupBy("tree", "place")
            .applyInPandas(best, "tree int, place int, feature int, bin int, gain double, left array<double>, total array<double>")
            .collect())


def subtrees(blocks: DataFrame, plan: Plan, tops: dict, chosen: dict, paths: dict, depths: dict) -> DataFrame:
    """(tree, node, feature, bin, child, counts, importance): the pruned subtree of every chosen node, stored.
    A group holds the bootstrap rows of one node, packed by block."""
    width = plan.n_features + 2

    def dealt(batches):
        for keys, y, bins in _blocks(batches, plan):
            out = []
            for t, nodes in chosen.items():
                at, b, yy, w = _reached(plan, t, tops[t], nodes, keys, y, bins)
                order = np.argsort(at, kind="stable")
                rows, at = np.column_stack([b, yy, w]).astype(plan.code)[order], at[order]
                ends = np.searchsorted(at, np.arange(len(nodes) + 1))
                out += [(t, i, rows[ends[i]:ends[i + 1]].tobytes()) for i in range(len(nodes)) if ends[i] < ends[i + 1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))],
                                                 names=["tree", "place", "rows"])

    def grown(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t, i = int(key[0]), int(key[1])
        rows = np.concatenate([np.frombuffer(x, plan.code).reshape(-1, width) for x in part["rows"]])
        s = grow(plan, t, int(paths[t][i]), int(depths[t][i]), rows[:, :-2], rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64))
        s = s.pruned(plan.weights)
        return pd.DataFrame({"tree": [t], "node": [int(chosen[t][i])], "feature": [s.feature.tobytes()],
                             "bin": [s.bin.tobytes()], "child": [s.child.astype(np.int32).tobytes()],
                             "counts": [s.counts.astype(np.int32).tobytes()], "importance": [s.importances(plan).tolist()]})

    spark = blocks.sparkSession
    return (blocks.mapInArrow(dealt, "tree int, place int, rows binary")
            .repartition(4 * spark.sparkContext.defaultParallelism, "tree", "place").groupBy("tree", "place")
            .applyInPandas(grown, "tree int, node int, feature binary, bin binary, child binary, counts binary, importance array<double>")
            .checkpoint(eager=True))


class _Top:
    """The wide part of a tree while it grows."""

    def __init__(self, n_classes: int):
        self.feature, self.bin, self.child, self.gain = [-1], [0], [0], [0.0]
        self.counts, self.path, self.depth = [[0.0] * n_classes], [1], [0]

    def split(self, at: int, r) -> list[int]:
        """Takes over the split of a node, gives its new children."""
        self.counts[at] = r["total"]
        if r["feature"] < 0:
            return []
        first = len(self.feature)
        self.feature[at], self.bin[at], self.child[at], self.gain[at] = r["feature"], r["bin"], first, r["gain"]
        for side, c in enumerate((r["left"], [a - b for a, b in zip(r["total"], r["left"])])):
            for name, v in (("feature", -1), ("bin", 0), ("child", 0), ("gain", 0.0), ("counts", c),
                            ("path", 2 * self.path[at] + side), ("depth", self.depth[at] + 1)):
                getattr(self, name).append(v)
        return [first, first + 1]

    def nodes(self, plan: Plan) -> Nodes:
        return Nodes(np.array(self.feature, np.int16), np.array(self.bin, plan.code), np.array(self.child, np.int32),
                     np.array(self.counts), np.array(self.gain))


def _stored_nodes(plan: Plan, r) -> Nodes:
    """Nodes of a row of :func:`subtrees`."""
    n = len(r["feature"]) // 2
    return Nodes(np.frombuffer(r["feature"], np.int16), np.frombuffer(r["bin"], plan.code), np.frombuffer(r["child"], np.int32),
                 np.frombuffer(r["counts"], np.int32).reshape(n, -1), np.zeros(n))


def votes(plan: Plan, counts: np.ndarray) -> np.ndarray:
    """rows x classes: the share of each class in a leaf's counts, in parts of ``VOTE``: integers, so that
    the order of the trees does not show in their sum."""
    c = counts * plan.weights
    total = c.sum(1, keepdims=True)
    return np.rint(np.divide(c, total, out=np.zeros_like(c), where=total > 0) * VOTE).astype(np.int64)


def _said(summed: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"p": summed[:, 1] / np.maximum(summed.sum(1), 1), "y": summed.argmax(1).astype(np.int32)})


@dataclass
class Forest:
    """A grown forest: bins' thresholds, trees as node arrays, and the importances of its features. With
    ``below``, the trees are the wide nodes and the leaves next to them, and the subtrees are its rows."""
    plan: Plan
    thresholds: list[np.ndarray]
    trees: list[Nodes] = field(repr=False)
    importance: np.ndarray
    below: DataFrame | None = None

    def scored(self, df: DataFrame, features) -> DataFrame:
        """Adds ``_s``, a struct (p, y): the mean share of class 1 in the leaves a row reaches, and the likeliest class."""
        return df.withColumn("_s", self.scores(df, features)) if self.below is None else self._scored_apart(df, features)

    def scores(self, df: DataFrame, features) -> Column:
        """:meth:`scored` as a column, of a forest that the driver holds."""
        ship_package(df.sparkSession)
        bc = df.sparkSession.sparkContext.broadcast((self.plan, self.thresholds, self.trees))

        @F.pandas_udf("p double, y int")
        def score(*cols: pd.Series) -> pd.DataFrame:
            plan, thresholds, grown = bc.value
            bins = to_bins(plan, np.column_stack([c.to_numpy(dtype=np.float64) for c in cols]), thresholds)
            return _said(sum(votes(plan, t.counts[t.walk(bins)]) for t in grown))

        return score(*[F.col(c).cast("double") for c in features])

    def _scored_apart(self, df: DataFrame, features) -> DataFrame:
        """The rows, in blocks, go to the stored subtree they reach in each tree; the votes go back to the
        block. A group holds the rows that reach one subtree, or the votes of one block."""
        ship_package(df.sparkSession)
        plan, thresholds, tops = self.plan, self.thresholds, self.trees
        kept = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
        names, types = ["block", "tree", "node", "ids", "bins", "votes"], (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

        def block(held):
            ids, bins = (np.concatenate(c) for c in zip(*held))
            first, own, out = int(ids[0]), np.zeros((len(ids), len(plan.weights)), np.int64), []
            for t, top in enumerate(tops):
                at = top.walk(bins)
                node = -1 - top.child[at].astype(np.int64)
                here = node < 0
                own[here] += votes(plan, top.counts[at[here]])
                i = np.flatnonzero(~here)
                i = i[np.argsort(node[i], kind="stable")]
                reached, starts = np.unique(node[i], return_index=True)
                out += [(first, t, int(k), part.astype(np.int32).tobytes(), bins[part].tobytes(), None)
                        for k, part in zip(reached, np.split(i, starts[1:]))]
            out.append((first, -1, first, ids.tobytes(), None, own.tobytes()))  # a group of its own
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

        def dealt(batches):
            held, n = [], 0
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    held.append((b.column(0).to_numpy(), to_bins(plan, x, thresholds)))
                    n += b.num_rows
                if n >= BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
            if held:
                yield block(held)

        def walked(rows: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
            if len(subtree) and len(rows):
                s = _stored_nodes(plan, subtree.iloc[0])
                rows["votes"] = [votes(plan, s.counts[s.walk(np.frombuffer(b, plan.code).reshape(-1, plan.n_features))]).tobytes()
                                 for b in rows["bins"]]
            return rows[["block", "tree", "ids", "votes"]]

        def added(part: pd.DataFrame) -> pd.DataFrame:
            own = part[part["tree"] < 0].iloc[0]
            ids = np.frombuffer(own["ids"], np.int64)
            total = np.frombuffer(own["votes"], np.int64).reshape(len(ids), -1).copy()
            for i, v in part.loc[part["tree"] >= 0, ["ids", "votes"]].itertuples(index=False):
                total[np.frombuffer(i, np.int32)] += np.frombuffer(v, np.int64).reshape(-1, total.shape[1])
            return pd.concat([pd.DataFrame({"_row": ids}), _said(total)], axis=1)

        rows = kept.select("_row", F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
        below = self.below.withColumn("node", F.col("node").cast("long"))
        said = (rows.mapInArrow(dealt, "block long, tree int, node long, ids binary, bins binary, votes binary").groupBy("tree", "node")
                .cogroup(below.groupBy("tree", "node")).applyInPandas(walked, "block long, tree int, ids binary, votes binary")
                .groupBy("block").applyInPandas(added, "_row long, p double, y int"))
        return kept.join(said, "_row").select(*df.columns, F.struct("p", "y").alias("_s"))


def fit(data: DataFrame, plan: Plan, n_rows: int, local_rows: int | None = None, sorted_rows: int = SORTED_ROWS,
        held_nodes: int = HELD_NODES) -> Forest:
    """Grow a forest on the rows (_k long: row key, _x array<double>, _y int: class) of ``data``."""
    spark = data.sparkSession
    ship_package(spark)
    local_rows = local_rows or narrow_rows(n_rows)
    if n_rows <= sorted_rows:
        rows = data.select("_x", "_y").collect()
        x, w = np.array([r["_x"] for r in rows]), plan.weights[[r["_y"] for r in rows]]
        thresholds = [candidates(x[:, i], w, plan.max_bins) for i in range(plan.n_features)]
    else:
        thresholds = all_thresholds(data, plan)
    blocks = stored_blocks(data, plan, thresholds)

    tops = {t: _Top(len(plan.weights)) for t in range(plan.n_trees)}
    wide, narrow = [], []
    (wide if n_rows > local_rows else narrow).extend((t, 0) for t in tops)
    while wide:
        level, wide = wide[:LEVEL_NODES], wide[LEVEL_NODES:]
        chosen = _by_tree(level)
        paths = {t: np.array([tops[t].path[i] for i in at], np.int64) for t, at in chosen.items()}
        for r in wide_splits(blocks, plan, {t: tops[t].nodes(plan) for t in chosen}, chosen, paths):
            t = r["tree"]
            for i in tops[t].split(int(chosen[t][r["place"]]), r):
                c = tops[t].counts[i]
                if sum(v > 0 for v in c) > 1 and tops[t].depth[i] < plan.max_depth:
                    (wide if sum(c) > local_rows else narrow).append((t, i))

    below: dict[int, dict[int, Nodes]] = {t: {} for t in tops}
    importance = {t: np.zeros(plan.n_features) for t in tops}
    grown = {t: tops[t].nodes(plan) for t in tops}
    found, apart = None, False
    if narrow:
        chosen = _by_tree(narrow)
        found = subtrees(blocks, plan, {t: grown[t] for t in chosen}, chosen,
                         {t: np.array([tops[t].path[i] for i in at], np.int64) for t, at in chosen.items()},
                         {t: np.array([tops[t].depth[i] for i in at], np.int64) for t, at in chosen.items()})
        size = F.floor(F.octet_length("feature") / 2)
        apart = (found.agg(F.sum(size).alias("n")).first()["n"] or 0) > held_nodes  # no row may be drawn
        if apart:
            for r in found.filter(size > 1).select("tree", "node").toLocalIterator():
                grown[r["tree"]].child[r["node"]] = -1 - r["node"]
        for r in found.select("tree", "importance").toLocalIterator():
            importance[r["tree"]] += np.array(r["importance"])
        for r in (found.filter(size == 1) if apart else found).toLocalIterator():  # a leaf may merge with its sibling
            below[r["tree"]][r["node"]] = _stored_nodes(plan, r)

    trees, shares = [], np.zeros(plan.n_features)
    for t in tops:
        whole = grown[t].under(dict(sorted(below.pop(t).items()))).pruned(plan.weights)
        own = importance[t] + whole.importances(plan)  # its own subtrees' nodes have no gain here
        shares += own / own.sum() if own.sum() > 0 else 0
        few = whole.counts.max(initial=0) < 2 ** 31
        trees.append(Nodes(whole.feature, whole.bin, whole.child, whole.counts.astype(np.int32 if few else np.int64), np.empty(0)))
    return Forest(plan, thresholds, trees, shares / shares.sum() if shares.sum() > 0 else shares, found.filter(size > 1) if apart else None)


def _by_tree(nodes) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for t, i in nodes:
        out.setdefault(t, []).append(i)
    return {t: np.array(at, np.int64) for t, at in out.items()}
