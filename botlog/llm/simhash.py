"""SimHash near-duplicates: pigeonhole blocks.

A text's fingerprint holds, for each of 64 bits, the majority of that bit in
the XXH64 hashes (seed 42) of its word shingles. Fingerprints at most ``d``
bits apart are linked, and the groups are the connected components.

With the 64 bits split into ``d + 2`` blocks, two fingerprints that differ in
at most ``d`` bits agree on at least two whole blocks, so the candidates are
the pairs that share the value of one of the block pairs: an equi-join on
(block pair, its bits). The Hamming distance is then verified. Equal
fingerprints are one node from the start, so copies never meet as pairs. A
value shared by more than ``CHUNK`` fingerprints is cut into chunks by hash,
every two chunks meet in a task of their own, and a task returns a spanning
forest of the links it saw, never all pairs of a dense group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common
from botlog.llm.graph import components, with_least

#: Most fingerprints of one chunk; a task holds two.
CHUNK = 8192
#: Groups up to this size are compared by shifting; larger ones by search.
SMALL = 32


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned fingerprint of one UTF-8 text; 0 when it has no words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        ends = ends[shingle - 1:]
    xxh = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(ends)
    for lo in range(0, total, 65536):
        part = [xxh(joined[s:e], 42) for s, e in zip(starts[lo:lo + 65536], ends[lo:lo + 65536])]
        raw = np.array(part, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) of every row: h is a hash of the text, fp the
    fingerprint's 64 bits as a long."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=[id_col, "h", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), common.text_hash(text_col).alias("h"),
                         common.utf8(text_col).alias("b"))
    return narrow.mapInArrow(run, f"`{id_col}` long, h long, fp long")


def block_masks(max_distance: int) -> list[int]:
    """Bit masks of all pairs among ``max_distance + 2`` nearly equal blocks."""
    n = max_distance + 2
    if not 0 <= max_distance <= 30:
        raise ValueError("max_distance must lie in 0..30")
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def forest(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``fps``: every node
    reached is compared only with those not reached yet."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            node = stack.pop()
            near = _distance(rest, node) <= max_distance
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node, np.uint64))
                right.append(found)
                stack.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links(keys: np.ndarray, fps: np.ndarray, max_distance: int):
    """Links inside runs of equal rows of ``keys`` (sorted)."""
    edge = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for shift in range(1, min(SMALL, int(sizes.max(initial=1)))):
        same = (group[shift:] == group[:-shift]) & small[shift:]
        a, b = fps[:-shift][same], fps[shift:][same]
        near = (_distance(a, b) <= max_distance) & (a != b)
        left.append(a[near])
        right.append(b[near])
    for g in np.flatnonzero(sizes > SMALL):
        a, b = forest(np.unique(fps[starts[g]:starts[g] + sizes[g]]), max_distance)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def fingerprint_links(fps: DataFrame, max_distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) between distinct values of ``fps.fp`` whose components are
    those of "at most ``max_distance`` bits apart"."""
    masks = block_masks(max_distance)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits"))
        for i, m in enumerate(masks)])).alias("k")).select("k.*", "fp")
    hot = (keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
           .select("block", "bits", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("fp", "block"), F.col("chunks")).cast("int")
    dealt = (keyed.join(hot, ["block", "bits"], "left")
             .select("block", "bits", "fp", F.coalesce(own, F.lit(0)).alias("own"),
                     F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)).alias("other"))
             .select("block", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))
    keys = ["block", "bits", "lo", "hi"]

    def run(batches):
        held_k, held_f = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = _links(k, f, max_distance) if len(f) > 1 else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for b in batches:
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            held_k = np.concatenate([held_k, k])
            held_f = np.concatenate([held_f, b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(held_f) < 65536:
                continue
            last = np.flatnonzero(np.any(held_k != held_k[-1], axis=1))  # the last group may go on
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        yield out(held_k, held_f)

    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
            .mapInArrow(run, "u long, v long").distinct())


def simhash_groups(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, h, fp, component_id), one row for each row of ``docs``; h is a
    hash of the text.

    Null and empty texts have fingerprint 0 and link like any other. A row
    with a null id takes part and keeps its null id; component_id is the
    smallest id that is not null in the group (null if there is none). Rows
    that repeat an id each get a row. Columns besides id and text are not
    read. An empty table gives no rows."""
    fps = common.written(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    nodes = common.written(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), max_distance))
    linked = common.written(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "simhash-linked")
    linked = with_least(linked, "root", "least_id", "fp", "component_id").select("fp", "component_id", "root")
    mapped = (nodes.join(linked, "fp", "left")
              .select("fp", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return fps.join(mapped, "fp").select(id_col, "h", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` (any columns) with one row of each group: that with the
    smallest doc_id, and among texts of one id that with the smallest text
    hash. Rows that repeat both id and text are copies; one of them stays. Of
    a group without any id, one row stays."""
    g = simhash_groups(docs, shingle, max_distance)
    ends = (g.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
            .agg(F.min(F.struct("doc_id", "h")).alias("k")).select("k.doc_id", "k.h"))
    kept = common.written(g.join(ends.select(F.col("doc_id").alias("i"), F.col("h").alias("j")),
                                 F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left_semi")
                          .groupBy("doc_id", "h").count(), "simhash-kept")
    h = common.text_hash("text")
    i, j = common.unused(docs.columns, "i"), common.unused(docs.columns, "j")
    out = docs.join(kept.select(F.col("doc_id").alias(i), F.col("h").alias(j)),
                    docs["doc_id"].eqNullSafe(F.col(i)) & (h == F.col(j)), "left_semi")
    if kept.where("count > 1").isEmpty():  # no repeated rows: nothing to drop, so no shuffle for it
        return out
    return out.withColumn(j, h).dropDuplicates(["doc_id", j]).drop(j)


@common.query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies in documents: 4-word shingles, 4 bits."""
    g = simhash_groups(common.table(spark, sf_dir, "documents"), 4, 4)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
