"""Benchmark decontamination by greedy string tiling.

Documents and test passages are sequences of lower-cased words. Their shared
five-word seeds say which (document, passage) pairs can match at all; for
these, the longest matches that do not overlap are marked again and again by
running Karp-Rabin hashing from long windows down to the seed length. The
share of a passage's words that the tiles cover does not depend on the order
of the tiles, so passages whose sentences were moved about are caught.

The lengths to try are found by bisection: a match of some length holds one
of every shorter length, so a pair costs one search for each distinct tile
length (at most about the root of twice the shorter text) and not a pass for
every length.

The test set is the query set: equal passages are one, under their smallest
id, so a passage listed many times takes one place. The distinct passages are
stored once, cut by a hash into blocks of a bounded size; each block is
broadcast, and every document passes each block once, where it lies, without
a shuffle.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common
from botlog.session import scratch_path

#: Words of a seed, and of the shortest tile.
SEED_WORDS = 5
#: Share of a passage's words that makes a document contaminated.
COVERAGE = 0.5
#: Bytes of test passages broadcast at a time.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` ids, modulo 2^64."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + ids[k:len(ids) - size + 1 + k]
    return out


class _Rolling:
    """Hashes of windows of any size from one pass of prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        with np.errstate(over="ignore"):
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            # Prefix sums of id * BASE^i; a window's sum is lined up by a power when compared.
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * self.power[:n])])

    def windows(self, size: int, lift: int) -> np.ndarray:
        """Hashes of all windows of ``size``, multiplied by BASE^(lift - start)."""
        n = len(self.ids) - size + 1
        starts = np.arange(n)
        return (self.prefix[size:size + n] - self.prefix[:n]) * _power(lift - starts)


_POWERS = np.ones(1, np.uint64)


def _power(exponents: np.ndarray) -> np.ndarray:
    global _POWERS
    most = int(exponents.max(initial=0))
    if most >= len(_POWERS):
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * most + 64, _BASE, np.uint64))])
    return _POWERS[exponents]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the greedy tiling; id 0 never
    matches. Of equally long matches the first in the document, then in the
    passage, is marked first."""
    out = []
    if len(doc) < least or len(item) < least:
        return out
    free_d, free_i = doc > 0, item > 0
    rd, ri, lift = _Rolling(doc), _Rolling(item), max(len(doc), len(item))
    most = min(len(doc), len(item))

    def windows(size: int):
        """Free windows of ``size`` whose hashes meet: starts and hashes of both sides."""
        open_d, open_i = (np.flatnonzero(used[size:] == used[:-size]) for used in (used_d, used_i))
        hd, hi = rd.windows(size, lift)[open_d], ri.windows(size, lift)[open_i]
        hit = np.isin(hd, hi)
        return (open_d[hit], hd[hit], open_i, hi) if hit.any() else None

    while most >= least:
        used_d, used_i = (np.concatenate([[0], np.cumsum(~f)]) for f in (free_d, free_i))
        size, met = least - 1, None
        while size < most:  # the longest length at which windows meet
            middle = (size + most + 1) // 2
            found = windows(middle)
            if found is None:
                most = middle - 1
            else:
                size, met = middle, found
        if met is None:
            break
        starts, hd, open_i, hi = met
        order = np.argsort(hi, kind="stable")
        hi, open_i = hi[order], open_i[order]
        next_i: dict[int, int] = {}
        for s, lo, hi_ in zip(starts.tolist(), np.searchsorted(hi, hd, "left").tolist(), np.searchsorted(hi, hd, "right").tolist()):
            # A marked stretch is at least as long as the window: it covers an end of it or none of it.
            if not (free_d[s] and free_d[s + size - 1]):
                continue
            at = next_i.get(lo, lo)
            while at < hi_ and not (free_i[open_i[at]] and free_i[open_i[at] + size - 1]):
                at += 1
            next_i[lo] = at  # what is marked stays so
            for t in open_i[at:hi_].tolist():
                if free_i[t] and free_i[t + size - 1] and np.array_equal(doc[s:s + size], item[t:t + size]):
                    free_d[s:s + size] = False
                    free_i[t:t + size] = False
                    out.append((s, t, size))
                    break
        most = size - 1
    return out


class TestSet:
    """One block of test passages with the index of its seeds."""

    def __init__(self, items: list[tuple], least: int):
        self.least, self.vocab = least, {}
        self.ids, self.items = [], []
        for key, text in items:
            words = words_of(text)
            if len(words) >= least:
                self.ids.append(key)
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64))
        with np.errstate(over="ignore"):
            hashed = [_window_hashes(x, least) for x in self.items]
        h = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashed)), [len(x) for x in hashed])
        order = np.lexsort((owner, h))
        self.hashes, self.owner = h[order], owner[order]
        self.distinct = np.unique(h)

    def covered(self, text: str) -> list[tuple]:
        """(item, coverage, tiles) of every passage that shares a seed with the text."""
        if not len(self.distinct):
            return []
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(0)), np.int64, len(words))
        if len(ids) < self.least:
            return []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = np.flatnonzero(known[self.least:] - known[:-self.least] == self.least)
        if not len(starts):
            return []
        h = np.zeros(len(starts), np.uint64)
        for k in range(self.least):
            h = h * _BASE + ids[starts + k].astype(np.uint64)
        at = np.minimum(np.searchsorted(self.distinct, h), len(self.distinct) - 1)
        seeded = self.distinct[at] == h
        starts, h = starts[seeded], h[seeded]
        if not len(starts):
            return []
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        out = []
        seeds: dict[int, list[int]] = {}
        for s, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist()):
            for o in np.unique(self.owner[a:b]).tolist():
                seeds.setdefault(o, []).append(s)
        for o in sorted(seeds):
            # Only words under a seed can be in a tile; a zero parts the stretches.
            covered = np.zeros(len(ids) + 1, np.int64)
            s = np.array(seeds[o])
            np.add.at(covered, s, 1)
            np.add.at(covered, s + self.least, -1)
            inside = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            cuts = np.flatnonzero(np.diff(inside) > 1) + 1
            doc = np.insert(ids[inside], cuts, 0)
            found = tiles(doc, self.items[o], self.least)
            out.append((self.ids[o], sum(n for _, _, n in found) / len(self.items[o]), len(found)))
        return out


def _rank(found: tuple) -> tuple:
    """Order of (item, coverage, tiles): the most covered first, then by item, null last."""
    return -found[1], found[0] is None, found[0] or 0


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(t, i): the distinct passages, each under its smallest id (null if it has
    none); null and empty texts are one."""
    return (items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
            .groupBy("t").agg(F.min("i").alias("i")))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    spark = items.sparkSession
    distinct = common.written(passages(items, id_col, text_col), "tiling-passages")
    total = distinct.agg(F.sum(F.length(common.utf8("t")) + 16).alias("n")).first()["n"] or 0
    n = int(total // block_bytes) + 1
    path = scratch_path(spark, "tiling-blocks")
    (distinct.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")).repartition("block")
     .write.partitionBy("block").parquet(path))
    stored = spark.read.schema("t string, i long, block int").parquet(path)
    for k in range(n):  # each block is bounded by its share of the hash, and reads its own files
        yield [(r["i"], r["t"]) for r in stored.where(F.col("block") == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, seed_words: int = SEED_WORDS,
                  coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", leak_col: str = "_leak") -> DataFrame:
    """Columns ``keep`` (all by default) of every row of ``docs`` and a struct
    ``leak_col`` (a name that none of them has) of item_id, coverage, n_tiles,
    contaminated and ``items``: (item_id, coverage, n_tiles) of every distinct
    passage covered to ``coverage`` or more, the most covered first.

    item_id, coverage and n_tiles are those of the passage covered most, below
    the threshold too; ties go to the smallest item_id (null last). Passages of
    equal text are one, under their smallest id (:func:`passages` says which).
    Long texts are read whole. Null and empty texts have coverage 0, a null item and
    no items. Passages of fewer than ``seed_words`` words hold no seed and never match. Repeated
    rows are each answered; an empty test set contaminates nothing."""
    spark = docs.sparkSession
    common.prepare(spark)
    keep = docs.columns if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    item = "struct<item_id: bigint, coverage: double, n_tiles: int>"
    now = docs.select(F.struct(*cols).alias("row"), text.alias("t"), F.lit(None).cast(item).alias("best"),
                      F.array().cast(f"array<{item}>").alias("items"))
    for block_items in _blocks(benchmark, item_col, item_text, block_bytes):
        held = spark.sparkContext.broadcast(block_items)

        def run(batches, held=held):
            with np.errstate(over="ignore"):
                block = TestSet(held.value, seed_words)
                for b in batches:
                    bests, lists = [], []
                    for t, best, items in zip(*(b.column(c).to_pylist() for c in ("t", "best", "items"))):
                        found = block.covered(t)
                        was = [tuple(x.values()) for x in ([best] if best else [])]
                        bests.append(_named(min(was + found, key=_rank, default=None)))
                        all_ = [tuple(x.values()) for x in items] + [x for x in found if x[1] >= coverage]
                        lists.append([_named(x) for x in sorted(all_, key=_rank)])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("row"), b.column("t"), pa.array(bests, _ITEM), pa.array(lists, pa.list_(_ITEM))], names=b.schema.names)

        now = now.mapInArrow(run, now.schema)
    cov = F.coalesce(F.col("best.coverage"), F.lit(0.0))
    leak = F.struct(F.col("best.item_id").alias("item_id"), cov.alias("coverage"),
                    F.coalesce(F.col("best.n_tiles"), F.lit(0)).alias("n_tiles"), (cov >= coverage).alias("contaminated"), "items")
    return now.select(*[F.col("row").getField(c).alias(c) for c in keep], leak.alias(leak_col))


_ITEM = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32())])


def _named(found: tuple | None) -> dict | None:
    return found and dict(zip(("item_id", "coverage", "n_tiles"), found))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that cover ``coverage`` or more of a test passage."""
    leak = common.unused(docs.columns, "_leak")
    return contamination(docs, benchmark, coverage=coverage, leak_col=leak).where(~F.col(leak)["contaminated"]).drop(leak)


@common.query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the test passage it covers most, and the ids of all it covers to the threshold."""
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", *(f"_leak.{c}" for c in ("item_id", "coverage", "n_tiles", "contaminated")),
                      F.col("_leak.items.item_id").alias("item_ids"))
