"""Katz backoff language model, fitted and evaluated on a whole corpus.

Counts are Good-Turing discounted and every context's backoff weight is the
mass its discounts left over, divided by the mass that the lower order gives
to words not seen after it, so each distribution sums to one.

The corpus never travels. A block of documents is coded once, as
distinct word hashes and a stream of word numbers, and written as a table that
is bucketed by block, where each later step reads it; only requests and answers are shuffled. At
each order, a block asks for the distinct n-grams it holds, dealt by hash
into buckets; a bucket adds up the training counts of all blocks and answers
each block with the totals of its n-grams and the totals of their contexts.
With the answers of all orders a block evaluates its own texts recursively:
an n-gram seen in training has its discounted share, any other the backoff
weight of its context times its probability one order lower.

N-grams are dealt by context, so that a context's totals meet in one bucket.
Contexts with more than 1/``HEAVY`` of all tokens (at most ``HEAVY`` of them,
and the start of a text) are dealt by n-gram instead, and their partial
totals, a bounded number, are added up and broadcast. The size of a block and
of a bucket does not grow with the corpus; their number does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common

#: Counts up to this one are discounted.
CUTOFF = 5
#: Tokens of a block and, about, of a bucket.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: A context with more than this share (1 / HEAVY) of all tokens is dealt by n-gram.
HEAVY = 1000

_END, _START = np.uint64(xxhash.xxh64_intdigest(b"\n", 1)), np.uint64(xxhash.xxh64_intdigest(b"\t", 1))
_BLOCK = "block long, n_tokens long, words binary, stream binary, lengths binary, ids array<long>, held binary"
_ANSWER = "block long, bucket int, kind int, a binary, b binary, context long, v array<double>"


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes: small numbers take few bytes."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.copy() if len(x) else np.zeros(0, np.uint8)
    return len(x).to_bytes(8, "little") + bytes(pa.compress(planes.tobytes(), codec="zstd", asbytes=True))


def _unpack(raw: bytes, dtype) -> np.ndarray:
    dtype, n = np.dtype(dtype), int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(raw[8:], n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)


def _pack_values(x: np.ndarray) -> bytes:
    """Floats with many equal values: the distinct ones and their numbers."""
    values, which = np.unique(x, return_inverse=True)
    return _bundle(_pack(values), _pack(which.astype(np.uint32)))


def _unpack_values(raw: bytes) -> np.ndarray:
    values, which = _unbundle(raw)
    return _unpack(values, np.float64)[_unpack(which, np.uint32)]


def _bundle(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _unbundle(raw: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(raw[:8], "little") + 8
    return raw[8:n], raw[n:]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def coded_blocks(docs: DataFrame, id_col: str, text_col: str, held: str, block_tokens: int) -> DataFrame:
    """Blocks of documents as word numbers; ``held`` is an SQL condition."""
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        numbers, stream, lengths, ids, hold = _Numbers(), [], [], [], []
        n = 0

        def flush():
            seen = np.concatenate(stream)
            order = np.argsort(-np.bincount(seen, minlength=len(numbers)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            hashes = np.array([xxhash.xxh64_intdigest(w) if w else _END for w in numbers], np.uint64)[order]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([n], pa.int64()), pa.array([_pack(hashes)]),
                 pa.array([_pack(place[seen])]), pa.array([_pack(np.array(lengths, np.int32))]),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([_pack(np.array(hold, np.uint8))])],
                names=["block", "n_tokens", "words", "stream", "lengths", "ids", "held"])

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = t.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
                words.append(b"")
                stream.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
                ids.append(i)
                hold.append(bool(h))
                n += len(words)
                if n >= block_tokens:
                    yield flush()
                    made += 1
                    numbers, stream, lengths, ids, hold, n = _Numbers(), [], [], [], [], 0
        if ids:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.expr(held).alias("h"), common.utf8(text_col).alias("t"))
    return narrow.mapInArrow(run, _BLOCK)


def discounts(n: list[float]) -> list[float]:
    """Factors for counts 1, 2, ... from the numbers of n-grams seen once,
    twice, ...: Good-Turing with Katz's renormalisation, at the largest cutoff
    where all factors lie between 0 and 1. Corpora too small or too regular
    for any get absolute discounting of the count 1."""
    for k in range(len(n) - 1, 1, -1):
        if min(n[:k + 1]) <= 0:
            continue
        a = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a < 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d
    return [1 - n[0] / (n[0] + 2 * n[1])] if n[0] > 0 and n[1] > 0 else [0.5]


class Level:
    """What the driver knows of one order: totals, discounts, heavy contexts."""

    def __init__(self, v: list[float], heavy: dict[int, np.ndarray]):
        self.once, self.types, self.tokens = [float(x) for x in v[:CUTOFF + 1]], float(v[CUTOFF + 1]), float(v[CUTOFF + 2])
        d = discounts(self.once)
        self.factor = np.array([1.0, *d, *[1.0] * (CUTOFF - len(d))])  # by count up to the cutoff
        self.heavy = heavy

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = count.astype(np.int64)
        return np.where(c <= CUTOFF, self.factor[np.minimum(c, CUTOFF)], 1.0) * c


def unigrams(level: Level, count: np.ndarray) -> np.ndarray:
    """Probabilities of words with these training counts; all unseen words are one type."""
    n, v = level.tokens, level.types
    seen_once = np.arange(1, CUTOFF + 1) * (1 - level.factor[1:]) * np.array(level.once[:CUTOFF])
    unseen = float(seen_once.sum()) / n if n else 1.0
    if unseen <= 0:
        return (count + 0.5) / (n + 0.5 * (v + 1))
    return np.where(count > 0, level.kept(count) / max(n, 1.0), unseen)


class Block:
    """The texts of one block and their probabilities, order by order."""

    def __init__(self, words: bytes, stream: bytes, lengths: bytes, held: bytes):
        self.hash, self.word = _unpack(words, np.uint64), _unpack(stream, np.int32)
        self.lengths, self.held = _unpack(lengths, np.int32).astype(np.int64), _unpack(held, np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.train = np.repeat(self.held == 0, self.lengths)
        self.gram, self.gram_hash, self.types = self.word, self.hash, len(self.hash)

    def extend(self):
        """From n-grams of one order to those one longer."""
        context = np.empty(len(self.gram), np.int64)
        context[1:] = self.gram[:-1]
        context[self.first] = self.types  # the start of a text
        context *= len(self.hash)
        context += self.word
        key, at, gram = np.unique(context, return_index=True, return_inverse=True)
        del context
        before = np.concatenate([self.gram_hash, [_START]])
        self.context, self.context_hash = key // len(self.hash), before
        self.gram, self.at, self.types = gram.astype(np.int32), at, len(key)
        self.gram_hash = _mix(before[self.context], self.hash[key % len(self.hash)])

    def deal(self, buckets: int, count_before: np.ndarray, tokens: float):
        """Order of the n-grams by bucket, cuts between buckets, heavy contexts."""
        heavy = np.concatenate([count_before * HEAVY > tokens, [True]])
        dealt = np.where(heavy[self.context], _mix(self.gram_hash, self.gram_hash), _mix(self.context_hash, self.context_hash)[self.context])
        bucket = (dealt % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1)), heavy


def _unigram_requests(coded: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                x = Block(*(b.column(c)[k].as_py() for c in ("words", "stream", "lengths", "held")))
                count = np.bincount(x.word[x.train], minlength=len(x.hash))
                bucket = (x.hash % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(i, order[lo:hi]) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("block")[k].as_py()] * len(rows), pa.int64()), pa.array([i for i, _ in rows], pa.int32()),
                     pa.array([_pack(x.hash[o]) for _, o in rows]), pa.array([_pack(count[o].astype(np.uint32)) for _, o in rows])],
                    names=["block", "bucket", "h", "c"])

    return coded.select("block", "words", "stream", "lengths", "held").mapInArrow(run, "block long, bucket int, h binary, c binary")


def _totals(count: np.ndarray) -> list[float]:
    return [*(float((count == r).sum()) for r in range(1, CUTOFF + 2)), float((count > 0).sum()), float(count.sum())]


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64())]
    names = ["block", "bucket", "kind", "a", "b", "context", "v"]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _unigram_answers(group: pa.Table) -> pa.Table:
    bucket = group["bucket"][0].as_py()
    hs = [_unpack(x.as_py(), np.uint64) for x in group["h"]]
    cs = np.concatenate([_unpack(x.as_py(), np.uint32) for x in group["c"]])
    _, which = np.unique(np.concatenate(hs), return_inverse=True)
    total = np.bincount(which, weights=cs).astype(np.int64)
    cuts = np.cumsum([0, *map(len, hs)])
    rows = [(b.as_py(), bucket, 0, _pack(total[which[lo:hi]]), None, None, None)
            for b, lo, hi in zip(group["block"], cuts, cuts[1:])]
    return _answers(rows + [(None, bucket, 1, None, None, None, _totals(total))])


def _gram_answers(group: pa.Table) -> pa.Table:
    """Totals of the n-grams of one bucket and of their contexts."""
    bucket = group["bucket"][0].as_py()
    asks = [{c: _unpack(r[c], t) for c, t in _ASK.items()} | {"lower": _unpack_values(r["lower"])} for r in group.to_pylist()]
    joined = {c: np.concatenate([a[c] for a in asks]) for c in ("low", "high", "count", "lower")}
    owner = np.concatenate([np.repeat(a["context"], a["size"]) for a in asks])
    with np.errstate(over="ignore"):
        gram = _mix(owner, joined["low"].astype(np.uint64) | joined["high"].astype(np.uint64) << np.uint64(32))
    _, at, which = np.unique(gram, return_index=True, return_inverse=True)
    total = np.bincount(which, weights=joined["count"]).astype(np.int64)
    contexts, place = np.unique(owner[at], return_inverse=True)
    n, seen = len(contexts), total > 0
    columns = [np.bincount(place[total == r], minlength=n).astype(np.float64) for r in range(1, CUTOFF + 1)]
    columns.append(np.bincount(place[total > CUTOFF], weights=total[total > CUTOFF], minlength=n))
    lower = np.zeros(len(total))  # blocks that hold the n-gram in training texts agree on it, others send 0
    np.maximum.at(lower, which, joined["lower"])
    columns.append(np.bincount(place[seen], weights=lower[seen], minlength=n))
    stats = np.stack(columns, axis=1)
    rows, cuts = [], np.cumsum([0, *(len(a["count"]) for a in asks)])
    for a, b, lo, hi in zip(asks, group["block"], cuts, cuts[1:]):
        light = a["context"][a["heavy"] == 0]
        of_light = stats[np.searchsorted(contexts, light)]
        whole = _pack(of_light[:, :-1].astype(np.uint64).T.ravel())
        rows.append((b.as_py(), bucket, 0, _pack(total[which[lo:hi]]), _bundle(whole, _pack_values(of_light[:, -1])), None, None))
    heavy = np.unique(np.concatenate([a["context"][a["heavy"] == 1] for a in asks]))
    for h, s in zip(heavy, stats[np.searchsorted(contexts, heavy)]):
        rows.append((None, bucket, 2, None, None, int(h.view(np.int64)), s.tolist()))
    return _answers(rows + [(None, bucket, 1, None, None, None, _totals(total))])


#: What a block sends to a bucket: its n-grams in order of context, each by
#: the 64 bits of its hash, and ``lower``, their probabilities one order lower.
_ASK = {"context": np.uint64, "size": np.uint32, "heavy": np.uint8, "low": np.uint32, "high": np.uint32, "count": np.uint32}
_COLUMNS = (*_ASK, "lower")


def _gathered(coded: pa.Table, answers: pa.Table, levels: list[Level], buckets: int):
    """The block of a coded row and its answers, evaluated as far as the answers go:
    (the coded row, block, unigram counts, counts of the last order, probability at every position)."""
    base = coded.to_pylist()[0]
    x = Block(base["words"], base["stream"], base["lengths"], base["held"])
    got = {(r["kind"], r["bucket"]): r for r in answers.to_pylist()}
    bucket = (x.hash % np.uint64(buckets)).astype(np.int64)
    first = np.zeros(len(x.hash), np.int64)
    for b in np.unique(bucket).tolist():
        first[bucket == b] = _unpack(got[1, b]["a"], np.int64)
    known, p = first, unigrams(levels[0], first)[x.word]
    for k, level in enumerate(levels[1:], start=2):
        x.extend()
        order, cuts, heavy = x.deal(buckets, known, levels[0].tokens)
        total = np.zeros(x.types, np.int64)
        stats = np.zeros((len(heavy), CUTOFF + 2))
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if hi > lo:
                total[order[lo:hi]] = _unpack(got[k, b]["a"], np.int64)
                asked = np.unique(x.context[order[lo:hi]])
                asked = asked[~heavy[asked]]
                whole, rest = _unbundle(got[k, b]["b"])
                stats[asked, :-1] = _unpack(whole, np.uint64).reshape(CUTOFF + 1, -1).T
                stats[asked, -1] = _unpack_values(rest)
        for c in np.flatnonzero(heavy):
            stats[c] = level.heavy.get(int(x.context_hash[c].view(np.int64)), np.zeros(CUTOFF + 2))
        r = np.arange(1, CUTOFF + 1)
        of_context = stats[:, :CUTOFF] @ r + stats[:, CUTOFF]
        kept = stats[:, :CUTOFF] @ (r * level.factor[1:]) + stats[:, CUTOFF]
        # A context without any discounted count gives one count to the unseen.
        of_context = np.where((of_context > 0) & (kept >= of_context), of_context + 1, of_context)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(of_context > 0, (1 - kept / of_context) / np.maximum(1 - stats[:, CUTOFF + 1], 1e-300), 1.0)
            lower = p[x.at]
            mine = np.where(total > 0, level.kept(total) / of_context[x.context], weight[x.context] * lower)
        known, p = total, mine[x.gram]
    return base, x, first, known, p


def _gram_requests(coded: DataFrame, answers: DataFrame, levels: list[Level], buckets: int) -> DataFrame:
    def ask(block: pa.Table, got: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            base, x, _, known, p = _gathered(block, got, levels, buckets)
            x.extend()
            order, cuts, heavy = x.deal(buckets, known, levels[0].tokens)
        count, lower = np.bincount(x.gram[x.train], minlength=x.types), p[x.at]
        rows = {c: [] for c in ("block", "bucket", *_COLUMNS)}
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if hi > lo:
                o = order[lo:hi]
                asked, size = np.unique(x.context[o], return_counts=True)
                part = {"context": x.context_hash[asked], "size": size, "heavy": heavy[asked], "low": x.gram_hash[o] & np.uint64(0xFFFFFFFF),
                        "high": x.gram_hash[o] >> np.uint64(32), "count": count[o]}
                rows["block"].append(base["block"])
                rows["bucket"].append(b)
                for c, t in _ASK.items():
                    rows[c].append(_pack(part[c].astype(t)))
                rows["lower"].append(_pack_values(np.where(count[o] > 0, lower[o], 0.0)))
        return pa.table({"block": pa.array(rows["block"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int32()),
                         **{c: pa.array(rows[c], pa.binary()) for c in _COLUMNS}})

    return (coded.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(ask, "block long, bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS)))


def _level(answers: DataFrame) -> Level:
    """Totals of one order: one row of sums, and at most HEAVY contexts and the start."""
    sums = answers.where("kind = 1").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    heavy = (answers.where("kind = 2").select("context", F.posexplode("v")).groupBy("context", "pos")
             .agg(F.sum("col").alias("s")).collect())
    table: dict[int, np.ndarray] = {}
    for r in heavy:
        table.setdefault(r["context"], np.zeros(CUTOFF + 2))[r["pos"]] = r["s"]
    v = {r["pos"]: r["s"] for r in sums}
    return Level([v.get(k, 0.0) for k in range(CUTOFF + 3)], table)


def score(docs: DataFrame, order: int = 2, held: str = "false", id_col: str = "doc_id", text_col: str = "text",
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for
    each row of ``docs``; rows where the SQL condition ``held`` is true are
    scored but not learnt from.

    Scores are log10 probabilities of the whole text and its end. Null and
    empty texts consist of their end; without training text every token is
    unseen and has probability one. Rows with null or repeated ids are learnt
    from and scored like any other; other columns are read only by ``held``;
    an empty table gives no rows."""
    spark = docs.sparkSession
    common.prepare(spark)
    coded = common.written_by(coded_blocks(docs, id_col, text_col, held, block_tokens), "katz-blocks", "block")
    tokens = coded.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    answers: DataFrame | None = None
    levels: list[Level] = []
    for k in range(1, order + 1):
        if k == 1:
            asked, answer = _unigram_requests(coded, buckets), _unigram_answers
        else:
            asked, answer = _gram_requests(coded, answers, list(levels), buckets), _gram_answers
        given = common.written(asked.groupBy("bucket").applyInArrow(answer, _ANSWER), f"katz-answers-{k}")
        levels.append(_level(given))
        del asked
        common.release_shuffles(spark)  # the answers are a table now
        given = given.where("kind = 0").select("block", F.lit(k).alias("kind"), "bucket", "a", "b")
        answers = given if answers is None else answers.union(given)
    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(block: pa.Table, got: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            base, x, count, _, p = _gathered(block, got, levels, buckets)
        n, v = levels[0].tokens, levels[0].types
        plain = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[x.word]
        summed = [np.add.reduceat(c, x.first) for c in ((count > 0)[x.word].astype(np.int64), plain, np.log10(p))]
        return pa.table([pa.array(base["ids"], pa.int64()), pa.array(x.held != 0), pa.array(x.lengths),
                         pa.array(summed[0]), pa.array(np.full(len(x.lengths), int(n))), pa.array(summed[1]),
                         pa.array(summed[2])], schema=schema)

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        evaluate, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@common.query
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram Katz scores of all documents, learnt outside the held-out fifth."""
    return score(common.table(spark, sf_dir, "documents"), 2, "crc32(binary(coalesce(string(doc_id), ''))) % 5 = 1")
