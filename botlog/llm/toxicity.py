"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first (case, compatibility forms, homoglyphs, digits and
signs that stand for letters inside words, accents). The lexicon is learnt
from labelled training rows: whole words and word beginnings with a far
higher rate in toxic texts than in clean ones. The rate of an entry is its
share of a text's words, averaged over the texts, so that an entry which
clean texts hold once and toxic ones time and again counts, and no single long text
decides; its weight is the log of the ratio of the two rates.
Exception phrases are learnt too: a lexicon entry with a neighbouring word,
where that pair is found in clean texts and hardly in toxic ones, does not
count. A text's score is a logistic function of its total weight and of its
weight per word, fitted on the same rows.

Only the bounded training sample shapes the model (``SAMPLE_ROWS``, chosen by
a hash of the id); every row is scored whole, map-side, with the lexicon (at
most ``LEXICON_SIZE`` entries) broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.llm import common

#: Labelled training rows the model is fitted on: so many toxic ones at most, and twice as many clean ones.
SAMPLE_ROWS = 4_000
#: Lexicon entries and exception phrases, at most.
LEXICON_SIZE = 2_000
#: Lengths of the word beginnings that may enter the lexicon.
STEMS = (4, 5, 6, 7, 8)
#: An entry needs this many toxic training texts and this weight (the logistic step does the cutting).
LEAST_TEXTS, LEAST_WEIGHT = 8, 2.5
#: Added to both rates, as a share of all texts' words summed over the texts.
RATE_PRIOR = 0.01
#: An exception phrase needs this many clean training texts.
LEAST_PHRASES = 5
#: Rates are summed as whole parts of this, so that sums do not depend on their order.
_PARTS = 10 ** 9

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g",
    "ɩ": "i", "օ": "o", "ո": "n", "ս": "u",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b"}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(SUBSTITUTES)
#: Runs of substitutes before a letter, and digits after one; linear in the text.
_SIGNS = re.compile(r"(?<![0134578@$!|+])[0134578@$!|+]++(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+")
_MARKS = re.compile("[\u0300-\u036f\u200b-\u200f\u2060\ufeff\u00ad]+")
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words of ``text`` joined by single spaces, with a space at both ends."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).lower().translate(_GLYPHS)
    t = _SIGNS.sub(lambda m: m[0].translate(_DIGITS), t)
    return " " + _OTHER.sub(" ", t).strip() + " "


def entries(words: set[str]) -> set[str]:
    """Possible lexicon entries in the distinct words of a text: " word " and " beginning"."""
    out = {f" {w} " for w in words if 2 < len(w) < 40}
    for n in STEMS:
        out.update(" " + w[:n] for w in words if len(w) >= n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, ...] = (-4.0, 1.0, 0.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            a.add_word(e, (len(e), w))
        if self.weights:
            a.make_automaton()
        return a

    def matches(self, automaton, folded: str):
        """(start, end, weight) of the heaviest entry at each word that no exception phrase covers."""
        best: dict[int, tuple[float, int]] = {}
        if not self.weights:
            return []
        for end, (n, w) in automaton.iter(folded):
            start = end + 1 - n
            if start not in best or w > best[start][0]:
                best[start] = (w, end + 1)
        out = []
        for start, (w, end) in best.items():
            if self.exceptions:
                stop = folded.find(" ", start + 1)
                before = folded.rfind(" ", 0, start)
                after = folded.find(" ", stop + 1)
                near = {folded[start:after + 1] if after > 0 else "", folded[before:stop + 1] if before >= 0 else ""}
                if near & self.exceptions:
                    continue
            out.append((start, end, w))
        return out

    def features(self, automaton, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.matches(automaton, folded))
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100.0 * total / words)

    def score(self, automaton, text: str) -> float:
        c0, c1, c2 = self.coefficients
        a, b = self.features(automaton, text)
        z = max(-60.0, min(60.0, c0 + c1 * a + c2 * b))
        return 1.0 / (1.0 + math.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, ...]:
    """Coefficients (constant first) by Newton steps; slopes are kept from
    falling below zero: more toxic words never lower a score."""
    x = np.column_stack([np.ones(len(x)), x])
    used, w = [0, 1, 2], np.zeros(x.shape[1])
    while True:
        b = np.zeros(len(used))
        xs = x[:, used]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(xs @ b, -30, 30)))
            h = (xs * (p * (1 - p))[:, None]).T @ xs + ridge * np.eye(len(used))
            step = np.linalg.solve(h, xs.T @ (y - p) - ridge * b)
            b += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        bad = [u for u, v in zip(used, b) if u and v < 0]
        if not bad:
            break
        used.remove(bad[0])
    w[used] = b
    return tuple(float(v) for v in w)


def _training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of the bounded sample. A document labelled both ways is left
    out; of rows that repeat an id, the smallest text counts."""
    lab = (labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id")
           .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
           .where(common.bucket_of("doc_id", 5) != 0))
    chosen = lab.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(sample_rows).union(
        lab.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(2 * sample_rows))
    return (docs.where(common.bucket_of("doc_id", 5) != 0).select("doc_id", "text")
            .join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("toxic").alias("toxic"))
            .select("text", "toxic"))


def entry_shares(text: str) -> dict[str, float]:
    """Each possible lexicon entry of a text and its share of the text's words."""
    words = fold(text).split()
    out: dict[str, float] = {}
    for w, n in Counter(words).items():
        for e in entries({w}):
            out[e] = out.get(e, 0.0) + n / len(words)
    return out


def _counts(rows: DataFrame, make, column: str) -> DataFrame:
    """For each string of ``make(text)`` (string -> share): the clean and toxic
    training texts that hold it, and the sums of its shares in both."""
    names = ("clean", "toxic", "clean_share", "toxic_share")
    schema = pa.schema([(column, pa.string()), *[(c, pa.int64()) for c in names]])

    def run(batches):
        for b in batches:
            held: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for e, share in make(t).items():
                    v = held.setdefault(e, [0, 0, 0, 0])
                    v[y] += 1
                    v[2 + y] += round(share * _PARTS)
            yield pa.RecordBatch.from_pydict({column: list(held)} | {c: [v[i] for v in held.values()] for i, c in enumerate(names)}, schema)

    return (rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, f"{column} string, " + ", ".join(f"{c} long" for c in names))
            .groupBy(column).agg(*[F.sum(c).alias(c) for c in names]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_size: int = LEXICON_SIZE) -> Lexicon:
    """The lexicon, exception phrases and calibration, learnt from labelled
    rows whose id's remainder is not 0. Without labels of both kinds the
    lexicon is empty and every score is the prior."""
    common.prepare(docs.sparkSession)
    rows = common.written(_training_rows(docs, labels, sample_rows), "toxicity-train")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        prior = (n1 + 0.5) / (n1 + n0 + 1) if n1 + n0 else 0.1
        return Lexicon({}, set(), (math.log(prior / (1 - prior)), 0.0, 0.0))

    odds = (F.log((F.col("toxic_share") / _PARTS + RATE_PRIOR) / n1) - F.log((F.col("clean_share") / _PARTS + RATE_PRIOR) / n0))
    found = (_counts(rows, entry_shares, "entry")
             .where(F.col("toxic") >= LEAST_TEXTS).withColumn("weight", odds).where(F.col("weight") >= LEAST_WEIGHT)
             .orderBy(F.desc("toxic"), F.desc("weight"), "entry").limit(lexicon_size).collect())
    weights = {r["entry"]: float(r["weight"]) for r in found}
    lexicon = Lexicon(weights)

    def phrases(t, lexicon=lexicon, made=[]):
        if not made:
            made.append(lexicon.automaton())
        folded, out = fold(t), set()
        for start, _, _ in lexicon.matches(made[0], folded):
            stop = folded.find(" ", start + 1)
            before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
            out.update(([folded[start:after + 1]] if after > 0 else []) + ([folded[before:stop + 1]] if before >= 0 else []))
        return dict.fromkeys(out, 0.0)

    if weights:
        lexicon.exceptions = {r["phrase"] for r in _counts(rows, phrases, "phrase").where(
            (F.col("clean") >= LEAST_PHRASES) & (F.col("clean") * n1 >= 4 * F.col("toxic") * n0))
            .orderBy(F.desc("clean"), "phrase").limit(lexicon_size).collect()}

    def features(batches):
        a = lexicon.automaton()
        for b in batches:
            v = [lexicon.features(a, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in v], pa.float64()), pa.array([x for _, x in v], pa.float64()),
                                              b.column(1)], names=["a", "b", "toxic"])

    # The sample is bounded, so its features may meet on the driver.
    xy = rows.select("text", F.col("toxic").cast("int")).mapInArrow(features, "a double, b double, toxic int").collect()
    xy = np.array(sorted((r["a"], r["b"], r["toxic"]) for r in xy))
    lexicon.coefficients = logistic(xy[:, :2], xy[:, 2])
    return lexicon


def score_rows(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Columns ``keep`` of every row and ``score_col`` (0 to 1; its name must
    not be among ``keep``). Null and empty texts get the score of a text
    without matches, very long ones are read whole. No row is dropped."""
    spark = docs.sparkSession
    common.prepare(spark)
    held = spark.sparkContext.broadcast(lexicon)
    narrow = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(score_col, T.DoubleType())])

    def run(batches):
        lex = held.value
        a = lex.automaton()
        for b in batches:
            scores = pa.array([lex.score(a, t) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], names=[*keep, score_col])

    return narrow.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. All columns
    are kept, whatever their names; null and empty texts stay unless the prior
    itself is toxic; repeated rows are all judged alike; an empty table gives no rows."""
    score = common.unused(docs.columns, "score")
    scored = score_rows(docs, fit(docs, labels), docs.columns, score_col=score)
    return scored.where(F.col(f"`{score}`") < threshold).drop(F.col(f"`{score}`"))


@common.query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fifth."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score_rows(docs, fit(docs, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (common.bucket_of("doc_id", 5) == 0).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
