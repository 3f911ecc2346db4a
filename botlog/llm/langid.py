"""Language identification by multinomial naive Bayes over hashed character
n-grams.

A text is folded to lower-case words (runs of anything but letters become one
space, with a space at both ends) and read as its character n-grams of
``ORDERS``, spaces included. Every n-gram is hashed into one of ``WIDTH``
columns. The model is the matrix of smoothed log-probabilities (column x
language) and the languages' log-priors. It is broadcast, and a batch of texts
is scored in numpy as a sparse count matrix times this matrix: the rows of the
hashed n-grams are gathered and summed for each text.

* Counts are taken over all training rows, whole texts, map-side: a task
  returns one row for each language and column that it met, however many rows
  share a source, language or text, so no hot group reaches one task. The
  shuffle is bounded by languages x ``WIDTH`` rows a task.
* The model is at most ``LANGUAGES`` x ``WIDTH`` numbers: the languages of the
  most training rows, ties by name, are learnt (a documented bound of the
  model; rows of rarer languages are still predicted, as one of these).
* Very long texts are cut into pieces of code points that overlap by the
  longest n-gram, so memory is bounded by the text itself and no n-gram is lost.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text when no training row has a language and a letter. Training
rows with a null language or no letter teach nothing. Equal posteriors give the
language that sorts first. Repeated rows and ids count and are returned each.
An empty table gives no rows. A column of the input named like an output
(``lang_pred``, ``score``) is replaced; all others are passed through.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.llm import common

#: Lengths of the character n-grams, columns they are hashed to, and languages learnt at most.
ORDERS = (1, 2, 3)
WIDTH = 1 << 16
LANGUAGES = 256
#: Added to every count.
SMOOTHING = 0.5
#: Numbers gathered at once while scoring (bounds a worker's memory).
GATHERED = 1 << 22

UNKNOWN = "und"
#: Row of the counts table that holds a language's training texts.
_TEXTS = -1

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower-case letters of ``text``, other runs as one space, a space at
    both ends; one space when there is no letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    words = _OTHER.sub(" ", text.lower()).strip()
    if not words or not (words.isascii() or any(map(str.isalpha, words))):
        return " "
    return f" {words} "


def columns_of(points: np.ndarray, order: int) -> np.ndarray:
    """Hashed column of the n-gram that starts at each code point."""
    h = np.full(len(points) - order + 1, order, np.uint64)
    for j in range(order):
        h = (h ^ points[j:len(points) - order + 1 + j].astype(np.uint64)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return (h * _MULTIPLIER >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)


def hashed(folded: list[str], piece: int):
    """(owner, column) arrays of all n-grams of the folded texts, owners
    ascending, in pieces of at most ``piece`` starting points."""
    sizes = np.array([len(t) for t in folded])
    points = np.frombuffer("".join(folded).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(folded)), sizes)
    for a in range(0, len(points), piece):
        for n in ORDERS:
            seg = points[a:a + piece + n - 1]
            if len(seg) < n:
                continue
            own = owner[a:a + len(seg) - n + 1]
            inside = own == owner[a + n - 1:a + len(seg)]
            yield own[inside], columns_of(seg, n)[inside]


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray   # WIDTH x languages, log-probabilities
    priors: np.ndarray

    def log_scores(self, folded: list[str]) -> np.ndarray:
        """Joint log-probability of each folded text and language."""
        out = np.tile(self.priors, (len(folded), 1))
        for own, cols in hashed(folded, max(1024, GATHERED // max(1, len(self.languages)))):
            if len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(self.matrix[cols], first, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability."""
        folded = [fold(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        s = self.log_scores(folded)
        best = s.argmax(axis=1)
        p = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array([t != " " for t in folded], bool)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p, 0.0)


def ngram_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, col, n) over all rows (text, lang) of the given languages; col
    -1 counts the texts. Summed inside each task before anything moves."""
    held = rows.sparkSession.sparkContext.broadcast(languages)
    schema = pa.schema([("lang", pa.string()), ("col", pa.int32()), ("n", pa.int64())])

    def run(batches):
        known = set(held.value)
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            texts: dict[str, list[str]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in known and (f := fold(t)) != " ":
                    texts.setdefault(lang, []).append(f)
            for lang, folded in texts.items():
                c = counts.setdefault(lang, np.zeros(WIDTH + 1, np.int64))
                c[WIDTH] += len(folded)
                for _, cols in hashed(folded, GATHERED // 4):
                    c[:WIDTH] += np.bincount(cols, minlength=WIDTH)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()),
                                              pa.array(np.where(at == WIDTH, _TEXTS, at), pa.int32()), pa.array(c[at])], schema=schema)

    return (rows.mapInArrow(run, "lang string, col int, n long")
            .groupBy("lang", "col").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of all rows of ``docs`` that have a language."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang IS NOT NULL")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    got = ngram_counts(rows, sorted(r["lang"] for r in most)).toArrow()  # at most LANGUAGES x WIDTH rows
    col, n = got.column("col").to_numpy(), got.column("n").to_numpy()
    names = np.array(got.column("lang").to_pylist(), object)
    languages = sorted(set(names[col == _TEXTS]))
    counts = np.zeros((WIDTH, len(languages)))
    texts = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        mine = names == lang
        texts[i] = n[mine & (col == _TEXTS)].sum()
        counts[col[mine & (col != _TEXTS)], i] = n[mine & (col != _TEXTS)]
    smooth = counts + SMOOTHING
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log((texts + 1) / (texts.sum() + len(languages))))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    common.prepare(spark)
    held = spark.sparkContext.broadcast(model)
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    given = kept.schema.fields
    schema = T.StructType([*given, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(given)],
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = [f.name for f in schema.fields]

    def run(batches):
        m = held.value
        for b in batches:
            langs, scores = m.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=names)

    return inner.mapInArrow(run, schema)


@common.query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out fifth."""
    docs = common.table(spark, sf_dir, "documents")
    fifth = common.bucket_of("doc_id", 5)
    model = fit(docs.where(fifth != 0).select("text", "lang"))
    return identify(docs.select("doc_id", (fifth == 0).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")
