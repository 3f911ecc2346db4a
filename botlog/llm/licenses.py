"""Licence scan by canonical digests, in DataFrame operations.

A text is brought to a canonical form (small letters, no copyright lines, no
punctuation, one spelling of equivalent words), its SHA-256 is taken and
hash-joined to the digests of known licences. Only a whole text can match.
The known table is small by nature; Spark broadcasts it under its own size
threshold and shuffles digests beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common
from botlog.llm.license_digests import FULL
from botlog.llm.license_texts import KNOWN, NOTICES

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name an owner: they differ from copy to copy.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Spellings held to be equivalent, and phrases without meaning of their own.
EQUIVALENT = (
    (" all rights reserved ", " "), (" acknowledgement", " acknowledgment"), (" analogue ", " analog "),
    (" artefact", " artifact"), (" authoris", " authoriz"), (" calibre ", " caliber "), (" cancelled ", " canceled "),
    (" capitalis", " capitaliz"), (" catalogue ", " catalog "), (" categoris", " categoriz"), (" centre ", " center "),
    (" copyright owner", " copyright holder"), (" emphasis", " emphasiz"), (" favour", " favor"), (" fulfil ", " fulfill "),
    (" fulfilment ", " fulfillment "), (" https ", " http "), (" initialis", " initializ"), (" judgement", " judgment"),
    (" labelling ", " labeling "), (" labour ", " labor "), (" licence", " license"), (" maximis", " maximiz"),
    (" modelled ", " modeled "), (" modelling ", " modeling "), (" non commercial ", " noncommercial "),
    (" offence", " offense"), (" optimis", " optimiz"), (" organis", " organiz"), (" per cent ", " percent "),
    (" practise", " practice"), (" programme ", " program "), (" realis", " realiz"), (" recognis", " recogniz"),
    (" signalling ", " signaling "), (" sub license", " sublicense"), (" utilis", " utiliz"), (" whilst ", " while "),
    (" wilful", " willful"),
)


def canonical(text: Column) -> Column:
    """Canonical form of a text; null and empty give the empty text."""
    c = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL)
    c = F.regexp_replace(c, COPYRIGHT_LINE, "\n")
    c = F.concat(F.lit(" "), F.regexp_replace(c, PUNCTUATION, " "), F.lit(" "))
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_table(spark: SparkSession) -> DataFrame:
    """Short licences and notices; kind says which."""
    return spark.createDataFrame([(i, t, "notice" if t in NOTICES else "text") for i, t in KNOWN], "license_id string, text string, kind string")


def full_table(spark: SparkSession) -> DataFrame:
    """Digests of the full texts of common licences."""
    return spark.createDataFrame(list(FULL), "license_id string, k_digest string")


def license_lookup(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license_id) for each row of ``docs``; license_id is null
    where no known licence has the digest.

    ``known`` has license_id and text, by default the short licences and
    notices and with them the digests of common full texts; of licences with equal digests the
    smallest license_id counts, and known texts that are empty in canonical
    form match nothing (so null, empty and punctuation-only texts never do).
    Null and repeated ids are answered like any other; columns besides id and
    text are not read; an empty table gives no rows."""
    texts = known_table(docs.sparkSession) if known is None else known
    k = texts.where(canonical(F.col("text")) != "").select("license_id", digest(F.col("text")).alias("k_digest"))
    if known is None:
        k = k.union(full_table(docs.sparkSession))
    k = k.groupBy("k_digest").agg(F.min("license_id").alias("license_id"))
    own = docs.select(F.col(id_col).alias(id_col), digest(F.col(text_col)).alias("digest"))
    return own.join(k, F.col("digest") == F.col("k_digest"), "left").select(id_col, "digest", "license_id")


@common.query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document and the licence that has it."""
    return license_lookup(common.table(spark, sf_dir, "documents"))


def _sql_canonical(t: str) -> str:
    c = f"translate(coalesce({t}, ''), '{_CAPITALS}', '{_SMALL}')"
    c = f"regexp_replace({c}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    c = f"' ' || regexp_replace({c}, '{PUNCTUATION}', ' ', 'g') || ' '"
    for a, b in EQUIVALENT:
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'), ' ')"


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    full = ", ".join(f"('{i}', '{k}')" for i, k in FULL)
    return f"""
WITH known AS (SELECT k, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({_sql_canonical('text')}) AS k FROM (VALUES {rows}) AS v(license_id, text)
    UNION ALL SELECT license_id, k FROM (VALUES {full}) AS f(license_id, k)) GROUP BY k),
d AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known ON digest = k
"""


SQL = _sql()
