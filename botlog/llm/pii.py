"""Personal data by patterns and information-theoretic sanitisation.

Base spans (e-mail, IPv4, payment card, phone) are found by fixed patterns.
Every distinct value is a protected entity. A term that stands near an entity
may give it away: with n(t) occurrences of the term in the corpus, n(e) of
the entity, n(t, e) of the term near the entity and N words in all, the term
reveals the entity by its pointwise mutual information
log2(n(t, e) N / (n(t) n(e))) and by p(e | t) = n(t, e) / n(t). Terms beyond
both disclosure thresholds are sanitised wherever they stand, near the entity
or in texts that do not name it: p(e | t) from ``REMOVE`` on removes them,
below it they are generalised. Runs with digits (account numbers, user names,
postcodes) are terms too.

Counts come from the whole corpus. Words are counted by 64-bit hash within
every partition first, so the shuffle carries few rows per word; only
terms near entities, a number bounded by the entities' windows, are joined.
A second pass over the texts finds all other occurrences of the flagged terms:
a bitmap of their hashes, of fixed size, is broadcast and lets candidates
through, which are joined to the terms by hash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common

#: Words on either side of an entity in which a term counts as near it.
WINDOW = 5
#: Disclosure thresholds: bits of mutual information, p(e | t), times seen together.
LEAST_BITS, LEAST_SHARE, LEAST_TOGETHER = 8.0, 0.5, 3
#: Share from which a term is removed instead of generalised.
REMOVE = 0.9

#: Kinds in their order of listing, then what the method adds.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.A)
#: As [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), but tried at the start of a run of digits only: linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", re.A)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+", re.A)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
_WORD = re.compile(r"[^\W_]{3,}")
#: Bits of the map of flagged terms, as a power of two.
MAP_BITS = 26


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Matches of EMAIL, searched from every @ so that long runs without one cost nothing."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and ord(text[start - 1]) < 128 and ord(text[start - 1]) in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entity(kind: int, value: str) -> str:
    """The protected value: writing variants of one number are one entity."""
    return f"{kind}:" + (value.lower() if kind < 2 else re.sub("[^0-9]", "", value))


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode()) - (1 << 63)


def _free_words(text: str, spans) -> list[tuple[int, int]]:
    """(start, end) of the words that touch no span."""
    merged: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    words, k = [], 0
    for m in _WORD.finditer(text):
        while k < len(merged) and merged[k][1] <= m.start():
            k += 1
        if k == len(merged) or m.end() <= merged[k][0]:
            words.append((m.start(), m.end()))
    return words


def _near_terms(text: str, spans, window: int):
    """(term hash, entity hash, start, end) of the words nearest to each span
    among those that touch no span."""
    if not spans:
        return []
    words = _free_words(text, spans)
    out = []
    for kind, start, end in spans:
        e = _hash(entity(kind, text[start:end]))
        left, right = bisect_right(words, (start, start)), bisect_left(words, (end, end))
        out += [(_hash(text[s:t].lower()), e, s, t) for s, t in words[max(0, left - window):left] + words[right:right + window]]
    return out


_SCANNED = ("row long, id long, n array<long>, base string, spans array<struct<kind:int,start:int,end:int>>, "
            "near array<struct<term:long,entity:long,start:int,end:int>>, t string, words array<struct<word:long,n:long>>")


def _scan(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Base spans and near terms of every row, and word counts of the partition on extra rows."""
    common.prepare(docs.sparkSession)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("term", pa.int64()), ("entity", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    word = pa.struct([("word", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.list_(pa.int64())), ("base", pa.string()),
                        ("spans", pa.list_(span)), ("near", pa.list_(near)), ("t", pa.string()),
                        ("words", pa.list_(word))])

    def counted(seen: dict[str, int]) -> pa.RecordBatch:
        words = np.array([_hash(w) for w in seen], np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(words), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        return pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(c).type) for c in schema.names[:-1]]
                                          + [pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pairs)], schema=schema)

    def run(batches):
        seen: dict[str, int] = {}
        for b in batches:
            rows = {c: [] for c in schema.names}
            for r, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for w in _WORD.findall(t.lower()):
                    seen[w] = seen.get(w, 0) + 1
                spans = base_spans(t)
                for c, v in zip(schema.names, (
                        r, i, [sum(k == s[0] for s in spans) for k in range(4)],
                        ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans),
                        [{"kind": k, "start": s, "end": e} for k, s, e in spans],
                        [dict(zip(("term", "entity", "start", "end"), x)) for x in _near_terms(t, spans, window)], t, None)):
                    rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], schema.field(c).type) for c in schema.names], schema=schema)
            if len(seen) > 400_000:  # bounds the worker; counts are added up later
                yield counted(seen)
                seen = {}
        yield counted(seen)

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return narrow.mapInArrow(run, _SCANNED)


def _occurrences(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """(row, start, end, action) of every occurrence of a flagged term outside base spans."""
    spark = rows.sparkSession
    place = F.col("term").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    parts = (flagged.select(F.shiftright(place, 3).cast("int").alias("at"), F.expr("shiftleft(1, cast(term & 7 as int))").alias("b"))
             .groupBy("at").agg(F.bit_or("b").cast("int").alias("b")).toArrow())
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bits[parts["at"].to_numpy()] = parts["b"].to_numpy()
    held = spark.sparkContext.broadcast(bits)

    def run(batches):
        seen = held.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            for r, spans, t in zip(*(b.column(c).to_pylist() for c in ("row", "spans", "t"))):
                for s, e in _free_words(t, [(x["kind"], x["start"], x["end"]) for x in spans]):
                    h = _hash(t[s:e].lower())
                    if seen[(h & ((1 << MAP_BITS) - 1)) >> 3] >> (h & 7) & 1:
                        for c, v in zip(out, (r, h, s, e)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             names=["row", "term", "start", "end"])

    found = rows.select("row", "spans", "t").mapInArrow(run, "row long, term long, start int, end int")
    return found.join(flagged, "term").select("row", "start", "end", "action")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   least_bits: float = LEAST_BITS, least_share: float = LEAST_SHARE,
                   least_together: int = LEAST_TOGETHER, remove: float = REMOVE) -> DataFrame:
    """(id, n, base, spans, elsewhere) for each row of ``docs``: n counts base
    spans by kind, base lists them as kind:start:end by kind and start, and
    spans is the array of (kind, start, end, action) with the terms that the
    method adds near their entity (kind 4); action is "remove" or
    "generalise". elsewhere lists, in the same form, every further occurrence
    of a flagged term with the strongest action of the term for any entity,
    and those of spans for which that is stronger; both are to be sanitised.

    Null and empty texts have no spans. Rows with null or repeated ids are
    counted and answered like any other. Other columns are not read. An empty
    table gives no rows."""
    scanned = common.written(_scan(docs, id_col, text_col, window), "pii-scan")
    rows = scanned.where("row is not null")
    near = common.written(rows.select("row", F.explode("near").alias("x")).select("row", "x.*").distinct(), "pii-near")
    total = F.lit(scanned.select(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))
                  .agg(F.sum("n").alias("n")).first()["n"] or 0)
    of_word = (scanned.where("words is not null").select(F.explode("words").alias("x")).select("x.*")
               .groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("n_t")))
    of_entity = (rows.where(F.size("near") > 0)
                 .select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
                 .groupBy("entity").agg(F.count("*").alias("n_e")))
    together = near.groupBy("term", "entity").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= least_together)
    share = F.col("n_te") / F.col("n_t")
    flagged = common.written(together.join(of_word, "term").join(of_entity, "entity")
               .where((F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e"))) >= least_bits) & (share >= least_share))
               .select("term", "entity", F.when(share >= remove, "remove").otherwise("generalise").alias("action")), "pii-flagged")
    # Hot entities are split by the term; what is left is bounded by the spans of a row.
    terms = (near.join(flagged, ["term", "entity"]).groupBy("row", "start", "end").agg(F.max("action").alias("action"))
             .groupBy(F.col("row").alias("_row"))
             .agg(F.sort_array(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end", "action"))).alias("terms")))
    anywhere = (_occurrences(rows, flagged.groupBy("term").agg(F.max("action").alias("action"))).groupBy(F.col("row").alias("_at"))
                .agg(F.sort_array(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end", "action"))).alias("all")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,action:string>>")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                   F.lit("remove").alias("action")))
    return (rows.select("row", "id", "n", "base", "spans").join(terms, F.col("row") == F.col("_row"), "left")
            .join(anywhere, F.col("row") == F.col("_at"), "left")
            .select(F.col("id").alias(id_col), "n", "base", F.concat(base, F.coalesce("terms", none)).alias("spans"),
                    F.array_except(F.coalesce("all", none), F.coalesce("terms", none)).alias("elsewhere")))


def sanitise(text: str, spans) -> str:
    """``text`` with removed spans as [kind] and generalised ones as [word]; of equal spans the stronger action counts."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["action"] != "remove")):
        if s["start"] >= at:
            out += [text[at:s["start"]], "[word]" if s["action"] == "generalise" else f"[{KINDS[s['kind']]}]"]
            at = s["end"]
        elif s["end"] > at:
            at = s["end"]
    return "".join(out) + text[at:]


@common.query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans, disclosing terms near their entities and all over the corpus."""
    found = personal_spans(common.table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    # All spans, once each, by kind and start: a term near one entity and far from another is one span.
    every = F.array_sort(F.array_distinct(F.transform(F.concat("spans", "elsewhere"), lambda s: F.struct(s["kind"], s["start"], s["end"]))))
    return found.withColumn("every", every).select(
        "doc_id", *[F.col("n")[k].alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), listed("every").alias("spans"),
        listed("elsewhere").alias("elsewhere"))
